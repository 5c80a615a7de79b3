"""Benchmark decontamination by spaced seeds.

A mask is a fixed pattern of token positions that count; the others are ignored, so a hash of a
masked window survives substitutions at ignored places. Hashes of all masks are joined between
test items and training texts. Around each hit the aligned tokens are compared, and a stretch counts
when enough of its tokens are equal. Masks go by the length of an item: together they meet every
pattern of changes that leaves the asked share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brightshelf.llm.frames import TEXT, hash_filter, in_filter, scan_text, text_buffer
from brightshelf.llm.words import LETTER_OR_DIGIT, Hasher, mix, split
from brightshelf.session import materialise

# (tokens, changes): masks of which one at least, somewhere in so many tokens, avoids the changes,
# wherever they lie. Found by greedy search; the tests go through all patterns.
MASKS: dict[tuple[int, int], tuple[str, ...]] = {
    (8, 1): ("110111", "1011011"),
    (10, 2): ("110111", "11001011", "11111"),
    (15, 3): ("1111011", "101001000111", "1110001011"),
    (20, 4): ("11111111", "1101100101011", "1011010011101", "1110010110011", "1111011", "110010001010001"),
}
STRETCH, SHARE, LEAST = 20, 0.8, 8


def changes(length: int, share: float) -> int:
    """Most tokens of so many that may differ."""
    return length - next(n for n in range(length + 1) if n >= min(share, 1.0) * length)


def masks_for(length: int, stretch: int, share: float, least: int, table: dict[tuple[int, int], tuple[str, ...]]) -> tuple[str, ...]:
    """Masks for items of `length` tokens; those under `least` are met only as a whole."""
    length = min(length, stretch)
    if length < least:
        return ("1" * length,) if length else ()
    wrong = changes(length, share)
    fit = [key for key in table if key[0] <= length and key[1] >= wrong]
    if fit:
        return table[max(fit)]
    # So many changes leave an unbroken run of this length.
    return ("1" * max(1, math.ceil((length - wrong) / (wrong + 1))),)


def masked_hashes(tokens: np.ndarray, first: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position, number of the mask) of each masked window that lies inside one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    values, texts, places, numbers = [], [], [], []
    for number, mask in enumerate(masks):
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            continue
        # The mask itself goes into the hash, so any set of masks gives the same.
        h = np.full(n, int("1" + mask, 2) % (1 << 64), np.uint64)
        for k, flag in enumerate(mask):
            if flag == "1":
                h = mix(h * np.uint64(0x2545F4914F6CDD1D) + tokens[k : k + n])
        whole = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
        values.append(h[whole])
        texts.append(text[whole])
        places.append(whole - first[text[whole]])
        numbers.append(np.full(len(whole), number))
    if not values:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty, empty, empty
    return np.concatenate(values), np.concatenate(texts), np.concatenate(places), np.concatenate(numbers)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))


def _once(value: np.ndarray, text: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Places of hashes to keep: of those marked `single` only the first in each text."""
    marked = np.flatnonzero(single)
    order = marked[np.lexsort((marked, value[marked], text[marked]))]
    again = np.r_[False, (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])][: len(order)]
    kept = np.ones(len(value), bool)
    kept[order[again]] = False
    return kept


def _kernel(masks: tuple[str, ...], passing: np.ndarray | None, own: np.ndarray | None = None, whole: tuple[bool, ...] = ()):
    """Masked hashes of every text, and its token hashes where any is left.

    `own` (mask x length) tells which masks texts of a length, or of the last length and above,
    use. A mask that is `whole` makes a match by itself, so a text needs it once.
    """

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = text_buffer(batch)
        words = split(data, offsets, LETTER_OR_DIGIT)
        tokens = Hasher()(data, words)
        value, text, place, mask = masked_hashes(tokens, words.first, masks)
        if own is not None:
            kept = own[mask, np.minimum(words.counts(), own.shape[1] - 1)[text]]
            value, text, place = value[kept], text[kept], place[kept]
        if passing is not None:
            kept = in_filter(passing, value)
            value, text, place, mask = value[kept], text[kept], place[kept], mask[kept]
            kept = _once(value, text, np.array(whole, bool)[mask])
            value, text, place = value[kept], text[kept], place[kept]
        order = np.argsort(text, kind="stable")
        n = len(offsets) - 1
        hits = np.bincount(text, minlength=n)
        shown = hits > 0 if passing is not None else np.ones(n, bool)
        lengths = np.where(shown, words.counts(), 0)
        return {
            "hashes": _lists(value[order].view(np.int64), hits),
            "places": _lists(place[order], hits),
            "tokens": _lists(tokens[np.repeat(shown, words.counts())].view(np.int64), lengths),
        }

    return run


_DDL = "hashes array<bigint>, places array<bigint>, tokens array<bigint>"


def best_stretch(doc: np.ndarray, item: np.ndarray, shift: int, stretch: int) -> tuple[int, int]:
    """Most equal tokens in any window of `stretch` aligned tokens, and the window's length."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    length = min(stretch, len(item))
    if hi - lo < length or length <= 0:
        return 0, length
    same = np.r_[0, np.cumsum(doc[lo + shift : hi + shift] == item[lo:hi])]
    return int((same[length:] - same[:-length]).max()), length


def _verify(stretch: int, share: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item = batch.column("doc_tokens"), batch.column("item_tokens")
            scores = []
            for i, shift in enumerate(batch.column("shift").to_pylist()):
                equal, length = best_stretch(doc[i].values.to_numpy(), item[i].values.to_numpy(), shift, stretch)
                scores.append(equal / length if equal >= (share * length if length >= least else max(length, 1)) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("item"), pa.array(scores, pa.float64())], names=["doc", "item", "share"])

    return run


def find_overlaps(
    df: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: dict[tuple[int, int], tuple[str, ...]] = MASKS,
    stretch: int = STRETCH,
    share: float = SHARE,
    least: int = LEAST,
) -> DataFrame:
    """Distinct (doc_id, item_id, share): best share of equal tokens over a window of `stretch` tokens.

    Only pairs with at least `share` are returned. Items shorter than `stretch` are met as a whole,
    those under `least` tokens only by exact copies, items without tokens never. Null or empty texts and null ids overlap with nothing; rows
    that repeat an id count together.
    """
    spark = df.sparkSession
    plan = [masks_for(length, stretch, share, least, masks) for length in range(stretch + 1)]
    every = tuple(sorted(set().union(*plan)))
    own = np.array([[mask in of for of in plan] for mask in every], bool).reshape(len(every), stretch + 1)
    tested = materialise(scan_text(items.where(F.col(item_id).isNotNull()), [item_id], item_text, _kernel(every, None, own), _DDL).withColumnRenamed(item_id, "item"), "items")
    # Items of equal tokens are searched once.
    unique = materialise(tested.groupBy("tokens").agg(F.min("item").alias("item"), F.first("hashes").alias("hashes"), F.first("places").alias("places")), "unique-items")
    exploded = lambda frame, *keep: frame.select(*keep, F.explode(F.arrays_zip("hashes", "places")).alias("w"))
    seeds = exploded(unique, "item").select("item", F.col("w.hashes").alias("hash"), F.col("w.places").alias("at"))
    present = {row[0] for row in unique.select(F.least(F.size("tokens"), F.lit(stretch))).distinct().collect()}
    used = tuple(mask for mask in every if any(mask in plan[length] for length in present))
    whole = tuple(all(length < least for length in present if mask in plan[length]) for mask in used)
    filter_bits = spark.sparkContext.broadcast(hash_filter(seeds, F.col("hash")))

    def kernel(batch: pa.RecordBatch) -> dict:
        return _kernel(used, filter_bits.value, whole=whole)(batch)

    found = scan_text(df.where(F.col(doc_id).isNotNull()), [doc_id], text, kernel, _DDL).withColumnRenamed(doc_id, "doc").where(F.size("hashes") > 0)
    # Repeated rows of one id stay apart by their tokens.
    hit = materialise(found.withColumn("row", F.xxhash64("doc", "tokens")), "hit-texts")
    places = exploded(hit, "doc", "row").select("doc", "row", F.col("w.hashes").alias("hash"), F.col("w.places").alias("place"))
    lines = places.join(seeds, "hash").select("doc", "row", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    pairs = (
        materialise(lines, "alignments")
        .join(hit.select("row", F.col("tokens").alias("doc_tokens")).dropDuplicates(["row"]), "row")
        .join(unique.select("item", F.col("tokens").alias("item_tokens")), "item")
        .select("doc", "item", "shift", "doc_tokens", "item_tokens")
    )
    types = f"doc {df.schema[doc_id].dataType.simpleString()}, item {items.schema[item_id].dataType.simpleString()}, share double"
    best = pairs.mapInArrow(_verify(stretch, share, least), types).where("share > 0").groupBy("doc", "item").agg(F.max("share").alias("share"))
    twins = tested.join(unique.select("tokens", F.col("item").alias("first")), "tokens").select("first", F.col("item").alias("twin")).distinct()
    pairs = best.join(twins, best["item"] == twins["first"]).select(F.col("doc").alias(doc_id), F.col("twin").alias(item_id), "share")
    return pairs.groupBy(doc_id, item_id).agg(F.max("share").alias("share"))
