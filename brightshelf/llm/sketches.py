"""MinHash near-duplicates by fast similarity sketching.

A sketch has a fixed number of coordinates. In round i every shingle is hashed to one coordinate
(from round `coordinates` on all go to coordinate i - coordinates, so that each one fills) with the
value i plus a hash; a coordinate keeps its smallest value and rounds end when all are filled.
Bands of coordinates give candidates and every link is confirmed on full shingle sets.

Texts with equal sets become one class first. Inside a band, members are compared with one pivot
and then with another; a large group of near copies costs about one comparison per member. Classes of
a band that still lie in different components meet where they share one of their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brightshelf.llm.components import connected
from brightshelf.llm.frames import hash_filter, in_filter, scan_text, text_buffer
from brightshelf.llm.words import NOT_SPACE, Hasher, mix, split, windows
from brightshelf.session import materialise

ROWS, BANDS = 6, 40  # a pair of similarity 0.8 shares no band with chance 5e-6
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text begins.

    A text with fewer than `size` words has its whole word sequence as its one shingle.
    """
    words = split(data, offsets, NOT_SPACE)
    hashes = hasher(data, words)
    shingles, text = windows(hashes, words, size)
    counts = words.counts()
    parts, texts = [shingles], [text]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            h = hashes[words.first[short]]
            for k in range(1, n):
                h = mix(h * np.uint64(0x2545F4914F6CDD1D) + hashes[words.first[short] + k])
            parts.append(mix(h + np.uint64(n)))
            texts.append(short)
    value, text = np.concatenate(parts), np.concatenate(texts)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    if len(value):
        fresh = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])]
        value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(len(offsets)))


def sketch(values: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of `coordinates` values per text; texts without shingles keep EMPTY."""
    n = len(first) - 1
    out = np.full(n * coordinates, EMPTY)
    text = np.repeat(np.arange(n), np.diff(first))
    open_rows = np.diff(first) > 0
    for i in range(2 * coordinates):
        use = open_rows[text]
        if not use.any():
            break
        h = mix(values[use] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        place = (h >> np.uint64(40)) % np.uint64(coordinates) if i < coordinates else np.full(len(h), i - coordinates, np.uint64)
        low = (np.uint64(i) << np.uint64(48)) | (mix(h) >> np.uint64(16))
        np.minimum.at(out, text[use] * coordinates + place.astype(np.int64), low)
        open_rows &= (out.reshape(n, coordinates) == EMPTY).any(axis=1)
    return out.reshape(n, coordinates)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))


def _features(size: int, rows: int, bands: int):
    def run(batch: pa.RecordBatch) -> dict:
        values, first = shingle_sets(*text_buffer(batch), size, Hasher())
        n = len(first) - 1
        keys = np.zeros((n, bands), np.uint64)
        drawn = sketch(values, first, rows * bands).reshape(n, bands, rows)
        for k in range(rows):
            keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + drawn[:, :, k])
        keys = keys + np.arange(bands, dtype=np.uint64)  # bands do not meet one another
        sums = [np.r_[np.uint64(0), np.cumsum(mix(values ^ np.uint64(seed)))] for seed in (11, 29)]
        prints = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
        full = np.diff(first) > 0
        kept = np.r_[0, np.cumsum(np.where(full, bands, 0))]
        return {
            "n_shingles": np.diff(first),
            "print_a": prints[0],
            "print_b": prints[1],
            "bands": _lists(keys[full].reshape(-1), kept),
        }

    return run


def _set_kernel(size: int):
    def run(batch: pa.RecordBatch) -> dict:
        return {"shingles": _lists(*shingle_sets(*text_buffer(batch), size, Hasher()))}

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b")
    )


def _near(a: Column, b: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


COMMON = (8, 128)


def _sharing_rare(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that share one of their rarest shingles.

    Sets as similar as asked for share one of the first n - ceil(percent * n / 100) + 1 shingles of any
    common order, so no link is lost. Commoner shingles come last: texts that have a common passage
    and nothing else in common do not meet. How common a shingle is is read from filters of fixed
    size; where they are wrong, the order is another one, and the result the same.
    """
    sets = materialise(sets.select("class", "component", "shingles"), "apart")
    counted = materialise(sets.select(F.explode("shingles").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON[0]), "common-shingles")
    spark = sets.sparkSession
    filters = spark.sparkContext.broadcast([hash_filter(counted.where(F.col("c") >= least), F.col("token")) for least in COMMON])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            values, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            start = np.r_[0, np.cumsum(n)]
            of = np.repeat(np.arange(len(n)), n)
            common = np.sum([in_filter(f, values) for f in filters.value], axis=0)
            order = np.lexsort((values, common, of))
            place = np.arange(len(order)) - start[of]
            take = place < (n - -(-percent * n // 100) + 1)[of]
            row = pa.array(of[take])
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[order][take]), batch.column("class").take(row), batch.column("component").take(row), pa.array(n[of[take]]), pa.array(place[take])],
                names=["token", "class", "component", "n", "place"],
            )

    kind = sets.schema["class"].dataType.simpleString()
    found = materialise(sets.mapInArrow(first, f"token bigint, class {kind}, component {kind}, n bigint, place bigint"), "rare-shingles")
    mixed = found.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    met = materialise(found.join(mixed, "token", "left_semi"), "met")
    x, y = met.alias("x"), met.alias("y")
    # Shingles before this one are not shared, so at most the rest of both sets is.
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    able = (100 + percent) * left >= percent * (F.col("x.n") + F.col("y.n"))
    return (
        x.join(y, F.col("x.token") == F.col("y.token"))
        .where((F.col("x.class") < F.col("y.class")) & (F.col("x.component") != F.col("y.component")) & _near(F.col("x.n"), F.col("y.n"), percent) & able)
        .select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    )


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """One row per row of `df`: `doc_id`, n_shingles, component_id, kept.

    Texts are linked when 100 * intersection >= percent * union of their sets of `size`-word
    shingles (A-Z folded). component_id is the smallest id that can be reached. Null and empty texts
    are linked with nothing. Rows that repeat an id share its component; a null id stays alone
    (component_id null, kept). Extra columns are not read.
    """
    features = materialise(
        scan_text(df, [doc_id], text, _features(size, rows, bands), "n_shingles bigint, print_a bigint, print_b bigint, bands array<bigint>").withColumnRenamed(doc_id, "id"),
        "sketches",
    )
    full = features.where("n_shingles > 0 and id is not null")
    classes = materialise(
        full.groupBy("print_a", "print_b").agg(F.min("id").alias("class"), F.min("n_shingles").alias("n"), F.min_by("bands", "id").alias("bands")), "classes"
    )
    # An id on rows with different texts ties their classes together.
    rows_of = full.select("id", "print_a", "print_b")
    same_id = rows_of.distinct().groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    members = classes.select(F.col("class"), "n", F.explode("bands").alias("band"))
    hubs = materialise(
        members.groupBy("band").agg(F.count("*").alias("c"), F.min("class").alias("pivot"), F.min_by("class", F.xxhash64("class", "band")).alias("other")).where("c > 1"),
        "buckets",
    )
    buckets = materialise(members.join(hubs, "band").select("band", "class", "n", "pivot", "other"), "members")
    sets = materialise(
        scan_text(
            df.join(buckets.select(F.col("class").alias(doc_id)).distinct(), doc_id, "left_semi"), [doc_id], text, _set_kernel(size), "shingles array<bigint>"
        ).select(F.col(doc_id).alias("class"), "shingles", F.xxhash64("shingles").alias("h")).dropDuplicates(["class", "h"]).drop("h"),
        "sets",
    )
    edges = materialise(
        rows_of.join(same_id, "id", "left_semi").join(classes.select("print_a", "print_b", "class"), ["print_a", "print_b"]).select(F.col("id").alias("a"), F.col("class").alias("b")),
        "links",
    )

    def add(edges: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        found = _confirmed(materialise(pairs.distinct(), f"{name}-pairs"), sets, percent)
        return materialise(edges.unionByName(found), name)

    def pairs(left: Column, right: Column) -> list[Column]:
        return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]

    edges = add(edges, buckets.where("class <> pivot").select(*pairs(F.col("class"), F.col("pivot"))), "pivots")
    # Second pivots; then classes of bands whose members are still apart meet by their rarest shingles.
    labelled = _labelled(buckets, connected(edges))
    second = labelled.select(F.col("class").alias("other"), F.col("component").alias("there")).distinct()
    apart = labelled.where("class <> other").join(second, "other").where("component <> there")
    edges = add(edges, apart.select(*pairs(F.col("class"), F.col("other"))), "second-pivots")
    labelled = materialise(_labelled(buckets, connected(edges)), "labelled")
    mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    apart = labelled.join(mixed, "band", "left_semi").select("class", "component").distinct()
    edges = add(edges, _sharing_rare(sets.join(apart, "class"), percent), "rest")
    components = connected(edges)
    of_class = materialise(
        classes.join(components, classes["class"] == components["node"], "left").select("print_a", "print_b", F.coalesce("component", "class").alias("component_id")), "of-class"
    )
    own = F.col("n_shingles") > 0
    joined = features.drop("bands").join(of_class, ["print_a", "print_b"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(own, F.coalesce("component_id", "id")).otherwise(F.col("id")))
    return joined.select(
        F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def _labelled(buckets: DataFrame, components: DataFrame) -> DataFrame:
    joined = buckets.join(components, buckets["class"] == components["node"], "left")
    return joined.select("band", "class", "n", "other", F.coalesce("component", "class").alias("component"))
