"""Periodic runs of words, by seeds on diagonals.

A run is a longest stretch of consecutive words with smallest period q that is at least four periods
and six words long. On diagonal q (word i against word i + q) it matches at least max(5, 3 * q) words
in a row, so lags are taken in classes [2^j, 2^(j+1)) whose k-grams (k = 3 * 2^j, or 5 for lag 1) are
short enough to lie in that match and at least one period long. Inside a run such a k-gram therefore comes
again exactly one period later and not before: neighbouring occurrences are all the pairs a class
needs, at most one per word. A seed is extended both ways on its diagonal; how far each lag of a
text is covered already is kept in a table, and seeds inside are not extended again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from brightshelf.llm.frames import TEXT, bounded, text_buffer
from brightshelf.llm.words import NOT_SPACE, Hasher, Words, mix, split

LEAST_WORDS, LEAST_PERIODS = 6, 4
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


class Windows:
    """Hash of any run of words in O(1), from running sums of word hashes times powers of a base."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        up = np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), np.uint64(_BASE))])
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), np.uint64(pow(_BASE, -1, 1 << 64)))])
        self.sums = np.r_[np.uint64(0), np.cumsum(tokens * up[:n])]

    def __call__(self, at: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at])


def _seeds(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of neighbouring occurrences of the k-grams of every class."""
    lengths = np.diff(first)
    text = np.repeat(np.arange(len(lengths)), lengths)
    end = first[1:][text]
    window = Windows(tokens)
    salt = mix(text.astype(np.uint64) + np.uint64(1))
    places, lags = [], []
    at, low = np.flatnonzero(lengths[text] >= LEAST_WORDS), 1
    while len(at):
        k = LEAST_WORDS - 1 if low == 1 else 3 * low
        at = at[(at + k <= end[at]) & (lengths[text[at]] >= LEAST_PERIODS * low)]
        if not len(at):
            break
        key = window(at, k) ^ salt[at]
        order = np.argsort(key, kind="stable")  # places stay in order among equal keys
        key, place = key[order], at[order]
        same = key[1:] == key[:-1]
        lag = place[1:] - place[:-1]
        found = same & (lag >= low) & (lag < 2 * low) & (text[place[1:]] == text[place[:-1]])
        places.append(place[:-1][found])
        lags.append(lag[found])
        # Where a longer k-gram comes again, so does this one at its beginning.
        at = np.sort(place[np.r_[same, False] | np.r_[False, same]])
        low *= 2
    return (np.concatenate(places), np.concatenate(lags)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _matched(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning, looked at in pieces of growing size."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        differ = np.flatnonzero(x[at : min(n, at + step)] != y[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def find(tokens: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of all texts, by start, then period; starts count through the block."""
    places, lags = _seeds(tokens, first)
    text = np.searchsorted(first, places, "right") - 1
    order = np.lexsort((places, lags, text))
    places, lags, text = places[order], lags[order], text[order]
    # A seed one word after one of the same lag lies in the same match.
    fresh = np.ones(len(places), bool)
    fresh[1:] = (places[1:] != places[:-1] + 1) | (lags[1:] != lags[:-1]) | (text[1:] != text[:-1])
    covered: dict[tuple[int, int], int] = {}
    out = []
    for i, q, t in zip(places[fresh].tolist(), lags[fresh].tolist(), text[fresh].tolist()):
        if i < covered.get((t, q), -1):
            continue
        lo, hi = int(first[t]), int(first[t + 1])
        a = i - _matched(tokens[lo:i][::-1], tokens[lo + q : i + q][::-1])
        b = i + _matched(tokens[i : hi - q], tokens[i + q : hi])
        covered[t, q] = b
        if b - a + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
            out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _joined(data: np.ndarray, words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of every text, one blank between them."""
    start, end = words.start[kept], words.end[kept]
    first = np.r_[0, np.cumsum(kept)][words.first]
    size = end - start + 1  # with the blank behind
    to = np.r_[0, np.cumsum(size)]
    source = np.repeat(start - to[:-1], size) + np.arange(to[-1])
    blank = to[1:] - 1
    out = data[np.minimum(source, max(len(data) - 1, 0))] if len(source) else np.zeros(0, np.uint8)
    out[blank] = 0x20
    keep = np.ones(len(out), bool)
    filled = first[1:] > first[:-1]
    keep[to[first[1:][filled]] - 1] = False  # no blank behind the last word
    offsets = to[first] - np.r_[0, np.cumsum(filled)]
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[keep]))])


def _scan(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, pa.Array]:
    data, offsets = text_buffer(batch)
    words = split(data, offsets, NOT_SPACE)
    runs = find(Hasher(fold=False)(data, words), words.first)
    start, length, period = np.array(runs, np.int64).reshape(-1, 3).T
    text = np.searchsorted(words.first, start, "right") - 1
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge)[:-1] == 0
    fields = pa.StructArray.from_arrays([pa.array(start - words.first[text]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    bounds = np.searchsorted(text, np.arange(len(words.first)))
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), fields)
    return pa.array(words.counts()), lists, _joined(data, words, kept)


def find_runs(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per row of `df`: the `keep` columns, n_words, runs, collapsed.

    `runs` lists start (word number), length and smallest period of every run, by start, then
    period. `collapsed` is the text without the repeats: words that a run holds after its first
    period go, the others are joined by one blank. Null and empty texts have no words, no runs and an
    empty `collapsed`; repeated rows are judged each for itself; an empty table gives no rows. Other
    columns are not read; a `keep` column named like an output is a ValueError. Words are
    compared by 64-bit hashes of their bytes.
    """
    added = T._parse_datatype_string("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    clash = set(keep) & {f.name for f in added.fields}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are named like results; rename them first")
    source = df.select(*keep, df[text].cast("string").cast("binary").alias(TEXT))
    schema = T.StructType([*[source.schema[k] for k in keep], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                n_words, runs, collapsed = _scan(part)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], n_words, runs, collapsed.cast(pa.string())], names=[*keep, *added.names])

    return source.mapInArrow(run, schema)
