"""Packing into optimal length buckets.

The histogram of sequence lengths over all texts (at most `longest` rows) goes to a dynamic program
that picks the bucket boundaries with the least padding. Inside a bucket, sequences are numbered and
cut into batches of one token budget.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from brightshelf.llm.frames import scan_text, text_buffer
from brightshelf.llm.words import NOT_SPACE, split
from brightshelf.session import materialise

LONGEST, BUCKETS, BUDGET = 2048, 16, 65536
RUN_ROWS = 20_000  # sequences numbered by one task at a time


def boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets over lengths 1..len(counts) with the least padding.

    counts[i] is the number of sequences of length i + 1. Among equal costs fewer buckets, then
    smaller bounds win.
    """
    lengths = np.flatnonzero(counts) + 1
    if not len(lengths):
        return []
    rows = np.r_[0, np.cumsum(counts[lengths - 1])].astype(np.float64)
    tokens = np.r_[0, np.cumsum(counts[lengths - 1] * lengths)].astype(np.float64)
    n = len(lengths)
    cost = np.r_[0.0, np.full(n, np.inf)]
    chosen: list[np.ndarray] = []
    history = []
    for _ in range(min(buckets, n)):
        new, source = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            options = cost[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            source[j] = int(options.argmin())
            new[j] = options[source[j]]
        cost = new
        chosen.append(source)
        history.append(cost[n])
    out, at = [], n
    for source in reversed(chosen[: int(np.argmin(history)) + 1]):
        out.append(int(lengths[at - 1]))
        at = int(source[at])
    return out[::-1]


def _counted(batch: pa.RecordBatch) -> dict:
    data, offsets = text_buffer(batch)
    return {"n_tokens": split(data, offsets, NOT_SPACE).counts() + 1}


def token_lengths(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and n_tokens: words of the whole text and one end mark."""
    return scan_text(df, keep, text, _counted, "n_tokens bigint")


def pack(lengths: DataFrame, doc_id: str = "doc_id", n_tokens: str = "n_tokens", longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per sequence: doc_id, segment, n_tokens, padded_to, batch, place (in its batch).

    A text longer than `longest` becomes several sequences, so no token is lost; null lengths count
    as 0 and get no row. A batch holds budget // padded_to sequences of one bucket (one at least),
    numbered by a hash of the id; only the last batch of a bucket may be smaller.
    """
    if longest < 1 or buckets < 1:
        raise ValueError("longest and buckets must be positive")
    spark = lengths.sparkSession
    size = F.col(n_tokens).cast("bigint")
    pieces = lengths.where(size > 0).select(
        F.col(doc_id).alias("doc_id"), size.alias("whole"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / longest).cast("bigint"))).alias("segment")
    )
    stored = materialise(pieces.withColumn("n_tokens", F.least(F.lit(longest), F.col("whole") - F.col("segment") * longest)).drop("whole"), "sequences")
    histogram = stored.groupBy("n_tokens").count().toArrow()
    counts = np.zeros(longest, np.int64)
    counts[histogram["n_tokens"].to_numpy() - 1] = histogram["count"].to_numpy()
    bounds = boundaries(counts, buckets)
    if not bounds:
        return stored.select("doc_id", "segment", "n_tokens", *[F.lit(0).cast("bigint").alias(c) for c in ("padded_to", "batch", "place")])
    # Every bucket is cut into runs by a hash, numbered run by run behind the totals of earlier runs.
    runs = int(counts.sum()) // RUN_ROWS + 1
    row = F.struct(F.xxhash64("doc_id", "segment").alias("h"), "doc_id", "segment")
    placed = stored.select("doc_id", "segment", "n_tokens", _bound(F.col("n_tokens"), bounds).alias("padded_to")).withColumn("run", F.pmod(F.xxhash64("segment", "doc_id"), F.lit(runs)))
    placed = materialise(placed, "placed")
    before = Window.partitionBy("padded_to").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("padded_to", "run").count().select("padded_to", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy("padded_to", "run").orderBy(row)) - 1)
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_to")))
    at = F.col("n") + F.col("skip")
    joined = numbered.join(totals, ["padded_to", "run"])
    return joined.select(
        "doc_id", "segment", "n_tokens", "padded_to", F.floor(at / capacity).cast("bigint").alias("batch"), F.pmod(at, capacity).cast("bigint").alias("place")
    )


def _bound(length: Column, bounds: list[int]) -> Column:
    """The smallest bound that holds the length."""
    out = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        out = F.when(length <= b, b).otherwise(out)
    return out.cast(T.LongType())
