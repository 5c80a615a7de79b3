"""Order statistics that never sort one whole group in one task.

A running total over an ordered column is taken in two levels: rows are cut into
buckets along the order, each bucket is summed on its own, and the few bucket
totals are accumulated. Every exact rank, quantile, AUC, KS, Gini and split here
rests on `prefix_sums`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

MIN_BUCKETS, MAX_BUCKETS = 32, 4_096
FINE = 64


def bucket_count(df: DataFrame) -> int:
    """Buckets to spread an order over: four per shuffle partition, within fixed bounds."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BUCKETS, min(MAX_BUCKETS, 4 * partitions))


def cut_points(df: DataFrame, column: str) -> list[float]:
    """Values that split `column` into about equal shares; at most MAX_BUCKETS numbers reach the driver.

    They are read once and become literals, so every use of a bucket agrees with every
    other, also after a lost task. How well they balance never changes a result.
    """
    n = bucket_count(df)
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(F.col(column).cast("double"), probs, 10 * n).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def _search(column: Column, cuts: list[float], passed: int = 0) -> Column:
    """Binary search as nested conditions: about log2(n) comparisons per row, never null."""
    if not cuts:
        return F.lit(passed)
    mid = len(cuts) // 2
    return F.when(column >= F.lit(cuts[mid]), _search(column, cuts[mid + 1 :], passed + mid + 1)).otherwise(
        _search(column, cuts[:mid], passed)
    )


def bucket_of(column: Column, cuts: list[float]) -> Column:
    """How many cut points are <= the value: a monotone bucket number.

    Up to FINE cut points become one search tree inside codegen; more are looked up in two
    steps, a coarse search and then the short list of that range.
    """
    if len(cuts) <= FINE:
        return _search(column, cuts)
    step = -(-len(cuts) // FINE)
    ranges = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = _search(column, [r[0] for r in ranges[1:]])
    fine = F.element_at(F.array(*[F.array(*[F.lit(c) for c in r]) for r in ranges]), coarse + 1)
    return coarse * step + F.size(F.filter(fine, lambda c: c <= column))


def hash_bucket(word: Column, df: DataFrame) -> Column:
    """Monotone bucket of a 32-bit hash word."""
    return F.floor(word / F.lit(4294967296.0 / bucket_count(df)))


def prefix_sums(
    df: DataFrame,
    order: list[Column],
    sums: dict[str, Column],
    bucket: Column,
    keys: list[str] | None = None,
) -> DataFrame:
    """Add inclusive running sums along `order` within `keys`, and each sum over the whole key
    as `<name>_total`.

    `bucket` must be monotone in the first order column; it decides how the work is
    spread, never the result. `order` must be unique within `keys`.
    """
    # One struct for all keys: it is never null, so a plain equality keeps rows with null
    # keys, and the join reuses the partitioning of the window.
    group = ["_group"] if keys else []
    rows = df.withColumn("_bucket", bucket)
    if keys:
        rows = rows.withColumn("_group", F.struct(*keys))
    for name, value in sums.items():
        rows = rows.withColumn(f"_v_{name}", value)
    totals = rows.groupBy(*group, "_bucket").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums],
        *[F.sum(f"_t_{name}").over(Window.partitionBy(*group)).alias(f"{name}_total") for name in sums],
    )
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(inside))
    if not keys:
        # One row per bucket: at most MAX_BUCKETS + 1, however large the input is.
        offsets = F.broadcast(offsets)
    out = local.join(offsets, [*group, "_bucket"])
    return out.select(
        *df.columns,
        *[(F.col(f"_l_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums],
        *[f"{name}_total" for name in sums],
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: list[str] | None = None
) -> DataFrame:
    """Interpolated exact quantiles of `value` per key, plus the row count `n`."""
    keys = list(keys or [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    cuts = cut_points(df, value)
    cum = prefix_sums(
        counts, [F.col(value)], {"_cum": F.col("_c")}, bucket_of(F.col(value), cuts), keys
    )
    sized = cum.withColumnRenamed("_cum_total", "n")
    found = sized.groupBy(*keys, "n").agg(
        *[
            F.min(F.when(F.col("_cum") > bound(q), F.col(value))).alias(f"_{side}_{name}")
            for name, q in probs.items()
            for side, bound in (
                ("lo", lambda q: F.floor(F.lit(q) * (F.col("n") - 1))),
                ("hi", lambda q: F.ceil(F.lit(q) * (F.col("n") - 1))),
            )
        ]
    )

    def interpolated(name: str, q: float) -> Column:
        position = F.lit(q) * (F.col("n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return low + (high - low) * (position - F.floor(position))

    return found.select(*keys, "n", *[interpolated(name, q).alias(name) for name, q in probs.items()])


def contiguous_index(df: DataFrame, column: str, name: str = "index") -> DataFrame:
    """Distinct values of a numeric id column numbered 0.. in ascending order."""
    ids = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = prefix_sums(ids, [F.col(column)], {"_rank": F.lit(1)}, bucket_of(F.col(column), cut_points(df, column)))
    return ranked.select(column, (F.col("_rank") - 1).cast("bigint").alias(name))
