"""Top-k, ranking and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightshelf.operators.ordered import bucket_of, cut_points, prefix_sums

KEY = "_score_key"


def _keyed(df: DataFrame, score: str, ties: tuple) -> tuple[DataFrame, list]:
    """The one ordering of ranked lists: score (9 digits) descending, then ids ascending.

    The rounded score (as a whole number of 1e-9 units) is a column of its own, so the sort
    compares stored values instead of rounding both sides of every comparison.
    """
    return df.withColumn(KEY, F.rint(F.col(score) * 1e9)), [F.col(KEY).desc(), *[F.col(t).asc() for t in ties]]


def top_k(df: DataFrame, k: int, partition: list[str], score: str = "score", ties: tuple = ("item_id",)) -> DataFrame:
    """Best k rows per partition with a 1-based `rank`.

    The rank filter lets Spark keep only k rows per key before the shuffle, so a hot
    key never arrives whole in one task.
    """
    keyed, order = _keyed(df, score, ties)
    w = Window.partitionBy(*partition).orderBy(*order)
    return (
        keyed.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
        .drop(KEY)
    )


def newest_k(df: DataFrame, k: int, partition: list[str], ts: str, tie: str) -> DataFrame:
    """Newest k rows per partition, newest first."""
    w = Window.partitionBy(*partition).orderBy(F.col(ts).desc(), F.col(tie).asc())
    return (
        df.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def global_top_k(df: DataFrame, k: int, score: str = "score", ties: tuple = ("item_id",)) -> DataFrame:
    """Best k rows of the whole table, with a 1-based `rank`; k is a report size."""
    keyed, order = _keyed(df, score, ties)
    best = keyed.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).drop(KEY)


def bounded_list(df: DataFrame, columns: list[str]) -> Column:
    """A top-k table (k rows) as one array value, to be exploded next to other rows.

    Use only on the output of `global_top_k`; the array has k entries.
    """
    return df.agg(F.array_sort(F.collect_list(F.struct(*columns)))).scalar()


def rank_lists(df: DataFrame, partition: list[str], score: str = "score", ties: tuple = ("item_id",)) -> DataFrame:
    """Rank every row of each given list, however long a list is.

    Nothing can be cut off here, so the ranks are taken in two levels instead of sorting a
    whole list in one task.
    """
    keyed = df.withColumn(KEY, -F.rint(F.col(score) * 1e9))
    bucket = bucket_of(F.col(KEY), cut_points(keyed, KEY))
    ranked = prefix_sums(keyed, [F.col(KEY), *[F.col(t) for t in ties]], {"rank": F.lit(1)}, bucket, partition)
    return ranked.select(*df.columns, F.col("rank").cast("bigint").alias("rank"))
