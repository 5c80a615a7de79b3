"""Filters on ranked recommendations (user_id, item_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _reranked(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("rank", "item_id")
    return df.withColumn("rank", F.row_number().over(w).cast("bigint"))


def drop_duplicates(recs: DataFrame) -> DataFrame:
    """Keep the best ranked copy of each item per user."""
    best = recs.groupBy("user_id", "item_id").agg(F.min_by(F.struct("score", "rank"), "rank").alias("_b"))
    return best.select("user_id", "item_id", "_b.score", "_b.rank")


def drop_recently_purchased(
    recs: DataFrame, events: DataFrame, as_of: Column, window_seconds: int = 86_400
) -> DataFrame:
    """Remove items the user bought within the window before `as_of`."""
    recent = events.where(
        (F.col("event_type") == "purchase")
        & (F.col("ts") >= as_of - F.expr(f"INTERVAL {window_seconds} SECONDS"))
        & (F.col("ts") <= as_of)
    ).select("user_id", "item_id")
    return _reranked(recs.join(recent, ["user_id", "item_id"], "left_anti"))


def drop_unavailable(recs: DataFrame, products: DataFrame, min_inventory: int = 1) -> DataFrame:
    """Keep items that exist in the catalogue and are in stock."""
    available = products.where(F.col("inventory") >= min_inventory).select("item_id")
    return _reranked(recs.join(available, "item_id", "left_semi"))


def limit_per_category(recs: DataFrame, products: DataFrame, per_category: int = 2) -> DataFrame:
    """At most n items of one category per user; the rest move up.

    Items without a product row form one group of their own; `drop_unavailable` removes them.
    """
    with_category = recs.join(products.select("item_id", "category"), "item_id", "left")
    w = Window.partitionBy("user_id", "category").orderBy("rank", "item_id")
    kept = with_category.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_category)
    return _reranked(kept.drop("_n"))
