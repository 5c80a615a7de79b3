"""Selections and listings over entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def by_external_id(df: DataFrame, column: str, external: Column | str) -> DataFrame:
    """Rows whose id equals an external id made of digits only; anything else finds nothing."""
    text = F.lit(external) if isinstance(external, str) else external
    return df.where(text.rlike("^[0-9]+$") & (F.col(column) == text.try_cast("bigint")))


def by_ids(df: DataFrame, column: str, ids: list | DataFrame) -> DataFrame:
    """Rows whose id is in a list (pushed to the scan) or in a table (semi join)."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(column).isin(list(ids)) if ids else F.lit(False))


def first_matching(df: DataFrame, column: str, value, order: str, limit: int) -> DataFrame:
    """First `limit` rows with column = value, in id order."""
    return df.where(F.col(column) == value).orderBy(order).limit(limit)


def contains_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows where any column contains the text, ignoring case; % and _ in it stay wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{text}%")
    return df.where(hit)


def first_entities(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The first `limit` distinct ids."""
    return df.select(column).distinct().orderBy(column).limit(limit)


def top_products_by_interactions(events: DataFrame, products: DataFrame, limit: int) -> DataFrame:
    """Most interacted products: counted before the join, so the join sees one row per product."""
    counts = events.groupBy("item_id").agg(F.count("*").alias("interactions"))
    return (
        counts.join(products, "item_id")
        .select("item_id", "name", "category", "interactions")
        .orderBy(F.desc("interactions"), "item_id")
        .limit(limit)
    )


def active_users_since(users: DataFrame, events: DataFrame, since: Column) -> DataFrame:
    """Users with an event at or after a time; each user once, without a distinct."""
    recent = events.where(F.col("ts") >= since).select("user_id")
    return users.join(recent, "user_id", "left_semi")


def normalise_events(raw: DataFrame, now: Column) -> DataFrame:
    """Fill missing times, give a stable id, text ids, and empty objects for missing JSON."""
    ts = F.coalesce(F.col("ts"), now)
    user, item = F.col("user_id").cast("string"), F.col("item_id").cast("string")
    stable = F.sha2(F.concat_ws("|", user, item, "event_type", F.unix_micros(ts).cast("string")), 256)
    return raw.select(
        F.coalesce(F.col("event_id").cast("string"), stable).alias("event_id"),
        user.alias("user_id"),
        item.alias("product_id"),
        "event_type",
        ts.alias("ts"),
        F.coalesce(F.col("context"), F.lit("{}")).alias("context"),
        F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"),
    )


def transactions(events: DataFrame, users: DataFrame, products: DataFrame, discount: Column) -> DataFrame:
    """Purchases joined to user and product, with total, discount and final amounts.

    Expects `quantity` (default 1) on the events; `discount` is a fraction of the total.
    """
    enriched = (
        events.join(users.select("user_id", "location"), "user_id")
        .join(products.select("item_id", F.col("price").alias("unit_price"), "category"), "item_id")
        .withColumn("quantity", F.coalesce(F.col("quantity"), F.lit(1.0)))
        .withColumn("total_amount", F.col("unit_price") * F.col("quantity"))
        .withColumn("discount_amount", F.round(F.col("total_amount") * discount, 2))
    )
    return enriched.withColumn(
        "final_amount", F.round(F.col("total_amount") - F.col("discount_amount"), 2)
    )


def recommendation_stats(recommendations: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """Total (of one experiment, if named) and counts per (experiment, model) in one pass.

    The breakdown covers all experiments even when the total is for one.
    """
    model = F.coalesce(F.col("model_version"), F.lit("none"))
    counted = F.lit(True) if experiment_id is None else F.col("experiment_id").eqNullSafe(experiment_id)
    base = recommendations.select(F.col("experiment_id"), model.alias("model_version"), counted.alias("_in"))
    grouped = base.groupingSets([["experiment_id", "model_version"], []], "experiment_id", "model_version").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("_all"), F.count(F.when(F.col("_in"), 1)).alias("_some")
    )
    return grouped.select(
        F.when(F.col("_g") == 0, "breakdown").otherwise("total").alias("kind"),
        "experiment_id",
        "model_version",
        F.when(F.col("_g") == 0, F.col("_all")).otherwise(F.col("_some")).alias("recommendations"),
    )
