"""User and product features, popularity and interaction weights."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from brightshelf.functions.scalar import count_when, days_between, safe_divide
from brightshelf.session import small_side
from brightshelf.sources.schemas import EVENT_TYPE_WEIGHTS, EVENT_TYPES

PROFILE_VECTOR = [
    "total_views",
    "total_clicks",
    "total_purchases",
    "total_interactions",
    "days_since_last_interaction",
    "view_to_click_ratio",
    "purchase_rate",
]


def max_ts(df: DataFrame, ts: str = "ts") -> Column:
    """Latest time in the table as a scalar subquery."""
    return df.agg(F.max(ts).alias("as_of")).scalar()


def time_slice(df: DataFrame, window_days: int, end: Column | None = None) -> DataFrame:
    """Rows of the last `window_days` days up to `end` (default: latest row), both ends included."""
    end = max_ts(df) if end is None else end
    return df.where((F.col("ts") <= end) & (F.col("ts") >= end - F.expr(f"INTERVAL {window_days} DAYS")))


def user_spend_features(events: DataFrame) -> DataFrame:
    """Last event time, counts by type and money spent, per user."""
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(
        F.max("ts").alias("last_event_ts"),
        count_when(kind == "view").alias("total_views"),
        count_when(kind == "click").alias("total_clicks"),
        count_when(kind == "purchase").alias("total_purchases"),
        F.sum(F.when(kind == "purchase", F.col("value")).otherwise(F.lit(0.0))).alias("total_spent"),
    )


def product_window_features(
    events: DataFrame,
    window_days: int = 30,
    end: Column | None = None,
    keys: tuple[str, ...] = ("item_id",),
) -> DataFrame:
    """Lifetime and window counts of all event types with rates, in one pass per product."""
    end = max_ts(events) if end is None else end
    kind = F.col("event_type")
    history = events.where(F.col("ts") <= end).withColumn(
        "_recent", F.col("ts") >= end - F.expr(f"INTERVAL {window_days} DAYS")
    )
    w = f"last_{window_days}d"
    counted = history.groupBy(*keys).agg(
        *[count_when(kind == t).alias(f"total_{t}") for t in EVENT_TYPES],
        *[count_when((kind == t) & F.col("_recent")).alias(f"{t}_{w}") for t in EVENT_TYPES],
        F.max("ts").alias("_last"),
        F.max(end).alias("_end"),
        F.count("*").alias("total_interactions"),
        count_when(F.col("_recent")).alias(f"interactions_{w}"),
    )
    views = F.col("total_view")
    age = F.floor(days_between(F.col("_end"), F.col("_last"))).cast("bigint")
    return counted.select(
        *keys,
        *[f"total_{t}" for t in EVENT_TYPES],
        *[f"{t}_{w}" for t in EVENT_TYPES],
        safe_divide(F.col("total_click"), views).alias("click_through_rate"),
        safe_divide(F.col("total_purchase"), views).alias("conversion_rate"),
        safe_divide(F.col("total_add_to_cart"), views).alias("add_to_cart_rate"),
        F.greatest(age, F.lit(0).cast("bigint")).alias("days_since_last_interaction"),
        "total_interactions",
        f"interactions_{w}",
        safe_divide(F.col(f"interactions_{w}"), F.col("total_interactions")).alias(
            f"interaction_ratio_{w}"
        ),
    )


def product_features_by_source(events: DataFrame, source: str, window_days: int = 30) -> DataFrame:
    """Product features of many input files in one job; each source has its own end date."""
    ends = events.groupBy(source).agg(F.max("ts").alias("source_end"))
    dated = events.join(small_side(ends, "source-ends"), source)
    return product_window_features(dated, window_days, F.col("source_end"), keys=(source, "item_id"))


def profile(events: DataFrame, key: str, as_of: Column | None = None) -> DataFrame:
    """Counts, recency and ratios per user or per product, as of a given time."""
    as_of = max_ts(events) if as_of is None else as_of
    kind = F.col("event_type")
    counted = events.groupBy(key).agg(
        count_when(kind == "view").alias("total_views"),
        count_when(kind == "click").alias("total_clicks"),
        count_when(kind == "purchase").alias("total_purchases"),
        F.count("*").alias("total_interactions"),
        F.max("ts").alias("last_interaction_timestamp"),
    )
    return counted.select(
        "*",
        days_between(as_of, F.col("last_interaction_timestamp")).alias("days_since_last_interaction"),
        # clicks per view; the published column name says the opposite
        safe_divide(F.col("total_clicks"), F.col("total_views")).alias("view_to_click_ratio"),
        safe_divide(F.col("total_purchases"), F.col("total_interactions")).alias("purchase_rate"),
    )


def with_default_profile(spine: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Every entity of the spine; unknown ones get zeros and null times."""
    zeros = ["total_views", "total_clicks", "total_purchases", "total_interactions",
             "view_to_click_ratio", "purchase_rate"]
    return spine.select(key).join(profiles, key, "left").fillna(0, subset=zeros)


def profile_vector(profiles: DataFrame, key: str) -> DataFrame:
    """The seven profile features in model order; nulls become 0."""
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in PROFILE_VECTOR]
    return profiles.select(key, F.array(*parts).cast("array<float>").alias("features"))


def event_weight(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*EVENT_TYPE_WEIGHTS.items())])
    return F.coalesce(F.element_at(table, kind), F.lit(1.0))


def decayed_popularity(
    events: DataFrame, half_life_days: float = 30.0, as_of: Column | None = None, keys: tuple = ("item_id",)
) -> DataFrame:
    """Sum of event weights halved every `half_life_days`, per item."""
    as_of = max_ts(events) if as_of is None else as_of
    age = days_between(as_of, F.col("ts"))
    weight = F.exp(-F.log(F.lit(2.0)) / F.lit(float(half_life_days)) * age) * event_weight(F.col("event_type"))
    return events.groupBy(*keys).agg(F.sum(weight).alias("score"))


def count_popularity(profiles: DataFrame) -> DataFrame:
    """views + 2 clicks + 3 purchases."""
    score = F.col("total_views") + 2 * F.col("total_clicks") + 3 * F.col("total_purchases")
    return profiles.select("item_id", score.cast("double").alias("score"))


def interaction_strength(events: DataFrame) -> DataFrame:
    """Implicit strength per (user, item): view 1, click 2, purchase 3; other events carry none."""
    kind = F.col("event_type")
    weight = F.when(kind == "purchase", 3.0).when(kind == "click", 2.0).when(kind == "view", 1.0)
    return (
        events.withColumn("_w", weight)
        .where(F.col("_w").isNotNull())
        .groupBy("user_id", "item_id")
        .agg(F.sum("_w").alias("weight"))
    )


def history(events: DataFrame) -> DataFrame:
    """Distinct (user, item) pairs: the long form of every user's history."""
    return events.select("user_id", "item_id").distinct()


def extended_features(events: DataFrame, products: DataFrame) -> DataFrame:
    """Last time per event type, mean purchase value and stock, for every product."""
    kind = F.col("event_type")
    seen = events.groupBy("item_id").agg(
        *[F.max(F.when(kind == t, F.col("ts"))).alias(f"last_{t}_ts") for t in ("view", "click", "purchase")],
        F.avg(F.when(kind == "purchase", F.col("value"))).alias("avg_purchase_value"),
    )
    return products.select("item_id", F.col("inventory").alias("stock_level")).join(seen, "item_id", "left")
