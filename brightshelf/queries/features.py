"""A, F9-F11, J10-J12: features, popularity and feature retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightshelf.functions.scalar import md5_fraction, rounded
from brightshelf.operators import asof, features as feat, lookups
from brightshelf.queries.base import (
    INTERACTIONS, PRODUCTS, USERS, days, iso, query, r6, ratio, with_, word,
)
from brightshelf.sources import bindings as b
from brightshelf.sources.schemas import EVENT_TYPES

COUNTS = """count(*) FILTER (event_type = 'view') AS total_views,
       count(*) FILTER (event_type = 'click') AS total_clicks,
       count(*) FILTER (event_type = 'purchase') AS total_purchases"""


def text_ts(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query("a1_user_features", f"""
SELECT user_id, {iso('max(ts)')} AS last_event_ts, {COUNTS},
       {r6("sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END)")} AS total_spent
FROM events GROUP BY user_id""")
def _a1(spark, sf):
    out = feat.user_spend_features(b.interactions(spark, sf))
    return out.withColumn("last_event_ts", text_ts("last_event_ts")).withColumn(
        "total_spent", rounded("total_spent")
    )


_A2 = with_(INTERACTIONS, "e AS (SELECT max(ts) AS e FROM interactions)") + f"""
SELECT item_id,
  {", ".join(f"count(*) FILTER (event_type = '{t}') AS total_{t}" for t in EVENT_TYPES)},
  {", ".join(f"count(*) FILTER (event_type = '{t}' AND ts >= e - INTERVAL 7 DAY) AS {t}_last_7d" for t in EVENT_TYPES)},
  {r6(ratio("count(*) FILTER (event_type = 'click')", "count(*) FILTER (event_type = 'view')"))} AS click_through_rate,
  {r6(ratio("count(*) FILTER (event_type = 'purchase')", "count(*) FILTER (event_type = 'view')"))} AS conversion_rate,
  {r6(ratio("count(*) FILTER (event_type = 'add_to_cart')", "count(*) FILTER (event_type = 'view')"))} AS add_to_cart_rate,
  CAST(greatest(floor({days('max(e)', 'max(ts)')}), 0) AS BIGINT) AS days_since_last_interaction,
  count(*) AS total_interactions,
  count(*) FILTER (ts >= e - INTERVAL 7 DAY) AS interactions_last_7d,
  {r6(ratio("count(*) FILTER (ts >= e - INTERVAL 7 DAY)", "count(*)"))} AS interaction_ratio_last_7d
FROM interactions CROSS JOIN e GROUP BY item_id"""


@query("a2_product_features", _A2)
def _a2(spark, sf):
    out = feat.product_window_features(b.interactions(spark, sf), window_days=7)
    for c in ("click_through_rate", "conversion_rate", "add_to_cart_rate", "interaction_ratio_last_7d"):
        out = out.withColumn(c, rounded(c))
    return out


def profile_sql(key: str, source: str = "interactions", r6=r6) -> str:
    return f"""
SELECT {key}, total_views, total_clicks, total_purchases, total_interactions,
       {iso('last_ts')} AS last_interaction_timestamp,
       {r6(days('(SELECT max(ts) FROM interactions)', 'last_ts'))} AS days_since_last_interaction,
       {r6(ratio('total_clicks', 'total_views'))} AS view_to_click_ratio,
       {r6(ratio('total_purchases', 'total_interactions'))} AS purchase_rate
FROM (SELECT {key}, {COUNTS}, count(*) AS total_interactions, max(ts) AS last_ts
      FROM {source} GROUP BY {key})"""


def _show_profile(df):
    df = df.withColumn("last_interaction_timestamp", text_ts("last_interaction_timestamp"))
    for c in ("days_since_last_interaction", "view_to_click_ratio", "purchase_rate"):
        df = df.withColumn(c, rounded(c))
    return df


@query("a3_user_profile", with_(INTERACTIONS) + profile_sql("user_id"))
def _a3(spark, sf):
    return _show_profile(feat.profile(b.interactions(spark, sf), "user_id"))


@query("a4_product_profile", with_(INTERACTIONS) + profile_sql("item_id"))
def _a4(spark, sf):
    return _show_profile(feat.profile(b.interactions(spark, sf), "item_id"))


def decay_sql(half_life: float = 30.0, as_of: str = "(SELECT max(ts) FROM interactions)") -> str:
    weight = """CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'add_to_cart' THEN 2.0 WHEN 'view' THEN 1.0
      WHEN 'click' THEN 1.5 WHEN 'like' THEN 1.0 WHEN 'wishlist' THEN 1.0 WHEN 'search' THEN 0.5
      WHEN 'impression' THEN 0.1 ELSE 1.0 END"""
    return f"sum(exp(-ln(2.0) / {float(half_life)} * {days(as_of, 'ts')}) * CAST({weight} AS DOUBLE))"


@query("a5_decayed_popularity", with_(INTERACTIONS) + f"""
SELECT item_id, {r6(decay_sql())} AS score FROM interactions GROUP BY item_id""")
def _a5(spark, sf):
    return feat.decayed_popularity(b.interactions(spark, sf)).withColumn("score", rounded("score"))


@query("a6_count_popularity", with_(INTERACTIONS) + """
SELECT item_id, CAST(count(*) FILTER (event_type = 'view') + 2 * count(*) FILTER (event_type = 'click')
       + 3 * count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS score
FROM interactions GROUP BY item_id""")
def _a6(spark, sf):
    return feat.count_popularity(feat.profile(b.interactions(spark, sf), "item_id"))


@query("a7_interaction_strength", with_(INTERACTIONS) + """
SELECT user_id, item_id, CAST(sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) AS DOUBLE) AS weight
FROM interactions WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id, item_id""")
def _a7(spark, sf):
    return feat.interaction_strength(b.interactions(spark, sf))


@query("a8_distinct_pairs", with_(INTERACTIONS) + """
SELECT count(*) AS pairs, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items
FROM (SELECT DISTINCT user_id, item_id FROM interactions)""")
def _a8(spark, sf):
    return feat.history(b.interactions(spark, sf)).agg(
        F.count("*").alias("pairs"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("item_id").alias("items"),
    )


def recommendation_log(spark, sf):
    """Order headers read as a recommendation log: model = order priority, experiment = status."""
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("recommendation_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderpriority")).alias("model_version"),
        F.concat(F.lit("exp_"), F.lower("o_orderstatus")).alias("experiment_id"),
        F.col("o_orderdate").alias("created_at"),
    )


REC_LOG = """rec_log AS (
  SELECT o_orderkey AS recommendation_id, o_custkey AS user_id,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS model_version,
         'exp_' || lower(o_orderstatus) AS experiment_id, o_orderdate AS created_at
  FROM orders)"""


@query("a9_recommendation_stats", with_(REC_LOG) + """
SELECT 'breakdown' AS kind, experiment_id, coalesce(model_version, 'none') AS model_version,
       count(*) AS recommendations
FROM rec_log GROUP BY ALL
UNION ALL
SELECT 'total', NULL, NULL, count(*) FILTER (experiment_id = 'exp_o') FROM rec_log""")
def _a9(spark, sf):
    return lookups.recommendation_stats(recommendation_log(spark, sf), "exp_o")


@query("a10_user_history", with_(INTERACTIONS) + "SELECT DISTINCT user_id, item_id FROM interactions")
def _a10(spark, sf):
    return feat.history(b.interactions(spark, sf))


@query("a12_extended_features", with_(INTERACTIONS, PRODUCTS) + f"""
SELECT item_id, inventory AS stock_level, {iso('v')} AS last_view_ts, {iso('c')} AS last_click_ts,
       {iso('p')} AS last_purchase_ts, {r6('a')} AS avg_purchase_value
FROM products LEFT JOIN (
  SELECT item_id, max(ts) FILTER (event_type = 'view') AS v, max(ts) FILTER (event_type = 'click') AS c,
         max(ts) FILTER (event_type = 'purchase') AS p, avg(value) FILTER (event_type = 'purchase') AS a
  FROM interactions GROUP BY item_id) USING (item_id)""")
def _a12(spark, sf):
    out = feat.extended_features(b.interactions(spark, sf), b.products(spark, sf))
    for t in ("view", "click", "purchase"):
        out = out.withColumn(f"last_{t}_ts", text_ts(f"last_{t}_ts"))
    return out.withColumn("avg_purchase_value", rounded("avg_purchase_value"))


_SPINE = """SELECT user_id, coalesce(total_views, 0) AS total_views, coalesce(total_clicks, 0) AS total_clicks,
       coalesce(total_purchases, 0) AS total_purchases, coalesce(total_interactions, 0) AS total_interactions,
       last_interaction_timestamp, days_since_last_interaction,
       coalesce(view_to_click_ratio, 0) AS view_to_click_ratio, coalesce(purchase_rate, 0) AS purchase_rate
FROM users LEFT JOIN p USING (user_id)"""


@query("f9_default_features", with_(INTERACTIONS, USERS, f"p AS ({profile_sql('user_id')})") + _SPINE)
def _f9(spark, sf):
    profiles = feat.profile(b.interactions(spark, sf), "user_id")
    return _show_profile(feat.with_default_profile(b.users(spark, sf), profiles, "user_id"))


def _as_float(column: str) -> str:
    return r6(f"CAST(CAST(coalesce({column}, 0.0) AS FLOAT) AS DOUBLE)")


_RAW_PROFILE = profile_sql("user_id", r6=str)


@query("f10_feature_vectors", with_(INTERACTIONS, USERS, f"p AS ({_RAW_PROFILE})", f"d AS ({_SPINE})") + f"""
SELECT user_id, CAST(total_views AS DOUBLE) AS f0, CAST(total_clicks AS DOUBLE) AS f1,
       CAST(total_purchases AS DOUBLE) AS f2, CAST(total_interactions AS DOUBLE) AS f3,
       {_as_float('days_since_last_interaction')} AS f4,
       {_as_float('view_to_click_ratio')} AS f5, {_as_float('purchase_rate')} AS f6
FROM d""")
def _f10(spark, sf):
    profiles = feat.profile(b.interactions(spark, sf), "user_id")
    vectors = feat.profile_vector(feat.with_default_profile(b.users(spark, sf), profiles, "user_id"), "user_id")
    return vectors.select(
        "user_id", *[rounded(F.col("features")[i].cast("double")).alias(f"f{i}") for i in range(7)]
    )


@query("f11_first_entities", with_(INTERACTIONS, "firsts AS (SELECT DISTINCT user_id FROM interactions ORDER BY user_id LIMIT 20)",
       "kept AS (SELECT * FROM interactions SEMI JOIN firsts USING (user_id))") + profile_sql("user_id", "kept"))
def _f11(spark, sf):
    events = b.interactions(spark, sf)
    firsts = lookups.first_entities(events, "user_id", 20)
    return _show_profile(
        feat.profile(events.join(firsts, "user_id", "left_semi"), "user_id", feat.max_ts(events))
    )


@query("j10_transactions", with_(INTERACTIONS, USERS, PRODUCTS) + f"""
SELECT event_id, user_id, item_id, location, category, quantity, unit_price, total_amount,
       discount_amount, round(total_amount - discount_amount, 2) AS final_amount
FROM (SELECT *, round(total_amount * d, 2) AS discount_amount FROM (
  SELECT event_id, user_id, item_id, location, category, 1.0::DOUBLE AS quantity, price AS unit_price,
         price * 1.0::DOUBLE AS total_amount,
         CASE WHEN {word("'discount:' || event_id")} / 4294967296.0::DOUBLE < 0.1 THEN 0.125::DOUBLE ELSE 0.0::DOUBLE END AS d
  FROM interactions JOIN users USING (user_id) JOIN products USING (item_id)
  WHERE event_type = 'purchase'))""")
def _j10(spark, sf):
    bought = (
        b.interactions(spark, sf)
        .where("event_type = 'purchase'")
        .select("event_id", "user_id", "item_id", F.lit(None).cast("double").alias("quantity"))
    )
    draw = md5_fraction(F.concat(F.lit("discount:"), F.col("event_id").cast("string")))
    discount = F.when(draw < 0.1, 0.125).otherwise(0.0)
    out = lookups.transactions(bought, b.users(spark, sf), b.products(spark, sf), discount)
    return out.select(
        "event_id", "user_id", "item_id", "location", "category", "quantity", "unit_price",
        "total_amount", "discount_amount", "final_amount",
    )


def daily_user_features(events):
    """One feature row per user and day with events, valid from the end of that day."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("day_events"), F.max("value").alias("day_max_value")
    ).withColumn("feature_ts", F.to_timestamp(F.date_add("day", 1)))


DAILY = """daily AS (
  SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS feature_ts, count(*) AS day_events,
         max(value) AS day_max_value
  FROM interactions GROUP BY ALL)"""


@query("j11_point_in_time_features", with_(INTERACTIONS, DAILY) + """
SELECT s.event_id, s.user_id, coalesce(d.day_events, 0) AS day_events, d.day_max_value
FROM (SELECT * FROM interactions WHERE event_type = 'purchase') s
ASOF LEFT JOIN daily d ON s.user_id = d.user_id AND s.ts >= d.feature_ts""")
def _j11(spark, sf):
    events = b.interactions(spark, sf)
    spine = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = asof.asof_join(spine, daily_user_features(events), "user_id", ["day_events", "day_max_value"])
    return out.fillna(0, subset=["day_events"]).select("event_id", "user_id", "day_events", "day_max_value")


@query("j12_latest_features", with_(INTERACTIONS, DAILY) + f"""
SELECT user_id, {iso('feature_ts')} AS feature_ts, day_events, day_max_value FROM daily
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY feature_ts DESC) = 1""")
def _j12(spark, sf):
    out = asof.latest(daily_user_features(b.interactions(spark, sf)), "user_id", ["day_events", "day_max_value"])
    return out.withColumn("feature_ts", text_ts("feature_ts"))
