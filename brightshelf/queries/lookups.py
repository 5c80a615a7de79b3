"""Selections, listings and ranking windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightshelf.functions.scalar import md5_fraction, rounded
from brightshelf.operators import features as feat, lookups, topk
from brightshelf.queries.base import INTERACTIONS, PRODUCTS, PURCHASES, USERS, iso, query, r6, with_, word
from brightshelf.queries.features import REC_LOG, recommendation_log, text_ts
from brightshelf.sources import bindings as b


@query("f1_point_lookup", with_(PRODUCTS, INTERACTIONS) + """
SELECT 'id' AS lookup, item_id, name FROM products WHERE item_id = 42
UNION ALL SELECT 'external', item_id, name FROM products WHERE item_id = 17
UNION ALL SELECT 'list', item_id, name FROM products WHERE item_id IN (3, 5, 8)
UNION ALL SELECT 'table', item_id, name FROM products
  WHERE item_id IN (SELECT item_id FROM interactions WHERE event_type = 'purchase')""")
def _f1(spark, sf):
    products = b.products(spark, sf)
    bought = b.interactions(spark, sf).where("event_type = 'purchase'").select("item_id")
    parts = {
        "id": lookups.by_id(products, "item_id", 42),
        "external": lookups.by_external_id(products, "item_id", "17"),
        "not digits": lookups.by_external_id(products, "item_id", "item_17"),
        "list": lookups.by_ids(products, "item_id", [3, 5, 8]),
        "empty list": lookups.by_ids(products, "item_id", []),
        "table": lookups.by_ids(products, "item_id", bought),
    }
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("lookup"), "item_id", "name")
        out = df if out is None else out.unionByName(df)
    return out


@query("f2_equality_filter", with_(PRODUCTS, USERS) + """
(SELECT 'product' AS kind, item_id AS id FROM products WHERE category = 'STANDARD' ORDER BY item_id LIMIT 50)
UNION ALL (SELECT 'user', user_id FROM users WHERE location = 'NATION_3' ORDER BY user_id LIMIT 50)""")
def _f2(spark, sf):
    standard = lookups.first_matching(b.products(spark, sf), "category", "STANDARD", "item_id", 50)
    located = lookups.first_matching(b.users(spark, sf), "location", "NATION_3", "user_id", 50)
    return standard.select(F.lit("product").alias("kind"), F.col("item_id").alias("id")).unionByName(
        located.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"))
    )


@query("f3_text_search", with_(PRODUCTS, USERS) + """
SELECT 'product' AS kind, item_id AS id FROM products WHERE name ILIKE '%ReD%' OR brand ILIKE '%ReD%'
UNION ALL SELECT 'user', user_id FROM users WHERE name ILIKE '%77%' OR location ILIKE '%77%'""")
def _f3(spark, sf):
    p = lookups.contains_text(b.products(spark, sf), ["name", "brand"], "ReD")
    u = lookups.contains_text(b.users(spark, sf), ["name", "location"], "77")
    return p.select(F.lit("product").alias("kind"), F.col("item_id").alias("id")).unionByName(
        u.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"))
    )


@query("f4_time_slice", with_(INTERACTIONS) + """
SELECT event_id, user_id, item_id, event_type FROM interactions
WHERE ts >= (SELECT max(ts) FROM interactions) - INTERVAL 7 DAY""")
def _f4(spark, sf):
    return feat.time_slice(b.interactions(spark, sf), 7).select("event_id", "user_id", "item_id", "event_type")


@query("f5_newest_per_user", with_(REC_LOG) + f"""
SELECT user_id, recommendation_id, {iso('created_at')} AS created_at, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, recommendation_id) AS rank FROM rec_log)
WHERE rank <= 5""")
def _f5(spark, sf):
    out = topk.newest_k(recommendation_log(spark, sf), 5, ["user_id"], "created_at", "recommendation_id")
    return out.select("user_id", "recommendation_id", text_ts("created_at").alias("created_at"), "rank")


@query("f6_latest_events", with_(INTERACTIONS) + f"""
SELECT event_id, {iso('ts')} AS ts FROM interactions ORDER BY events_ts DESC, event_id DESC LIMIT 100
""".replace("events_ts", "interactions.ts"))
def _f6(spark, sf):
    out = b.interactions(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return out.select("event_id", text_ts("ts").alias("ts"))


@query("f8_normalised_events", with_(INTERACTIONS) + """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
       CAST(item_id AS VARCHAR) AS product_id, event_type,
       strftime(coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE ts END, TIMESTAMP '2024-02-01'), '%Y-%m-%d %H:%M:%S') AS ts,
       CASE WHEN event_type = 'signup' THEN '{}' ELSE props END AS context, '{}' AS metadata
FROM (SELECT i.*, e.props FROM interactions i JOIN events e USING (event_id))""")
def _f8(spark, sf):
    raw = b.table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        "event_type",
        F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"),
        F.when(F.col("event_type") != "signup", F.col("props")).alias("context"),
        F.lit(None).cast("string").alias("metadata"),
    )
    out = lookups.normalise_events(raw, F.lit("2024-02-01").cast("timestamp"))
    return out.withColumn("ts", text_ts("ts"))


@query("j1_top_products", with_(INTERACTIONS, PRODUCTS) + """
SELECT item_id, name, category, count(*) AS interactions FROM interactions JOIN products USING (item_id)
GROUP BY ALL ORDER BY interactions DESC, item_id LIMIT 20""")
def _j1(spark, sf):
    return lookups.top_products_by_interactions(b.interactions(spark, sf), b.products(spark, sf), 20)


@query("j2_active_users", with_(INTERACTIONS, USERS) + """
SELECT user_id, location FROM users
WHERE user_id IN (SELECT user_id FROM interactions WHERE ts >= TIMESTAMP '2024-01-30')""")
def _j2(spark, sf):
    since = F.lit("2024-01-30").cast("timestamp")
    return lookups.active_users_since(b.users(spark, sf), b.interactions(spark, sf), since).select("user_id", "location")


@query("w1_top_k_per_user", with_(PURCHASES) + f"""
SELECT user_id, item_id, {r6('score')} AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank
  FROM (SELECT user_id, item_id, sum(price) AS score FROM purchases GROUP BY ALL)) WHERE rank <= 10""")
def _w1(spark, sf):
    spent = b.purchases(spark, sf).groupBy("user_id", "item_id").agg(F.sum("price").alias("score"))
    return topk.top_k(spent, 10, ["user_id"]).withColumn("score", rounded("score"))


@query("w3_rerank_given_items", with_(INTERACTIONS) + f"""
SELECT user_id, item_id, {r6('score')} AS score,
       row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank
FROM (SELECT user_id, item_id, {word("user_id || ':' || item_id")} / 4294967296.0 AS score
      FROM (SELECT DISTINCT user_id, item_id FROM interactions))""")
def _w3(spark, sf):
    given = feat.history(b.interactions(spark, sf))
    scored = given.withColumn("score", md5_fraction(F.concat_ws(":", "user_id", "item_id")))
    ranked = topk.rank_lists(scored, ["user_id"])
    return ranked.withColumn("score", rounded("score"))


@query("w4_top_k_global", with_(PURCHASES) + """
SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank
FROM (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM purchases GROUP BY item_id)
ORDER BY score DESC, item_id LIMIT 50""")
def _w4(spark, sf):
    counts = b.purchases(spark, sf).groupBy("item_id").agg(F.count("*").cast("double").alias("score"))
    return topk.global_top_k(counts, 50)


@query("u3_never_interacted", with_(INTERACTIONS, PRODUCTS) + """
SELECT item_id FROM products WHERE item_id NOT IN (SELECT item_id FROM interactions)""")
def _u3(spark, sf):
    return b.products(spark, sf).select("item_id").join(b.interactions(spark, sf), "item_id", "left_anti")
