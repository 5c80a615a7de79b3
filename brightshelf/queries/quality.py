"""Q1-Q4, S3: event quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightshelf.functions.scalar import rounded
from brightshelf.operators import quality as q
from brightshelf.queries.base import INTERACTIONS, iso, query, r6, with_
from brightshelf.sources import bindings as b


@query("q1_rule_failures", with_(INTERACTIONS) + """
SELECT failed, count(*) AS events FROM (
  SELECT array_to_string(list_filter([CASE WHEN item_id >= 50 THEN 'item_range' END,
    CASE WHEN event_type NOT IN ('view','click','search','add_to_cart','purchase','like','wishlist','impression') THEN 'event_type' END],
    lambda x: x IS NOT NULL), ',') AS failed FROM interactions) GROUP BY 1""")
def _q1(spark, sf):
    rules = {"item_range": F.col("item_id") < 50, **q.event_rules()}
    valid, bad = q.split_valid(b.interactions(spark, sf), rules)
    both = valid.select(F.lit("").alias("failed")).unionByName(bad.select(F.array_join("failed", ",").alias("failed")))
    return both.groupBy("failed").agg(F.count("*").alias("events"))


@query("q2_duplicate_events", with_(INTERACTIONS) + f"""
SELECT event_id, user_id, {iso('ts')} AS ts FROM interactions""")
def _q2(spark, sf):
    events = b.interactions(spark, sf)
    again = events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 MINUTES"))
    unique = q.deduplicate(events.unionByName(again), "event_id", "ts")
    return unique.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("q3_outliers", with_(INTERACTIONS, """
f AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM interactions GROUP BY 1)""") + f"""
SELECT event_id, event_type, value, {r6('q1 - 1.5::DOUBLE * (q3 - q1)')} AS low, {r6('q3 + 1.5::DOUBLE * (q3 - q1)')} AS high
FROM interactions JOIN f USING (event_type)
WHERE value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)""")
def _q3(spark, sf):
    out = q.outliers(b.interactions(spark, sf), "value", "event_type")
    return out.select("event_id", "event_type", "value", rounded("low").alias("low"), rounded("high").alias("high"))


@query("q4_volume_and_nulls", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT 'volume' AS check_name, strftime(d.day, '%Y-%m-%d') AS subject, CAST(d.n AS DOUBLE) AS value,
  coalesce(d.n < p.n * 0.95, FALSE) AS flagged FROM d LEFT JOIN d p ON d.day = p.day + 1
UNION ALL SELECT 'nulls', 'value', round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6), FALSE FROM events
UNION ALL SELECT 'nulls', 'item_id', round(avg(CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 1.0 ELSE 0.0 END), 6), FALSE FROM events""")
def _q4(spark, sf):
    events = b.interactions(spark, sf)
    volume = q.daily_volume(events, 0.05).select(
        F.lit("volume").alias("check_name"), F.date_format("day", "yyyy-MM-dd").alias("subject"),
        F.col("events").cast("double").alias("value"), F.col("dropped").alias("flagged"),
    )
    nulls = q.null_rates(events, ["value", "item_id"]).select(
        F.lit("nulls").alias("check_name"), F.col("column").alias("subject"), rounded("null_rate").alias("value"), F.lit(False).alias("flagged")
    )
    return volume.unionByName(nulls)


@query("s3_required_columns", with_(INTERACTIONS) + "SELECT event_type, count(*) AS events FROM interactions GROUP BY 1")
def _s3(spark, sf):
    checked = q.require_columns(b.interactions(spark, sf), ["user_id", "item_id", "event_type"])
    return checked.groupBy("event_type").agg(F.count("*").alias("events"))
