"""ST1-ST9: streaming jobs run to the end of their input, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightshelf.functions.scalar import rounded
from brightshelf.operators import candidates as cand, features as feat
from brightshelf.queries.base import INTERACTIONS, PRODUCTS, USERS, iso, query, r6, with_
from brightshelf.queries.sources import MESSAGES, messages
from brightshelf.session import scratch_path
from brightshelf.sources import bindings as b, sinks
from brightshelf.sources.schemas import INTERACTION_DDL
from brightshelf.streaming import features as sfeat, ingest


def message_lines(spark, sf, malformed=False):
    """Message texts in the shared folder, several files, as a topic would deliver them."""
    path = scratch_path(spark, "topic")
    lines = sinks.topic_messages(messages(spark, sf), "user_id").select("value")
    if malformed:
        broken = messages(spark, sf).where("event_type = 'error'").select(F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(', "user')).alias("value"))
        lines = lines.unionByName(broken)
    lines.repartition(4).write.text(path)
    return path


def event_stream(spark, sf):
    """The event log as a stream of Parquet files, oldest first."""
    path = scratch_path(spark, "events")
    events = b.interactions(spark, sf)
    # Files in time order; equal width, so no task sorts everything.
    events.repartitionByRange(4, "ts").write.parquet(path)
    return spark.readStream.schema(INTERACTION_DDL).parquet(path)


def finished(streaming_query):
    streaming_query.awaitTermination()
    return streaming_query


@query("st1_stream_to_lake", with_(INTERACTIONS, MESSAGES) + """
SELECT event_id, event_type, user_id, strftime(to_timestamp(timestamp), '%Y-%m-%d') AS event_date FROM messages""")
def _st1(spark, sf):
    lake, mark = scratch_path(spark, "lake"), scratch_path(spark, "mark")
    finished(ingest.lake_query(ingest.message_files(spark, message_lines(spark, sf)), lake, mark))
    read = spark.read.schema("event_id string, event_type string, user_id string, event_date string").json(lake)
    return read.select("event_id", "event_type", "user_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


@query("st2_bounded_drain", with_(INTERACTIONS, MESSAGES) + "SELECT event_id, event_type, product_id, timestamp FROM messages")
def _st2(spark, sf):
    target, mark = scratch_path(spark, "drain"), scratch_path(spark, "mark")
    finished(ingest.drain_query(ingest.message_files(spark, message_lines(spark, sf), per_trigger=1), target, mark))
    return spark.read.parquet(target).select("event_id", "event_type", "product_id", "timestamp")


@query("st3_quarantine", with_(INTERACTIONS) + """
SELECT 'good' AS outcome, count(*) AS messages FROM interactions UNION ALL SELECT 'bad', count(*) FROM interactions WHERE event_type = 'error'""")
def _st3(spark, sf):
    store, bad, mark = (scratch_path(spark, n) for n in ("store", "quarantine", "mark"))
    finished(ingest.quarantine_query(ingest.message_files(spark, message_lines(spark, sf, malformed=True)), store, bad, mark))
    return (
        spark.read.parquet(store).select(F.lit("good").alias("outcome"))
        .unionByName(spark.read.parquet(bad).select(F.lit("bad").alias("outcome")))
        .groupBy("outcome").agg(F.count("*").alias("messages"))
    )


@query("st4_event_store_and_purchases", with_(INTERACTIONS) + """
SELECT 'store' AS target, event_type, count(*) AS events FROM interactions GROUP BY 2
UNION ALL SELECT 'purchases', event_type, count(*) FROM interactions WHERE event_type = 'purchase' GROUP BY 2""")
def _st4(spark, sf):
    store, side, mark = (scratch_path(spark, n) for n in ("store", "purchases", "mark"))
    path = message_lines(spark, sf)
    # Every message is delivered twice, in different micro-batches.
    spark.read.text(path).coalesce(2).write.mode("append").text(path)
    finished(ingest.store_query(ingest.message_files(spark, path, per_trigger=3), store, side, mark))
    stored = spark.read.parquet(store).select(F.lit("store").alias("target"), "event_type")
    bought = spark.read.parquet(side).select(F.lit("purchases").alias("target"), "event_type")
    return stored.unionByName(bought).groupBy("target", "event_type").agg(F.count("*").alias("events"))


@query("st5_recommendation_messages", with_(INTERACTIONS, """
counts AS (SELECT item_id, count(*) FILTER (event_type = 'view') + 2 * count(*) FILTER (event_type = 'click')
  + 3 * count(*) FILTER (event_type = 'purchase') AS score FROM interactions GROUP BY item_id)""", """
best AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM counts QUALIFY rank <= 10)""", """
list AS (SELECT string_agg('{"rank":' || rank || ',"item_id":' || item_id || ',"score":' || score || '}', ',' ORDER BY rank) AS items FROM best)""") + """
SELECT CAST(user_id AS VARCHAR) AS key, '{"user_id":' || user_id || ',"recommendations":[' || items || '],"num_returned":10}' AS value
FROM (SELECT DISTINCT user_id FROM interactions) CROSS JOIN list""")
def _st5(spark, sf):
    """Recommendation messages; the topic sink itself needs the connector."""
    events = b.interactions(spark, sf)
    scores = feat.count_popularity(feat.profile(events, "item_id"))
    recs = cand.popularity(events.select("user_id").distinct(), scores, 10)
    return sinks.recommendation_messages(recs.withColumn("score", F.col("score").cast("bigint")))


WINDOWED = """SELECT {iso} AS window_start, item_id, count(*) AS events, count(*) FILTER (event_type = 'view') AS views,
  count(*) FILTER (event_type = 'purchase') AS purchases, {total} AS total_value FROM interactions GROUP BY 1, 2"""


def _show_windows(df):
    return df.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "item_id", "events", "views", "purchases",
        rounded("total_value").alias("total_value"),
    )


@query("st6_event_time_windows", with_(INTERACTIONS, "closed AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM interactions)") +
    f"""SELECT * FROM ({WINDOWED.format(iso=iso("date_trunc('day', ts)"), total=r6('sum(value)'))})
WHERE CAST(window_start AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT mark FROM closed)""")
def _st6(spark, sf):
    target, mark = scratch_path(spark, "windows"), scratch_path(spark, "mark")
    finished(sfeat.file_query(sfeat.windowed_features(event_stream(spark, sf)), target, mark))
    return _show_windows(spark.read.parquet(target))


@query("st6_sliding_windows_batch_twin", with_(INTERACTIONS.replace("interactions AS", "raw AS"),
    "interactions AS (SELECT r.*, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL (12 * k) HOUR AS w FROM raw r CROSS JOIN (SELECT unnest([0, 1]) AS k))")
    + WINDOWED.format(iso=iso("w"), total=r6("sum(value)")))
def _st6b(spark, sf):
    return _show_windows(sfeat.windowed_features(b.interactions(spark, sf), "24 hours", "12 hours"))


@query("st7_deduplicated_stream", with_(INTERACTIONS) + "SELECT event_type, count(*) AS events FROM interactions GROUP BY 1")
def _st7(spark, sf):
    path = scratch_path(spark, "events")
    target, mark = scratch_path(spark, "unique"), scratch_path(spark, "mark")
    events = b.interactions(spark, sf)
    events.unionByName(events).write.parquet(path)
    stream = spark.readStream.schema(INTERACTION_DDL).parquet(path)
    finished(sfeat.file_query(sfeat.deduplicated(stream), target, mark))
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("events"))


@query("st8_enriched_stream", with_(INTERACTIONS, USERS, PRODUCTS) + """
SELECT event_id, location, category FROM interactions LEFT JOIN users USING (user_id) LEFT JOIN products USING (item_id)""")
def _st8(spark, sf):
    target, mark = scratch_path(spark, "enriched"), scratch_path(spark, "mark")
    stream = sfeat.enriched(event_stream(spark, sf), b.users(spark, sf), b.products(spark, sf))
    finished(sfeat.file_query(stream, target, mark))
    return spark.read.parquet(target).select("event_id", "location", "category")


@query("st9_online_and_offline_features", with_(INTERACTIONS) + f"""
SELECT user_id, count(*) AS events, {r6('sum(value)')} AS total_value, {iso('max(ts)')} AS feature_ts, count(*) AS history_events FROM interactions GROUP BY 1""")
def _st9(spark, sf):
    online, offline, mark = (scratch_path(spark, n) for n in ("online", "offline", "mark"))
    finished(sfeat.feature_store_query(event_stream(spark, sf), online, offline, mark))
    newest = spark.read.parquet(online).agg(F.max("version").alias("v")).first()["v"]
    latest = spark.read.parquet(f"{online}/version={newest}")
    history = spark.read.parquet(offline).groupBy("user_id").agg(F.sum("events").alias("history_events"))
    return latest.join(history, "user_id").select(
        "user_id", "events", rounded("total_value").alias("total_value"),
        F.date_format("feature_ts", "yyyy-MM-dd HH:mm:ss").alias("feature_ts"), "history_events",
    )
