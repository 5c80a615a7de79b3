"""Sources and sinks, each written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightshelf.functions.scalar import rounded
from brightshelf.operators import candidates as cand, features as feat
from brightshelf.queries.base import INTERACTIONS, PURCHASES, VECTORS, iso, query, r6, ratio, with_
from brightshelf.queries.candidates import popularity_sql
from brightshelf.session import scratch_path
from brightshelf.sources import bindings as b, readers, sinks

MESSAGES = """messages AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(item_id AS VARCHAR) AS product_id,
  CAST(user_id AS VARCHAR) AS user_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
  CASE WHEN event_type = 'purchase' THEN value END AS price FROM interactions)"""


def messages(spark, sf):
    """The event log in the form messages travel in."""
    bought = F.col("event_type") == "purchase"
    return b.interactions(spark, sf).select(
        F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("item_id").cast("string").alias("product_id"),
        F.col("user_id").cast("string").alias("user_id"), F.unix_seconds("ts").alias("timestamp"),
        F.when(bought, 1).alias("quantity"), F.when(bought, F.col("value")).alias("price"),
    )


@query("s1_s9_event_lake", with_(INTERACTIONS, MESSAGES) + """
SELECT event_id, event_type, user_id, timestamp, price, strftime(to_timestamp(timestamp), '%Y-%m-%d') AS event_date FROM messages""")
def _s1(spark, sf):
    path = scratch_path(spark, "lake")
    sinks.write_event_lake(messages(spark, sf), path)
    lake = readers.read_event_lake(spark, path)
    return lake.select("event_id", "event_type", "user_id", "timestamp", "price", F.col("event_date").cast("string").alias("event_date"))


@query("s2_csv_interactions", with_(INTERACTIONS) + f"""
SELECT user_id, item_id AS product_id, event_type, {iso('ts')} AS ts FROM interactions""")
def _s2(spark, sf):
    path = scratch_path(spark, "csv")
    rows = b.interactions(spark, sf).select("user_id", F.col("item_id").alias("product_id"), "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    sinks.write_batch(rows, path, "csv")
    ddl = "user_id bigint, product_id bigint, event_type string, timestamp string"
    read = readers.read_interactions_csv(spark, path, ddl)
    missing = readers.read_interactions_csv(spark, path + "-missing", ddl)
    both = read.unionByName(missing)
    return both.select("user_id", "product_id", "event_type", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("s4_s5_parquet_features", f"""
SELECT user_id, {iso('max(ts)')} AS last_event_ts, {r6("sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END)")} AS total_spent FROM events GROUP BY user_id""")
def _s4(spark, sf):
    path = scratch_path(spark, "features")
    for _ in range(2):  # the second write replaces the first
        sinks.write_features(feat.user_spend_features(b.interactions(spark, sf)), path)
    read = readers.read_features(spark, path)
    return read.select("user_id", F.date_format("last_event_ts", "yyyy-MM-dd HH:mm:ss").alias("last_event_ts"), rounded("total_spent").alias("total_spent"))


@query("s6_features_per_source", with_(INTERACTIONS, "s AS (SELECT *, strftime(ts, '%Y-%m-%d') AS source FROM interactions)",
    "e AS (SELECT source, max(ts) AS e FROM s GROUP BY 1)") + f"""
SELECT source, item_id, count(*) FILTER (event_type = 'view') AS total_view, count(*) AS total_interactions,
  {r6(ratio("count(*) FILTER (event_type = 'click')", "count(*) FILTER (event_type = 'view')"))} AS click_through_rate
FROM s JOIN e USING (source) GROUP BY ALL""")
def _s6(spark, sf):
    path = scratch_path(spark, "features-csv")
    named = b.interactions(spark, sf).withColumn("source", F.date_format("ts", "yyyy-MM-dd"))
    sinks.write_features_csv(feat.product_features_by_source(named, "source"), path, "source")
    ddl = "item_id bigint, total_view bigint, total_interactions bigint, click_through_rate double, source string"
    read = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    typed = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in ddl.split(", ")]
    return read.select(*typed).withColumn("click_through_rate", rounded("click_through_rate")).withColumn(
        "source", F.date_format("source", "yyyy-MM-dd")
    )


@query("s7_batch_formats", with_(INTERACTIONS) + f"""
SELECT fmt, event_type, count(*) AS events, {r6('sum(value)')} AS total FROM interactions CROSS JOIN (SELECT unnest(['json', 'csv', 'parquet']) AS fmt) GROUP BY ALL""")
def _s7(spark, sf):
    rows = b.interactions(spark, sf).select("event_id", "event_type", "value")
    out = None
    for fmt in sinks.BATCH_FORMATS:
        path = scratch_path(spark, f"batch-{fmt}")
        sinks.write_batch(rows, path, fmt)
        reader = spark.read.schema("event_id bigint, event_type string, value double")
        df = (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path).withColumn("fmt", F.lit(fmt))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("fmt", "event_type").agg(F.count("*").alias("events"), rounded(F.sum("value")).alias("total"))


@query("s8_decoded_messages", with_(INTERACTIONS, MESSAGES) + "SELECT event_id, event_type, product_id, user_id, timestamp, price FROM messages")
def _s8(spark, sf):
    topic = sinks.topic_messages(messages(spark, sf), "user_id")
    good, _ = readers.split_messages(readers.decode_messages(topic))
    return good.select("event_id", "event_type", "product_id", "user_id", "timestamp", "price")


@query("s10_topic_messages", with_(INTERACTIONS, MESSAGES, popularity_sql(5)) + """
SELECT 'event' AS topic, user_id AS key, '{"event_id":"' || event_id || '","event_type":"' || event_type || '","product_id":"' || product_id ||
  '","user_id":"' || user_id || '","timestamp":' || timestamp ||
  CASE WHEN price IS NULL THEN '' ELSE ',"quantity":1,"price":' || price END || '}' AS value FROM messages
UNION ALL
SELECT 'recommendation', CAST(user_id AS VARCHAR), '{"user_id":' || user_id || ',"recommendations":[' ||
  string_agg('{"rank":' || rank || ',"item_id":' || item_id || ',"score":' || CAST(round(score) AS BIGINT) || '}', ',' ORDER BY rank) || '],"num_returned":5}'
FROM popular GROUP BY user_id""")
def _s10(spark, sf):
    events = b.interactions(spark, sf)
    recs = cand.popularity(events.select("user_id").distinct(), feat.decayed_popularity(events), 5)
    recs = recs.withColumn("score", F.round("score").cast("bigint"))
    published = sinks.topic_messages(messages(spark, sf), "user_id").withColumn("topic", F.lit("event"))
    return published.unionByName(sinks.recommendation_messages(recs).withColumn("topic", F.lit("recommendation"))).select("topic", "key", "value")


@query("s11_idempotent_append", with_(INTERACTIONS) + """
SELECT event_type, count(*) AS appended FROM interactions WHERE event_type <> 'purchase' GROUP BY 1""")
def _s11(spark, sf):
    events = b.interactions(spark, sf)
    stored = events.where("event_type = 'purchase'")
    delivered = events.unionByName(events)
    return sinks.append_new_events(stored, delivered).groupBy("event_type").agg(F.count("*").alias("appended"))


@query("s12_embedding_files", with_(VECTORS) + f"""
SELECT fmt, CAST(id AS VARCHAR) AS item_id, 64::BIGINT AS dim, round(v[1] + v[11] + v[64], 4) + 0.0 AS checksum
FROM vectors CROSS JOIN (SELECT unnest(['wide', 'json']) AS fmt)""")
def _s12(spark, sf):
    items = b.item_vectors(spark, sf)
    wide, maps = scratch_path(spark, "wide"), scratch_path(spark, "maps")
    # Columns out of order: 10 sorts before 2 as text.
    order = sorted(range(64), key=str)
    items.select("item_id", *[F.col("vector")[i].alias(f"embedding_{i}") for i in order]).write.option("header", True).csv(wide)
    items.select(F.to_json(F.create_map(F.col("item_id").cast("string"), "vector")).alias("value")).write.text(maps)
    out = None
    for fmt, df in (("wide", readers.read_wide_vectors(spark, wide, "item_id", 64)), ("json", readers.read_json_vectors(spark, maps, "item_id", 64))):
        v = F.col("vector").cast("array<double>")
        row = df.select(
            F.lit(fmt).alias("fmt"), "item_id", F.size("vector").cast("bigint").alias("dim"),
            rounded(v[0] + v[10] + v[63], 4).alias("checksum"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("s13_latest_reports", f"""
WITH d AS (SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS run_ts, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL)
SELECT kind, run_ts, 'events' AS metric, CAST(n AS DOUBLE) AS value FROM d QUALIFY run_ts = max(run_ts) OVER (PARTITION BY kind)
UNION ALL SELECT kind, run_ts, 'mean_value', {r6('mean')} FROM d QUALIFY run_ts = max(run_ts) OVER (PARTITION BY kind)""")
def _s13(spark, sf):
    from brightshelf.operators.evaluation import long_metrics

    path = scratch_path(spark, "reports")
    daily = b.interactions(spark, sf).groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("events"), F.avg("value").alias("mean_value")
    )
    rows = long_metrics(daily, ["event_type", "day"], ["events", "mean_value"])
    sinks.append_report(rows, path, F.col("event_type"), F.col("day"))
    reports = spark.read.schema("kind string, run_ts string, metric string, value double").json(path)
    return sinks.latest_reports(reports).select("kind", "run_ts", "metric", rounded("value").alias("value"))


@query("s14_flattened_records", with_(INTERACTIONS) + """
SELECT e.event_id, e.user_id AS user_id, i.event_type AS event_type, i.value AS event_value, '[' || e.user_id || ',' || i.item_id || ']' AS ids,
  CAST(i.item_id AS VARCHAR) AS props_k, '["' || i.event_type || '"]' AS event_tags
FROM events e JOIN interactions i USING (event_id)""")
def _s14(spark, sf):
    nested = b.table(spark, sf, "events").select(
        "event_id", "user_id",
        F.struct(F.col("event_type").alias("type"), F.col("value"), F.array("event_type").alias("tags")).alias("event"),
        F.array(F.col("user_id"), F.get_json_object("props", "$.k").cast("bigint")).alias("ids"),
        "props",
    )
    return readers.flatten_structs(nested, {"props": readers.json_keys(nested, "props")})
