"""Writing events, features, reports and topic messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BATCH_FORMATS = ("json", "csv", "parquet")


def with_event_date(messages: DataFrame, epoch: str = "timestamp") -> DataFrame:
    """UTC date of the epoch seconds, the partition column of the lake."""
    return messages.withColumn("event_date", F.to_date(F.timestamp_seconds(F.col(epoch))))


def write_event_lake(messages: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines partitioned by event date. Every task writes its own file per date, so a
    date with most of the rows is written by many tasks."""
    with_event_date(messages).write.mode(mode).partitionBy("event_date").json(path)


def write_batch(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """Events in one of the known formats; the path scheme decides between local and object store."""
    if fmt not in BATCH_FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; use one of {', '.join(BATCH_FORMATS)}")
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_features_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """Feature table as CSV, in one directory per source where `by` names it."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def topic_messages(df: DataFrame, key: str) -> DataFrame:
    """(key, value) rows for a topic: the key as text, the whole row as JSON."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Publish (key, value) rows; needs the Kafka connector package on the class path."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def recommendation_messages(recs: DataFrame) -> DataFrame:
    """One message per user with the ranked list; a list has k entries."""
    listed = recs.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("recommendations")
    )
    return topic_messages(listed.withColumn("num_returned", F.size("recommendations")), "user_id")


def append_new_events(existing: DataFrame | None, incoming: DataFrame, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Rows of a batch to append: one per id, and none the store already has."""
    columns = [c for c in incoming.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*columns), ts).alias("_r")).select(key, "_r.*")
    return first if existing is None else first.join(existing.select(key), key, "left_anti")


def append_report(metrics: DataFrame, path: str, kind: str | Column, run_ts: Column) -> None:
    """Append a long metric table (.., metric, value) as one run of a report kind, or of each kind in a column."""
    metrics.withColumn("kind", F.lit(kind)).withColumn("run_ts", run_ts).write.mode("append").json(path)


def latest_reports(reports: DataFrame) -> DataFrame:
    """Rows of the newest run of every report kind."""
    newest = reports.groupBy("kind").agg(F.max("run_ts").alias("run_ts"))
    return reports.join(newest, ["kind", "run_ts"], "left_semi")
