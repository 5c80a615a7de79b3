"""Streaming ingestion: topic or files to the lake, stores and side paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from brightshelf.sources.readers import decode_messages, split_messages
from brightshelf.sources.sinks import with_event_date


def message_files(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Files of message lines as a stream with the `value` column a topic has."""
    reader = spark.readStream.schema("value string")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).text(path)


def lake_query(messages: DataFrame, lake: str, checkpoint: str) -> StreamingQuery:
    """Decode, drop malformed messages, append to the date-partitioned JSON lake.

    With available-now the query drains what is there, in batches of the source's limit,
    and stops; started again it goes on from its checkpoint.
    """
    good, _ = split_messages(decode_messages(messages))
    return (
        with_event_date(good).writeStream.format("json").partitionBy("event_date")
        .option("path", lake).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def drain_query(messages: DataFrame, target: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Bounded drain of a topic to batch files in a chosen format."""
    good, _ = split_messages(decode_messages(messages))
    return (
        good.writeStream.format(fmt).option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


class TooManyBadMessages(RuntimeError):
    """A micro-batch held more malformed messages than allowed."""


def quarantine_query(
    messages: DataFrame, store: str, quarantine: str, checkpoint: str, max_bad_share: float = 1.0
) -> StreamingQuery:
    """Good messages to the store, bad ones to a quarantine table; stop above a bad share.

    Each batch writes into its own batch_id directory, so a batch that is run again after a
    failure replaces its files instead of doubling them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = split_messages(decode_messages(batch))
            counts = decode_messages(batch).agg(F.count("*").alias("n")).first()["n"], bad.count()
            bad.write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
            if counts[0] and counts[1] / counts[0] > max_bad_share:
                raise TooManyBadMessages(f"{counts[1]} of {counts[0]} messages are malformed")
            good.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_query(messages: DataFrame, store: str, purchases: str, checkpoint: str) -> StreamingQuery:
    """Every event once into the store (unique event_id for all time), purchases also on a side path.

    The batch is anti-joined against the store, which unlike a watermark also catches a
    copy that arrives after any delay.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good, _ = split_messages(decode_messages(batch))
        unique = good.groupBy("event_id").agg(
            F.min_by(F.struct(*[c for c in good.columns if c != "event_id"]), "timestamp").alias("_r")
        ).select("event_id", "_r.*")
        # Earlier batches only: a batch run again must not see its own first attempt.
        if batch_id:
            earlier = spark.read.schema(f"event_id {good.schema['event_id'].dataType.simpleString()}, batch_id bigint").parquet(store)
            unique = unique.join(earlier.where(F.col("batch_id") < batch_id).select("event_id"), "event_id", "left_anti")
        target = f"{store}/batch_id={batch_id}"
        unique.write.mode("overwrite").parquet(target)
        written = spark.read.schema(unique.schema).parquet(target)
        written.where(F.col("event_type") == "purchase").write.mode("overwrite").parquet(f"{purchases}/batch_id={batch_id}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
