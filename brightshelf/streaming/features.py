"""Streaming features: event-time windows, late data, enrichment, online and offline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from brightshelf.functions.scalar import count_when


def deduplicated(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop copies of an event id that arrive within the lateness bound; state is kept no longer."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def windowed_features(events: DataFrame, size: str = "24 hours", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Counts and spend per item and event-time window, tumbling or sliding; same code for batch."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    kind = F.col("event_type")
    watched = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = watched.groupBy(window.alias("window"), "item_id").agg(
        F.count("*").alias("events"),
        count_when(kind == "view").alias("views"),
        count_when(kind == "purchase").alias("purchases"),
        F.sum("value").alias("total_value"),
    )
    return grouped.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "item_id", "events", "views", "purchases", "total_value",
    )


def enriched(events: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """Stream-static join with user location and product category."""
    return events.join(users.select("user_id", "location"), "user_id", "left").join(
        products.select("item_id", "category"), "item_id", "left"
    )


def file_query(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append rows to Parquet until the available input is read."""
    return (
        df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def feature_store_query(events: DataFrame, online: str, offline: str, checkpoint: str) -> StreamingQuery:
    """Per batch: append user features to the offline history, and write the latest state online.

    The online table of a batch is the previous one merged with the batch by partial sums,
    written beside it as the next version, so a reader never sees a half-written table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy("user_id").agg(F.count("*").alias("events"), F.sum("value").alias("total_value"), F.max("ts").alias("feature_ts"))
        history = f"{offline}/batch_id={batch_id}"
        fresh.write.mode("overwrite").parquet(history)
        rows = spark.read.schema(fresh.schema).parquet(history)
        if batch_id:
            rows = rows.unionByName(spark.read.schema(fresh.schema).parquet(f"{online}/version={batch_id - 1}"))
        merged = rows.groupBy("user_id").agg(
            F.sum("events").alias("events"), F.sum("total_value").alias("total_value"), F.max("feature_ts").alias("feature_ts")
        )
        merged.write.mode("overwrite").parquet(f"{online}/version={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
