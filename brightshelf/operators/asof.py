"""Point-in-time and latest feature retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brightshelf.operators.ordered import bucket_of, cut_points


def asof_join(
    spine: DataFrame,
    features: DataFrame,
    key: str,
    columns: list[str],
    spine_ts: str = "ts",
    feature_ts: str = "feature_ts",
) -> DataFrame:
    """Spine rows with the last feature row of the same key at or before their time.

    Two levels: the last value within (key, time bucket), else the last value of an
    earlier bucket. Buckets hold about equal shares of all rows, so the rows of a hot key
    in one bucket are a small part of the whole, and only one row per (key, bucket) is
    carried along the key.
    """
    left = spine.select(
        F.col(key),
        F.col(spine_ts).alias("_ts"),
        F.lit(1).alias("_kind"),
        F.struct(*[c for c in spine.columns]).alias("_row"),
        F.lit(None).cast(features.select(F.struct(*columns).alias("f")).schema["f"].dataType).alias("_feature"),
    )
    right = features.select(
        F.col(key),
        F.col(feature_ts).alias("_ts"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
        F.struct(*columns).alias("_feature"),
    )
    rows = left.unionByName(right).withColumn("_t", F.unix_micros("_ts"))
    rows = rows.withColumn("_bucket", bucket_of(F.col("_t"), cut_points(rows, "_t")))
    inside = (
        Window.partitionBy(key, "_bucket")
        .orderBy("_ts", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumn("_local", F.last("_feature", ignorenulls=True).over(inside)).where("_kind = 1")
    per_bucket = rows.groupBy(key, "_bucket").agg(
        F.max_by("_feature", F.when(F.col("_kind") == 0, F.col("_ts"))).alias("_last")
    )
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        key, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    # A row without key stays, and matches nothing.
    hit = F.when(F.col(key).isNotNull(), F.coalesce("_local", "_carried"))
    joined = local.join(carried, [key, "_bucket"], "left").withColumn("_hit", hit)
    return joined.select("_row.*", *[F.col(f"_hit.{c}").alias(c) for c in columns])


def latest(features: DataFrame, key: str, columns: list[str], feature_ts: str = "feature_ts") -> DataFrame:
    """Last known feature row per key, by partial aggregation."""
    best = features.groupBy(key).agg(F.max_by(F.struct(feature_ts, *columns), feature_ts).alias("_f"))
    return best.select(key, f"_f.{feature_ts}", *[f"_f.{c}" for c in columns])
