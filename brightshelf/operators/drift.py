"""Data drift between a reference and a current table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brightshelf.functions.scalar import safe_divide
from brightshelf.operators.ordered import bucket_count, bucket_of, prefix_sums

BINS = 10
SHARE_FLOOR = 1e-4
# Two-sample KS coefficients for 5% and 1%, PSI and drift-score bounds.
KS_COEFFICIENT = {0.05: 1.358, 0.01: 1.628}
PSI_BOUND = 0.2
FEATURE_DRIFT_BOUND = 0.3
PREDICTION_DRIFT_BOUND = 0.1


def _value_counts(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, ref, cur): counts per distinct value, aggregated before any sort."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])

    def side(df: DataFrame, ref: int) -> DataFrame:
        return df.select(F.explode(entries).alias("_e"), F.lit(ref).alias("_ref")).select("_e.*", "_ref")

    both = side(reference, 1).unionByName(side(current, 0)).where(F.col("value").isNotNull())
    return both.groupBy("feature", "value").agg(
        F.sum("_ref").alias("ref"), F.sum(F.lit(1) - F.col("_ref")).alias("cur")
    )


def _feature_buckets(reference: DataFrame, columns: list[str]) -> Column:
    """Bucket per feature from approximate quantiles: a few numbers per feature."""
    n = bucket_count(reference)
    probs = [i / n for i in range(1, n)]
    row = reference.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10 * n).alias(c) for c in columns]).first()
    bucket = F.lit(0)
    for c in columns:
        bucket = F.when(F.col("feature") == c, bucket_of(F.col("value"), sorted(set(row[c] or [])))).otherwise(bucket)
    return bucket


def feature_drift(reference: DataFrame, current: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """Per feature: exact KS distance, PSI over reference deciles, and whether KS rejects at alpha."""
    counts = _value_counts(reference, current, columns)
    ranked = prefix_sums(
        counts,
        [F.col("value")],
        {"_ref_cum": F.col("ref"), "_cur_cum": F.col("cur")},
        _feature_buckets(reference, columns),
        ["feature"],
    )
    sized = ranked.withColumnRenamed("_ref_cum_total", "n_ref").withColumnRenamed("_cur_cum_total", "n_cur")
    distance = F.abs(F.col("_ref_cum") / F.col("n_ref") - F.col("_cur_cum") / F.col("n_cur"))
    # The bin of a value is the decile of the reference that its predecessors fill.
    before = (F.col("_ref_cum") - F.col("ref")) * BINS
    bins = sized.groupBy("feature", F.least(F.floor(before / F.col("n_ref")), F.lit(BINS - 1)).alias("_bin")).agg(
        F.max(distance).alias("_ks"), F.sum("ref").alias("_r"), F.sum("cur").alias("_c"),
        F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"),
    )
    e = F.greatest(F.col("_r") / F.col("n_ref"), F.lit(SHARE_FLOOR))
    a = F.greatest(F.col("_c") / F.col("n_cur"), F.lit(SHARE_FLOOR))
    scores = bins.groupBy("feature").agg(
        F.max("_ks").alias("ks"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"),
        F.sum((a - e) * F.log(a / e)).alias("psi"),
    )
    n, m = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    critical = F.lit(KS_COEFFICIENT[alpha]) * F.sqrt((n + m) / (n * m))
    return scores.withColumn("critical", critical).withColumn("drifted", F.col("ks") > F.col("critical"))


def dataset_drift(features: DataFrame, share: float = 0.5) -> DataFrame:
    """Number and share of drifted features, and whether the data set has drifted."""
    drifted = F.count(F.when(F.col("drifted"), 1))
    return features.agg(
        F.count("*").alias("number_of_columns"), drifted.alias("number_of_drifted_columns"), F.max("ks").alias("drift_score")
    ).select(
        "*",
        safe_divide(F.col("number_of_drifted_columns"), F.col("number_of_columns")).alias("share_of_drifted_columns"),
        (safe_divide(F.col("number_of_drifted_columns"), F.col("number_of_columns")) >= share).alias("dataset_drift"),
    )


def target_drift(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Share of each target class on both sides, its difference, and its PSI part."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.col(column).alias("target")).agg(F.count("*").alias("_n"))
        return counts.select("target", safe_divide(F.col("_n"), counts.agg(F.sum("_n")).scalar()).alias(name))

    both = shares(reference, "reference_share").join(shares(current, "current_share"), "target", "full").fillna(0.0)
    e = F.greatest(F.col("reference_share"), F.lit(SHARE_FLOOR))
    a = F.greatest(F.col("current_share"), F.lit(SHARE_FLOOR))
    return both.select(
        "*", (F.col("current_share") - F.col("reference_share")).alias("difference"), ((a - e) * F.log(a / e)).alias("psi")
    )
