"""Whether a model should be trained again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brightshelf.functions.scalar import safe_divide
from brightshelf.operators import drift, evaluation as ev


def retrain_decision(
    reference: DataFrame,
    current: DataFrame,
    columns: list[str],
    max_metric_drop: float = 0.1,
    min_new_share: float = 0.2,
) -> DataFrame:
    """One row: CTR drop, drifted features, share of new rows, and the decision (any of them)."""
    features = drift.feature_drift(reference, current, columns)
    drifted = features.agg(F.count(F.when(F.col("drifted"), 1)).alias("n")).scalar()
    old = reference.agg(F.count("*").alias("n")).scalar()
    new = current.agg(F.count("*").alias("n")).scalar()
    current_ctr = ev.business_rates(current).select("ctr").scalar()
    row = ev.business_rates(reference).select(
        F.col("ctr").alias("reference_ctr"),
        current_ctr.alias("current_ctr"),
        drifted.alias("drifted_features"),
        safe_divide(new, old).alias("new_share"),
    )
    metric_drop = F.col("current_ctr") < F.col("reference_ctr") * (1 - max_metric_drop)
    return row.select(
        "*",
        metric_drop.alias("metric_dropped"),
        (metric_drop | (F.col("drifted_features") > 0) | (F.col("new_share") > min_new_share)).alias("retrain"),
    )
