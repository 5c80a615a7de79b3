"""Time-split evaluation of all generators in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brightshelf.operators import combine, evaluation as ev, features as feat
from brightshelf.plans.recommend import four_sources


def split_at(events: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(training events before the cutoff, distinct later (user, item) pairs as truth)."""
    return events.where(F.col("ts") < cutoff), feat.history(events.where(F.col("ts") >= cutoff))


def evaluate_generators(
    events: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, cutoff: Column, ks: tuple = (1, 5, 10)
) -> DataFrame:
    """Hit@k and MRR of the four generators and of the hybrid: (source, metric, value)."""
    train, truth = split_at(events, cutoff)
    limit = max(ks)
    sources = four_sources(train, train.select("user_id").distinct(), user_vectors, item_vectors, limit)
    hybrid = combine.hybrid_recommend(sources, limit).withColumn("source", F.lit("hybrid"))
    recs = hybrid.select("user_id", "item_id", "rank", "source")
    for df in sources.values():
        recs = recs.unionByName(df.select("user_id", "item_id", "rank", "source"))
    return ev.hit_and_mrr(recs, truth, [*sources, "hybrid"], ks)
