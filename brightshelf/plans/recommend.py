"""Two-stage recommendation for all users: candidates, features, score, rank, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brightshelf.operators import candidates as cand, combine, features as feat, filters
from brightshelf.operators.topk import top_k
from brightshelf.session import materialise

USER_FEATURES = ["total_views", "total_clicks", "total_purchases"]
PRODUCT_FEATURES = ["total_views", "total_clicks", "total_purchases"]


def fixed_weight_score() -> Column:
    """Repeatable stand-in for a trained model: logistic over the joined features."""
    linear = (
        F.lit(2.0) * F.col("candidate_score")
        + F.lit(0.02) * F.col("product_total_purchases")
        + F.lit(0.01) * F.col("product_total_clicks")
        + F.lit(0.005) * F.col("product_total_views")
        + F.lit(0.01) * F.col("user_total_purchases")
        - F.lit(5.0)
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))


def candidate_features(candidates: DataFrame, user_profiles: DataFrame, item_profiles: DataFrame) -> DataFrame:
    """Candidates with user and product features; unknown entities have zeros."""
    users = user_profiles.select("user_id", *[F.col(c).alias(f"user_{c}") for c in USER_FEATURES])
    items = item_profiles.select("item_id", *[F.col(c).alias(f"product_{c}") for c in PRODUCT_FEATURES])
    joined = (
        candidates.withColumnRenamed("score", "candidate_score").join(users, "user_id", "left").join(items, "item_id", "left")
    )
    names = [f"user_{c}" for c in USER_FEATURES] + [f"product_{c}" for c in PRODUCT_FEATURES]
    return joined.fillna(0, subset=names)


def four_sources(
    events: DataFrame, users: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, limit: int
) -> dict[str, DataFrame]:
    """The four generators over one interaction table."""
    history = feat.history(events)
    counts = events.groupBy("user_id", "item_id").agg(F.count("*").cast("double").alias("weight"))
    return {
        "collaborative": cand.collaborative(history, counts, limit),
        "content": cand.content_based(history, item_vectors, limit),
        "popularity": cand.popularity(users, feat.decayed_popularity(events), limit),
        "embedding": cand.embedding(user_vectors, item_vectors, limit),
    }


def recommend(
    events: DataFrame,
    users: DataFrame,
    user_vectors: DataFrame,
    item_vectors: DataFrame,
    k: int = 10,
    num_candidates: int = 100,
    score: Column | None = None,
) -> DataFrame:
    """Top-k recommendations per user: (user_id, item_id, score, rank, source).

    Users with history or a vector get the weighted four-source list; every other user
    gets the new-user list.
    """
    sources = four_sources(events, feat.history(events).select("user_id").distinct(), user_vectors, item_vectors, num_candidates)
    combined = combine.hybrid_recommend(sources, num_candidates).withColumn("source", F.lit("hybrid"))
    # Read twice below (who has candidates, and the candidates); written once instead.
    combined = materialise(combined, "candidates")
    popular = feat.decayed_popularity(events)
    trending = feat.decayed_popularity(feat.time_slice(events, 7), half_life_days=3.0)
    filled = combine.with_cold_start(users, combined, combine.new_user_list(popular, trending, k))
    featured = candidate_features(
        filled.drop("rank"), feat.profile(events, "user_id"), feat.profile(events, "item_id")
    )
    ranked = top_k(
        featured.withColumn("score", fixed_weight_score() if score is None else score), k, ["user_id"]
    )
    final = filters.drop_duplicates(ranked)
    return final
