"""Weighted combination of candidate sources, cold start and fallbacks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from brightshelf.operators import candidates as cand
from brightshelf.operators.topk import bounded_list, global_top_k, top_k

# Default weights of the four-source recommender.
RECOMMENDER_WEIGHTS = {"collaborative": 0.35, "content": 0.25, "popularity": 0.15, "embedding": 0.25}

# Boosts of the new-user list.
TRENDING_BOOST = 1.2
CATEGORY_BOOST = 1.5

# Fixed value: a combined generator asks each source for this many times its limit.
OVERFETCH = 3


def generator_weights(names: list[str], weights: list[float] | None = None) -> dict[str, float]:
    """Weights of a combined generator: equal by default, scaled to sum 1, all zero if they sum to 0."""
    weights = [1.0] * len(names) if weights is None else list(weights)
    if len(weights) != len(names):
        raise ValueError("one weight per generator is needed")
    total = sum(weights)
    return {n: (w / total if total else 0.0) for n, w in zip(names, weights)}


def recommender_weights(weights: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of the four-source recommender, scaled to sum 1; all zero is an error."""
    chosen = {**RECOMMENDER_WEIGHTS, **(weights or {})}
    total = sum(chosen.values())
    if total == 0:
        raise ValueError("all four sources are weighted 0, so nothing could be recommended")
    return {n: w / total for n, w in chosen.items()}


def weighted_union(sources: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Sum of weight x score per (user, item) over the sources given.

    One exchange on the user serves both this aggregation and the ranking after it; a
    user has at most (sources x limit) rows here.
    """
    parts = [
        df.select("user_id", "item_id", (F.lit(float(weights[name])) * F.col("score")).alias("score"))
        for name, df in sources.items()
        if df is not None
    ]
    together = reduce(lambda a, b: a.unionByName(b), parts).repartition("user_id")
    return together.groupBy("user_id", "item_id").agg(F.sum("score").alias("score"))


def hybrid_generator(
    generators: dict[str, Callable[[int], DataFrame]], limit: int, weights: list[float] | None = None
) -> DataFrame:
    """Combine generators: each is asked for 3 x limit, weight 0 is not run, best `limit` kept."""
    shares = generator_weights(list(generators), weights)
    used = {n: g(limit * OVERFETCH) for n, g in generators.items() if shares[n] != 0}
    merged = top_k(weighted_union(used, shares), limit, ["user_id"])
    return merged.withColumn("source", F.lit("hybrid")).select(*cand.COLUMNS)


def hybrid_recommend(sources: dict[str, DataFrame], k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Best k per user of the four-source weighted sum; a missing source is left out."""
    return top_k(weighted_union(sources, recommender_weights(weights)), k, ["user_id"])


def by_source(name: str, generators: dict[str, Callable[[int], DataFrame]], limit: int) -> DataFrame | None:
    """Candidates of a named strategy; an unknown name has none (None)."""
    if name == "hybrid":
        return hybrid_generator(
            {"popularity": generators["popularity"], "embedding": generators["embedding"]}, limit, [0.3, 0.7]
        )
    return generators[name](limit) if name in generators else None


def _new_user_base(popular: DataFrame, trending: DataFrame) -> DataFrame:
    """popularity + 1.2 trending per item; an item listed twice as popular counts once."""
    once = popular.groupBy("item_id").agg(F.max("score").alias("score"))
    boosted = trending.select("item_id", (F.col("score") * F.lit(TRENDING_BOOST)).alias("score"))
    return once.unionByName(boosted).groupBy("item_id").agg(F.sum("score").alias("score"))


def new_user_list(popular: DataFrame, trending: DataFrame, k: int) -> DataFrame:
    """List for a new user of unknown interest: (item_id, score, rank)."""
    return global_top_k(_new_user_base(popular, trending), k)


def new_user_lists_by_category(
    popular: DataFrame, trending: DataFrame, category_popularity: DataFrame, k: int
) -> DataFrame:
    """List per category of interest: (category, item_id, score, rank).

    An item outside the category keeps its base score, so only the k best of those can
    matter; they are put beside each category as one short list.
    """
    base = _new_user_base(popular, trending)
    boosted = category_popularity.groupBy("category", "item_id").agg(
        (F.sum("score") * F.lit(CATEGORY_BOOST)).alias("_boost")
    )
    inside = boosted.join(base, "item_id", "left").select(
        "category", "item_id", (F.coalesce(F.col("score"), F.lit(0.0)) + F.col("_boost")).alias("score")
    )
    general = bounded_list(global_top_k(base, k), ["rank", "item_id", "score"])
    outside = category_popularity.select("category").distinct().select("category", F.explode(general).alias("_g"))
    lists = inside.unionByName(outside.select("category", "_g.item_id", "_g.score"))
    merged = lists.groupBy("category", "item_id").agg(F.max("score").alias("score"))
    return top_k(merged, k, ["category"])


def new_product_list(popular: DataFrame, k: int) -> DataFrame:
    """Fallback beside a product without history: the most popular items."""
    return global_top_k(popular, k)


def with_cold_start(users: DataFrame, candidates: DataFrame, fallback: DataFrame) -> DataFrame:
    """Give users without any candidate the fallback list (item_id, score, rank; k rows)."""
    missing = users.select("user_id").join(candidates.select("user_id"), "user_id", "left_anti")
    listed = bounded_list(fallback, ["rank", "item_id", "score"])
    filled = missing.select("user_id", F.explode(listed).alias("_f")).select(
        "user_id", "_f.item_id", "_f.score", "_f.rank", F.lit("cold_start").alias("source")
    )
    return candidates.select(*cand.COLUMNS).unionByName(filled)
