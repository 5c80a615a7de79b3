"""Candidate generation for all users at once.

Every generator returns (user_id, item_id, score, rank, source); extending the library
means writing another function of that shape and passing it to the combiners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brightshelf.operators import similarity as sim
from brightshelf.operators.topk import bounded_list, global_top_k, top_k
from brightshelf.session import BROADCAST_ROWS, materialise, partitions_for

# Similar items that the users of one task bring together; users with longer histories are spread over tasks.
TASK_ENTRIES, LONG_HISTORY = 1_000_000, 1_024
COLUMNS = ["user_id", "item_id", "score", "rank", "source"]


def _named(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source)).select(*COLUMNS)


def from_similar_items(history: DataFrame, similar: DataFrame, limit: int, source: str) -> DataFrame:
    """Sum the similarities of the items similar to each user's history; best `limit` per user.

    History items may come back as candidates. The similar items of an item that occurs in a
    history travel as one list. Histories are dealt out by user first, into tasks of bounded size, so the
    rows they become are added up and ranked where they arise and are never shuffled; those
    of users with more than LONG_HISTORY items are added up over all tasks.
    """
    history = materialise(history.select("user_id", "item_id"), "history")
    wanted = similar.join(history.select("item_id").distinct(), "item_id", "left_semi")
    lists = materialise(wanted.groupBy("item_id").agg(F.collect_list(F.struct("similar_item_id", "similarity")).alias("_s")), "similar-lists")
    entries = lists.agg(F.coalesce(F.sum(F.size("_s")), F.lit(0))).first()[0]
    parts = partitions_for(history.sparkSession, history.count() * max(1, limit), TASK_ENTRIES)
    counts = history.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("_n"))
    long = materialise(counts.where(F.col("_n") > LONG_HISTORY).select("user_id"), "long-histories")

    def scored(rows: DataFrame) -> DataFrame:
        listed = rows.select("user_id", F.inline("_s")).groupBy("user_id", F.col("similar_item_id").alias("item_id"))
        return top_k(listed.agg(F.sum("similarity").alias("score")), limit, ["user_id"])

    def beside_lists(rows: DataFrame, *keys: str) -> DataFrame:
        if entries <= 10 * BROADCAST_ROWS:
            return rows.repartition(parts, *keys).join(F.broadcast(lists), "item_id")
        return rows.join(lists, "item_id").repartition(parts, *keys)

    if long.isEmpty():
        return _named(scored(beside_lists(history, "user_id")), source)
    short, spread = (history.join(long, "user_id", how) for how in ("left_anti", "left_semi"))
    return _named(scored(beside_lists(short, "user_id")).unionByName(scored(beside_lists(spread, "user_id", "item_id"))), source)


def collaborative(history: DataFrame, strengths: DataFrame, limit: int) -> DataFrame:
    """Items that share users with the history, by cosine over user columns."""
    return from_similar_items(history, sim.similar_by_users(strengths, limit), limit, "collaborative")


def content_based(history: DataFrame, item_features: DataFrame, limit: int) -> DataFrame:
    """Items whose feature vectors are close to the history, by cosine; neighbours are looked for where a history asks for them."""
    wanted = materialise(history.select("item_id").distinct(), "history-items")
    return from_similar_items(history, sim.similar_items(item_features, limit, wanted=wanted), limit, "content")


def from_given_pairs(history: DataFrame, pairs: DataFrame, limit: int, source: str) -> DataFrame:
    """As above, from a given table (item_id_1, item_id_2, similarity)."""
    return from_similar_items(history, sim.similar_from_pairs(pairs, limit), limit, source)


def popularity(users: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """The same most popular items for every user: a list of `limit` entries beside each user."""
    best = bounded_list(global_top_k(scores, limit), ["rank", "item_id", "score"])
    listed = users.select("user_id", F.explode(best).alias("_b")).select("user_id", "_b.*")
    return _named(listed, "popularity")


def embedding(user_vectors: DataFrame, item_vectors: DataFrame, limit: int) -> DataFrame:
    """Items closest to the user vector; a user without a vector gets no rows."""
    return _named(sim.top_k_similar(user_vectors, item_vectors, limit, "user_id"), "embedding")


def intersection(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Candidates of the first generator that the second one also proposes."""
    kept = first.drop("rank").join(second.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    return _named(top_k(kept, limit, ["user_id"]), "intersection")


def cascade(first: DataFrame, scorer: DataFrame, limit: int) -> DataFrame:
    """Candidates of the first generator re-ranked by (item_id, score) of another."""
    rescored = first.select("user_id", "item_id").join(scorer.select("item_id", "score"), "item_id")
    return _named(top_k(rescored, limit, ["user_id"]), "cascade")


def with_new_item_prior(scores: DataFrame, catalogue: DataFrame, prior: float, explore: float, draw: Column) -> DataFrame:
    """Give items without history a small prior, and a boost to a hashed share `explore` of them."""
    joined = catalogue.select("item_id").join(scores, "item_id", "left")
    boost = F.when(draw < explore, F.lit(prior)).otherwise(F.lit(0.0))
    return joined.select(
        "item_id", F.coalesce(F.col("score"), F.lit(prior) + boost).alias("score"),
        F.col("score").isNull().alias("is_new"),
    )


def source_counts(candidates: DataFrame, sources: list[str]) -> DataFrame:
    """Candidates per source and distinct candidates, per user."""
    per_item = candidates.groupBy("user_id", "item_id").agg(
        *[F.count(F.when(F.col("source") == s, 1)).alias(s) for s in sources]
    )
    return per_item.groupBy("user_id").agg(
        *[F.sum(s).alias(s) for s in sources], F.count("*").alias("num_candidates")
    )
