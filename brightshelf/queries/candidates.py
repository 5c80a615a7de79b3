"""Candidates, combination, serving and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightshelf.functions.scalar import md5_fraction, rounded
from brightshelf.operators import candidates as cand, combine, features as feat, filters, neighbours, similarity as sim
from brightshelf.plans import recommend as plan
from brightshelf.queries.base import INTERACTIONS, PRODUCTS, USERS, VECTORS, query, r6, with_, word
from brightshelf.queries.features import COUNTS, decay_sql
from brightshelf.queries.vectors import (
    COUNTS_SQL, cooccurrence_sql, interaction_counts, similar_sql, vector_top_sql,
)
from brightshelf.session import materialise, removing_shuffles
from brightshelf.sources import bindings as b

SHOW = f"SELECT user_id, item_id, {r6('score')} AS score, rank FROM "
HISTORY = "history AS (SELECT DISTINCT user_id, item_id FROM interactions)"


def _show(df):
    return df.withColumn("score", rounded("score")).select("user_id", "item_id", "score", "rank")


def from_similar_sql(similar: str, k: int, name: str) -> str:
    return f"""{name} AS (
  SELECT user_id, item_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank
    FROM (SELECT user_id, similar_item_id AS item_id, sum(similarity) AS score
          FROM history JOIN {similar} USING (item_id) GROUP BY ALL))
  WHERE rank <= {k})"""


def popularity_sql(k: int, name: str = "popular", users: str = "(SELECT DISTINCT user_id FROM interactions)") -> str:
    return f"""{name}_scores AS (SELECT item_id, {decay_sql()} AS score FROM interactions GROUP BY item_id),
{name}_top AS (SELECT item_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, item_id) AS rank
  FROM {name}_scores QUALIFY rank <= {k}),
{name} AS (SELECT user_id, item_id, score, rank FROM {users} CROSS JOIN {name}_top)"""


def collaborative_sql(k: int, name: str = "collab") -> str:
    return ",\n".join([
        cooccurrence_sql(COUNTS_SQL, f"{name}_c"), similar_sql(f"{name}_c", k, f"{name}_s"),
        from_similar_sql(f"{name}_s", k, name),
    ])


def content_sql(k: int, name: str = "content") -> str:
    return ",\n".join([
        vector_top_sql(k, True, f"{name}_s", "item_id", "similar_item_id", "similarity"),
        from_similar_sql(f"{name}_s", k, name),
    ])


def embedding_sql(k: int, name: str = "embed") -> str:
    return vector_top_sql(k, False, name, "user_id", "item_id")


def top_sql(source: str, k: int, name: str) -> str:
    return f"""{name} AS (
  SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank
  FROM {source} QUALIFY rank <= {k})"""


def weighted_sql(parts: dict[str, float], k: int, name: str) -> str:
    union = " UNION ALL ".join(f"SELECT user_id, item_id, {w!r}::DOUBLE * score AS score FROM {t}" for t, w in parts.items())
    return f"""{name}_all AS (SELECT user_id, item_id, sum(score) AS score FROM ({union}) GROUP BY ALL),
{top_sql(f"{name}_all", k, name)}"""


@query("j7_history_similarity_sum", with_(INTERACTIONS, HISTORY, cooccurrence_sql(COUNTS_SQL), similar_sql("cooc", 10, "s")) + f"""
SELECT user_id, similar_item_id AS item_id, {r6('sum(similarity)')} AS score
FROM history JOIN s USING (item_id) GROUP BY ALL""")
def _j7(spark, sf):
    events = b.interactions(spark, sf)
    similar = sim.similar_from_pairs(sim.cooccurrence(interaction_counts(events)), 10)
    joined = feat.history(events).join(similar, "item_id").groupBy("user_id", F.col("similar_item_id").alias("item_id"))
    return joined.agg(rounded(F.sum("similarity")).alias("score"))


@query("c1_collaborative", with_(INTERACTIONS, HISTORY, collaborative_sql(10)) + SHOW + "collab")
def _c1(spark, sf):
    events = b.interactions(spark, sf)
    return _show(cand.collaborative(feat.history(events), interaction_counts(events), 10))


STRENGTHS_SQL = """SELECT user_id, item_id,
  CAST(sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) AS DOUBLE) AS weight
  FROM interactions WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL"""


@query("c2_collaborative_from_pairs", with_(
    INTERACTIONS, HISTORY, cooccurrence_sql(STRENGTHS_SQL), similar_sql("cooc", 10, "s"), from_similar_sql("s", 10, "out")) + SHOW + "out")
def _c2(spark, sf):
    events = b.interactions(spark, sf)
    pairs = sim.cooccurrence(feat.interaction_strength(events))
    return _show(cand.from_given_pairs(feat.history(events), pairs, 10, "collaborative"))


@query("c3_content_based", with_(INTERACTIONS, HISTORY, VECTORS, content_sql(10)) + SHOW + "content")
def _c3(spark, sf):
    return _show(cand.content_based(feat.history(b.interactions(spark, sf)), b.item_vectors(spark, sf), 10))


@query("c4_content_from_pairs", with_(
    INTERACTIONS, HISTORY, VECTORS, vector_top_sql(5, True, "near", "item_id_1", "item_id_2", "similarity"),
    similar_sql("near", 10, "s"), from_similar_sql("s", 10, "out")) + SHOW + "out")
def _c4(spark, sf):
    pairs = sim.similar_items(b.item_vectors(spark, sf), 5).select(
        F.col("item_id").alias("item_id_1"), F.col("similar_item_id").alias("item_id_2"), "similarity"
    )
    return _show(cand.from_given_pairs(feat.history(b.interactions(spark, sf)), pairs, 10, "content"))


@query("c5_popularity", with_(INTERACTIONS, USERS, popularity_sql(10, users="users")) + SHOW + "popular")
def _c5(spark, sf):
    scores = feat.decayed_popularity(b.interactions(spark, sf))
    return _show(cand.popularity(b.users(spark, sf), scores, 10))


@query("c6_replaced_popularity", with_(INTERACTIONS) + """,
counts AS (SELECT item_id, CAST(count(*) FILTER (event_type = 'view') + 2 * count(*) FILTER (event_type = 'click')
           + 3 * count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS score FROM interactions GROUP BY item_id),
best AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM counts QUALIFY rank <= 10)
SELECT user_id, item_id, score, rank FROM (SELECT DISTINCT user_id FROM interactions) CROSS JOIN best""")
def _c6(spark, sf):
    events = b.interactions(spark, sf)
    users = events.select("user_id").distinct()
    return _show(cand.popularity(users, feat.count_popularity(feat.profile(events, "item_id")), 10))


@query("c7_embedding", with_(VECTORS, embedding_sql(10)) + SHOW + "embed")
def _c7(spark, sf):
    return _show(cand.embedding(b.user_vectors(spark, sf), b.item_vectors(spark, sf), 10))


@query("u2_c8_hybrid_generator", with_(
    INTERACTIONS, HISTORY, VECTORS, collaborative_sql(30), popularity_sql(30), embedding_sql(30),
    weighted_sql({"collab": 0.5, "popular": 0.25, "embed": 0.25}, 10, "out")) + SHOW + "out")
def _c8(spark, sf):
    events = b.interactions(spark, sf)
    users = events.select("user_id").distinct()
    generators = {
        "collaborative": lambda n: cand.collaborative(feat.history(events), interaction_counts(events), n),
        "content": lambda n: cand.content_based(feat.history(events), b.item_vectors(spark, sf), n),
        "popularity": lambda n: cand.popularity(users, feat.decayed_popularity(events), n),
        "embedding": lambda n: cand.embedding(b.user_vectors(spark, sf), b.item_vectors(spark, sf), n),
    }
    return _show(combine.hybrid_generator(generators, 10, [2.0, 0.0, 1.0, 1.0]))


FOUR = {"collab": 0.35, "content": 0.25, "popular": 0.15, "embed": 0.25}


@query("c9_hybrid_recommender", with_(
    INTERACTIONS, HISTORY, VECTORS, collaborative_sql(20), content_sql(20), popularity_sql(20), embedding_sql(20),
    weighted_sql(FOUR, 10, "out")) + SHOW + "out")
def _c9(spark, sf):
    events = b.interactions(spark, sf)
    sources = plan.four_sources(
        events, events.select("user_id").distinct(), b.user_vectors(spark, sf), b.item_vectors(spark, sf), 20
    )
    return _show(combine.hybrid_recommend(sources, 10))


@query("c10_source_dispatch", with_(INTERACTIONS, VECTORS, popularity_sql(30), embedding_sql(30), 
    "p10 AS (SELECT * FROM popular WHERE rank <= 10)", "e10 AS (SELECT * FROM embed WHERE rank <= 10)",
    weighted_sql({"popular": 0.3, "embed": 0.7}, 10, "h10")) + f"""
SELECT 'popularity' AS strategy, user_id, item_id, {r6('score')} AS score, rank FROM p10
UNION ALL SELECT 'embedding', user_id, item_id, {r6('score')}, rank FROM e10
UNION ALL SELECT 'hybrid', user_id, item_id, {r6('score')}, rank FROM h10""")
def _c10(spark, sf):
    events = b.interactions(spark, sf)
    users = events.select("user_id").distinct()
    generators = {
        "popularity": lambda n: cand.popularity(users, feat.decayed_popularity(events), n),
        "embedding": lambda n: cand.embedding(b.user_vectors(spark, sf), b.item_vectors(spark, sf), n),
    }
    out = None
    for strategy in ("popularity", "embedding", "hybrid", "no such strategy"):
        df = combine.by_source(strategy, generators, 10)
        if df is not None:
            df = _show(df).withColumn("strategy", F.lit(strategy))
            out = df if out is None else out.unionByName(df)
    return out


TREND = f"""trend AS (SELECT item_id, {decay_sql(3.0)} AS score FROM interactions
  WHERE ts >= (SELECT max(ts) FROM interactions) - INTERVAL 7 DAY GROUP BY item_id)"""
POP = f"pop AS (SELECT item_id, {decay_sql()} AS score FROM interactions GROUP BY item_id)"
BASE = """base AS (SELECT item_id, sum(score) AS score FROM (
  SELECT item_id, score FROM pop UNION ALL SELECT item_id, 1.2::DOUBLE * score FROM trend) GROUP BY item_id)"""


def _cold_inputs(spark, sf):
    events = b.interactions(spark, sf)
    popular = feat.decayed_popularity(events)
    trending = feat.decayed_popularity(feat.time_slice(events, 7), half_life_days=3.0)
    return popular, trending


@query("c11_new_user_by_category", with_(INTERACTIONS, PRODUCTS, POP, TREND, BASE, """
cats AS (SELECT category, item_id, score FROM pop JOIN products USING (item_id))""", """
scored AS (SELECT k.category, base.item_id, base.score + coalesce(1.5::DOUBLE * c.score, 0.0) AS score
  FROM (SELECT DISTINCT category FROM cats) k CROSS JOIN base
  LEFT JOIN cats c ON c.category = k.category AND c.item_id = base.item_id)""") + f"""
SELECT category, item_id, {r6('score')} AS score,
       row_number() OVER (PARTITION BY category ORDER BY round(score, 9) DESC, item_id) AS rank
FROM scored QUALIFY rank <= 10""")
def _c11(spark, sf):
    popular, trending = _cold_inputs(spark, sf)
    by_category = popular.join(b.products(spark, sf).select("item_id", "category"), "item_id")
    out = combine.new_user_lists_by_category(popular, trending, by_category, 10)
    return out.withColumn("score", rounded("score"))


@query("c12_new_product_fallback", with_(INTERACTIONS, POP) + f"""
SELECT item_id, {r6('score')} AS score, row_number() OVER (ORDER BY round(score, 9) DESC, item_id) AS rank
FROM pop QUALIFY rank <= 10""")
def _c12(spark, sf):
    popular, _ = _cold_inputs(spark, sf)
    return combine.new_product_list(popular, 10).withColumn("score", rounded("score"))


COLD = """cold AS (SELECT item_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, item_id) AS rank
  FROM base QUALIFY rank <= 10)"""


@query("c13_cold_start_fallback", with_(INTERACTIONS, USERS, HISTORY, VECTORS, POP, TREND, BASE, COLD, content_sql(10)) + f"""
SELECT user_id, item_id, {r6('score')} AS score, rank, 'content' AS source FROM content
UNION ALL SELECT user_id, item_id, {r6('score')}, rank, 'cold_start' FROM users CROSS JOIN cold
WHERE user_id NOT IN (SELECT user_id FROM content)""")
def _c13(spark, sf):
    popular, trending = _cold_inputs(spark, sf)
    found = cand.content_based(feat.history(b.interactions(spark, sf)), b.item_vectors(spark, sf), 10)
    out = combine.with_cold_start(b.users(spark, sf), found, combine.new_user_list(popular, trending, 10))
    return out.withColumn("score", rounded("score"))


@query("c14_source_counts", with_(INTERACTIONS, HISTORY, VECTORS, collaborative_sql(20), content_sql(20), popularity_sql(20), embedding_sql(20), """
alls AS (SELECT user_id, item_id, 'collaborative' AS source FROM collab UNION ALL SELECT user_id, item_id, 'content' FROM content
  UNION ALL SELECT user_id, item_id, 'popularity' FROM popular UNION ALL SELECT user_id, item_id, 'embedding' FROM embed)""") + """
SELECT user_id, count(*) FILTER (source = 'collaborative') AS collaborative, count(*) FILTER (source = 'content') AS content,
       count(*) FILTER (source = 'popularity') AS popularity, count(*) FILTER (source = 'embedding') AS embedding,
       count(DISTINCT item_id) AS num_candidates FROM alls GROUP BY user_id""")
def _c14(spark, sf):
    events = b.interactions(spark, sf)
    sources = plan.four_sources(
        events, events.select("user_id").distinct(), b.user_vectors(spark, sf), b.item_vectors(spark, sf), 20
    )
    union = None
    for df in sources.values():
        union = df if union is None else union.unionByName(df)
    return cand.source_counts(union, list(sources))


PROFILES = f"""up AS (SELECT user_id, {COUNTS} FROM interactions GROUP BY user_id),
ip AS (SELECT item_id, {COUNTS} FROM interactions GROUP BY item_id)"""
LINEAR = """2.0::DOUBLE * score + 0.02::DOUBLE * coalesce(ip.total_purchases, 0) + 0.01::DOUBLE * coalesce(ip.total_clicks, 0)
  + 0.005::DOUBLE * coalesce(ip.total_views, 0) + 0.01::DOUBLE * coalesce(up.total_purchases, 0) - 5.0::DOUBLE"""


def scored_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT user_id, item_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({LINEAR}))) AS score
  FROM {source} LEFT JOIN up USING (user_id) LEFT JOIN ip USING (item_id))"""


@query("j5_scored_candidates", with_(INTERACTIONS, VECTORS, embedding_sql(20), PROFILES, scored_sql("embed", "out")) + f"""
SELECT user_id, item_id, {r6('score')} AS score FROM out""")
def _j5(spark, sf):
    events = b.interactions(spark, sf)
    found = cand.embedding(b.user_vectors(spark, sf), b.item_vectors(spark, sf), 20)
    featured = plan.candidate_features(found, feat.profile(events, "user_id"), feat.profile(events, "item_id"))
    return featured.select("user_id", "item_id", rounded(plan.fixed_weight_score()).alias("score"))


@query("c15_two_stage_recommendations", with_(
    INTERACTIONS, USERS, HISTORY, VECTORS, collaborative_sql(100), content_sql(100), popularity_sql(100), embedding_sql(100),
    weighted_sql(FOUR, 100, "mixed"), POP, TREND, BASE, COLD, PROFILES, """
filled AS (SELECT user_id, item_id, score FROM mixed UNION ALL
  SELECT user_id, item_id, score FROM users CROSS JOIN cold WHERE user_id NOT IN (SELECT user_id FROM mixed))""",
    scored_sql("filled", "scored"), top_sql("scored", 10, "out")) + SHOW + "out")
def _c15(spark, sf):
    out = plan.recommend(
        b.interactions(spark, sf), b.users(spark, sf), b.user_vectors(spark, sf), b.item_vectors(spark, sf)
    )
    return _show(out)


@query("c16_intersection_and_cascade", with_(INTERACTIONS, HISTORY, VECTORS, content_sql(50), collaborative_sql(50), POP, """
both_ AS (SELECT user_id, item_id, score FROM content SEMI JOIN collab USING (user_id, item_id))""", top_sql("both_", 10, "i10"), """
casc AS (SELECT user_id, item_id, pop.score AS score FROM content JOIN pop USING (item_id))""", top_sql("casc", 10, "k10")) + f"""
SELECT 'intersection' AS source, user_id, item_id, {r6('score')} AS score, rank FROM i10
UNION ALL SELECT 'cascade', user_id, item_id, {r6('score')}, rank FROM k10""")
def _c16(spark, sf):
    events = b.interactions(spark, sf)
    history = feat.history(events)
    content = cand.content_based(history, b.item_vectors(spark, sf), 50)
    collab = cand.collaborative(history, interaction_counts(events), 50)
    both = cand.intersection(content, collab, 10)
    out = both.unionByName(cand.cascade(content, feat.decayed_popularity(events), 10))
    return out.withColumn("score", rounded("score"))


@query("c18_new_item_prior", with_(INTERACTIONS, PRODUCTS, POP) + f"""
SELECT item_id, {r6(f"coalesce(score, 0.05::DOUBLE + CASE WHEN {word("'explore:' || item_id")} / 4294967296.0 < 0.1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)")} AS score,
       score IS NULL AS is_new
FROM products LEFT JOIN pop USING (item_id)""")
def _c18(spark, sf):
    draw = md5_fraction(F.concat(F.lit("explore:"), F.col("item_id").cast("string")))
    popular, _ = _cold_inputs(spark, sf)
    out = cand.with_new_item_prior(popular, b.products(spark, sf), 0.05, 0.1, draw)
    return out.withColumn("score", rounded("score"))


@query("r1_drop_duplicates", with_(INTERACTIONS, HISTORY, VECTORS, content_sql(10), """
alls AS (SELECT user_id, item_id, score, rank FROM content UNION ALL SELECT user_id, item_id, score, rank + 10 FROM content)""") + SHOW + """alls
QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY rank) = 1""")
def _r1(spark, sf):
    recs = cand.content_based(feat.history(b.interactions(spark, sf)), b.item_vectors(spark, sf), 10)
    twice = recs.unionByName(recs.withColumn("rank", F.col("rank") + 10))
    return _show(filters.drop_duplicates(twice))


RERANK = "row_number() OVER (PARTITION BY user_id ORDER BY rank, item_id) AS new_rank"


@query("r2_drop_recently_purchased", with_(INTERACTIONS, popularity_sql(20), """
recent AS (SELECT user_id, item_id FROM interactions WHERE event_type = 'purchase'
  AND ts >= (SELECT max(ts) FROM interactions) - INTERVAL 259200 SECOND)""") + f"""
SELECT user_id, item_id, {r6('score')} AS score, row_number() OVER (PARTITION BY user_id ORDER BY rank, item_id) AS rank
FROM popular ANTI JOIN recent USING (user_id, item_id)""")
def _r2(spark, sf):
    events = b.interactions(spark, sf)
    recs = cand.popularity(events.select("user_id").distinct(), feat.decayed_popularity(events), 20)
    return _show(filters.drop_recently_purchased(recs, events, feat.max_ts(events), 259_200))


@query("r3_drop_unavailable", with_(INTERACTIONS, PRODUCTS, popularity_sql(20)) + f"""
SELECT user_id, item_id, {r6('score')} AS score, row_number() OVER (PARTITION BY user_id ORDER BY rank, item_id) AS rank
FROM popular WHERE item_id IN (SELECT item_id FROM products WHERE inventory >= 10)""")
def _r3(spark, sf):
    events = b.interactions(spark, sf)
    recs = cand.popularity(events.select("user_id").distinct(), feat.decayed_popularity(events), 20)
    return _show(filters.drop_unavailable(recs, b.products(spark, sf), 10))


@query("r4_limit_per_category", with_(INTERACTIONS, HISTORY, VECTORS, PRODUCTS, content_sql(20)) + f"""
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY rank, item_id) AS rank FROM (
  SELECT user_id, item_id, {r6('score')} AS score, rank FROM content LEFT JOIN products USING (item_id)
  QUALIFY row_number() OVER (PARTITION BY user_id, category ORDER BY rank, item_id) <= 2)""")
def _r4(spark, sf):
    recs = cand.content_based(feat.history(b.interactions(spark, sf)), b.item_vectors(spark, sf), 20)
    return _show(filters.limit_per_category(recs, b.products(spark, sf), 2))


@query("c17_all_cells_probed", with_(VECTORS, embedding_sql(10)) + SHOW + "embed")
def _c17_exact(spark, sf):
    """The inverted file with every cell probed and no cut by codes: exact search."""
    index = neighbours.fit_index(b.item_vectors(spark, sf))
    found = neighbours.search(index, b.user_vectors(spark, sf), 10, "user_id", probes=len(index.centres), refine=None)
    return _show(found)


@query("c7_exact_by_cells", with_(VECTORS, embedding_sql(10)) + SHOW + "embed")
def _c7_cells(spark, sf):
    """The embedding candidates again, without comparing cells that cannot hold any of them."""
    index = neighbours.fit_index(b.item_vectors(spark, sf))
    return _show(neighbours.exact_top_k(index, b.user_vectors(spark, sf), 10, "user_id"))


@query("c17_approximate_neighbours", with_(VECTORS) + "SELECT count(*) AS n_users, count(*) * least(10, count(*)) AS n_rows, true AS recall_reached FROM vectors")
def _c17(spark, sf):
    """Ten approximate neighbours of every user at the measured number of probes; whether nine tenths of the exact ones are found."""
    users, items = b.user_vectors(spark, sf), b.item_vectors(spark, sf)
    with removing_shuffles(spark):
        found = materialise(neighbours.search(neighbours.fit_index(items), users, 10, "user_id"), "neighbours")
    exact = cand.embedding(users, items, 10).select("user_id", "item_id", F.lit(1).alias("hit"))
    return found.join(exact, ["user_id", "item_id"], "left").agg(
        F.count_distinct("user_id").alias("n_users"), F.count("*").alias("n_rows"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached")
    )
