"""Vector functions, lookups and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightshelf.functions import vectors as vec
from brightshelf.functions.scalar import rounded
from brightshelf.operators import features as feat, similarity as sim, topk
from brightshelf.queries.base import INTERACTIONS, PURCHASES, USERS, VECTORS, query, r6, with_
from brightshelf.sources import bindings as b

PAIRS = """pairs AS (
  SELECT user_id, item_id, u.v AS uv, i.v AS iv FROM (SELECT DISTINCT user_id, item_id FROM interactions)
  JOIN vectors u ON u.id = user_id JOIN vectors i ON i.id = item_id)"""


def vector_pairs(spark, sf):
    """User and item vector of every interacted pair."""
    pairs = feat.history(b.interactions(spark, sf))
    users = b.user_vectors(spark, sf).withColumnRenamed("vector", "user_vector")
    items = b.item_vectors(spark, sf).withColumnRenamed("vector", "item_vector")
    return pairs.join(users, "user_id").join(items, "item_id")


COSINE = "list_dot_product(uv, iv) / (sqrt(list_dot_product(uv, uv)) * sqrt(list_dot_product(iv, iv)))"


def _pairwise(expr):
    def run(spark, sf):
        value = rounded(expr(F.col("user_vector"), F.col("item_vector")))
        return vector_pairs(spark, sf).select("user_id", "item_id", value.alias("value"))

    return run


query("v1_cosine", with_(INTERACTIONS, VECTORS, PAIRS) + f"SELECT user_id, item_id, {r6(COSINE)} AS value FROM pairs")(
    _pairwise(vec.cosine)
)
query("v3_euclidean", with_(INTERACTIONS, VECTORS, PAIRS) + f"SELECT user_id, item_id, {r6('list_distance(uv, iv)')} AS value FROM pairs")(
    _pairwise(vec.euclidean)
)
query("v5_dot_product", with_(INTERACTIONS, VECTORS, PAIRS) + f"SELECT user_id, item_id, {r6('list_dot_product(uv, iv)')} AS value FROM pairs")(
    _pairwise(vec.dot)
)

QUERY_USER = 7
VCOS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query("v2_cosine_one_to_many", with_(VECTORS) + f"""
SELECT b.id AS item_id, {r6(VCOS)} AS score FROM vectors a JOIN vectors b ON a.id = {QUERY_USER}""")
def _v2(spark, sf):
    one = b.user_vectors(spark, sf).where(F.col("user_id") == QUERY_USER).select("vector").scalar()
    items = b.item_vectors(spark, sf).withColumn("one", one)
    return items.select("item_id", rounded(vec.cosine(F.col("one"), F.col("vector"))).alias("score"))


@query("v4_pairwise_cosine_matrix", with_(VECTORS) + f"""
SELECT a.id AS item_id, count(*) AS entries,
       string_agg(b.id || ':' || CAST(round(({VCOS}) * 1000000) AS BIGINT), ',' ORDER BY b.id) AS row_values
FROM vectors a CROSS JOIN vectors b GROUP BY a.id""")
def _v4(spark, sf):
    whole = sim.similarity_matrix(b.item_vectors(spark, sf), block=None)
    text = F.zip_with(
        "ids", "similarities", lambda i, s: F.concat_ws(":", i.cast("string"), F.round(s * 1_000_000).cast("bigint").cast("string"))
    )
    return whole.select(
        "item_id", F.size("ids").cast("bigint").alias("entries"), F.array_join(text, ",").alias("row_values")
    )


@query("v6_vector_lookup", with_(USERS, VECTORS) + f"""
SELECT user_id, coalesce(len(v), 64) AS dim, {r6('coalesce(list_sum(v), 0.0)')} AS total
FROM users LEFT JOIN vectors ON id = user_id""")
def _v6(spark, sf):
    found = sim.lookup_vectors(
        b.users(spark, sf).select("user_id"), b.user_vectors(spark, sf), "user_id", vec.zero_vector(64)
    )
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return found.select("user_id", F.size("vector").cast("bigint").alias("dim"), rounded(total).alias("total"))


@query("v7_id_to_index", with_(USERS) + """
SELECT user_id, 'user_' || user_id AS external_id, CAST(greatest(0, least(user_id, 999)) AS BIGINT) AS index FROM users""")
def _v7(spark, sf):
    ids = b.users(spark, sf).select("user_id", F.concat(F.lit("user_"), F.col("user_id")).alias("external_id"))
    return sim.index_of_id(ids, "external_id", "user", 1000)


@query("v8_l2_normalised", with_(VECTORS) + f"""
SELECT id AS item_id, {r6('v[1] / sqrt(list_dot_product(v, v))')} AS first_value,
       {r6('v[64] / sqrt(list_dot_product(v, v))')} AS last_value, 1.0::DOUBLE AS length FROM vectors""")
def _v8(spark, sf):
    unit = b.item_vectors(spark, sf).select("item_id", vec.l2_normalise(F.col("vector")).alias("u"))
    return unit.select(
        "item_id",
        rounded(F.col("u")[0]).alias("first_value"),
        rounded(F.col("u")[63]).alias("last_value"),
        rounded(vec.norm(F.col("u"))).alias("length"),
    )


@query("v9_most_similar_to_one", with_(VECTORS) + f"""
SELECT b.id AS item_id, {r6(VCOS)} AS score,
       row_number() OVER (ORDER BY round({VCOS}, 9) DESC, b.id) AS rank
FROM vectors a JOIN vectors b ON a.id = {QUERY_USER} AND b.id <> a.id ORDER BY rank LIMIT 10""")
def _v9(spark, sf):
    items = b.item_vectors(spark, sf)
    one = items.where(F.col("item_id") == QUERY_USER).select("vector").scalar()
    others = items.where(F.col("item_id") != QUERY_USER).withColumn("one", one)
    scored = others.select("item_id", vec.cosine(F.col("one"), F.col("vector")).alias("score"))
    return topk.global_top_k(scored, 10).withColumn("score", rounded("score"))


def vector_top_sql(k: int, exclude_self: bool, name: str, left: str, right: str, value: str = "score") -> str:
    """CTE `name`: k best vectors b per vector a."""
    where = "WHERE a.id <> b.id" if exclude_self else ""
    return f"""{name} AS (
  SELECT {left}, {right}, {value}, rank FROM (
    SELECT a.id AS {left}, b.id AS {right}, {VCOS} AS {value},
           row_number() OVER (PARTITION BY a.id ORDER BY round({VCOS}, 9) DESC, b.id) AS rank
    FROM vectors a CROSS JOIN vectors b {where}) WHERE rank <= {k})"""


@query("j6_users_by_all_items", with_(VECTORS, vector_top_sql(20, False, "t", "user_id", "item_id")) + f"""
SELECT user_id, item_id, {r6('score')} AS score, rank FROM t""")
def _j6(spark, sf):
    out = sim.top_k_similar(b.user_vectors(spark, sf), b.item_vectors(spark, sf), 20, "user_id")
    return out.withColumn("score", rounded("score"))


@query("w2_similar_items", with_(VECTORS, vector_top_sql(10, True, "t", "item_id", "similar_item_id", "similarity")) + f"""
SELECT item_id, similar_item_id, {r6('similarity')} AS similarity, rank FROM t""")
def _w2(spark, sf):
    return sim.similar_items(b.item_vectors(spark, sf), 10).withColumn("similarity", rounded("similarity"))


def cooccurrence_sql(strengths: str, name: str = "cooc") -> str:
    """CTEs for cosine over user columns; `strengths` is a SELECT of user_id, item_id, weight."""
    return f"""{name}_s AS ({strengths}),
{name}_n AS (SELECT item_id, sqrt(sum(weight * weight)) AS norm FROM {name}_s GROUP BY item_id),
{name}_u AS (SELECT user_id, item_id, weight / norm AS w FROM {name}_s JOIN {name}_n USING (item_id)),
{name} AS (SELECT a.item_id AS item_id_1, b.item_id AS item_id_2, sum(a.w * b.w) AS similarity
  FROM {name}_u a JOIN {name}_u b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY ALL)"""


COUNTS_SQL = "SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS weight FROM interactions GROUP BY ALL"


def interaction_counts(events):
    return events.groupBy("user_id", "item_id").agg(F.count("*").cast("double").alias("weight"))


@query("j8_item_cooccurrence", with_(INTERACTIONS, cooccurrence_sql(COUNTS_SQL)) + f"""
SELECT item_id_1, item_id_2, {r6('similarity')} AS similarity FROM cooc""")
def _j8(spark, sf):
    pairs = sim.cooccurrence(interaction_counts(b.interactions(spark, sf)))
    return pairs.withColumn("similarity", rounded("similarity"))


def similar_sql(pairs: str, k: int, name: str) -> str:
    """CTE `name`: k most similar items per item from a two-sided reading of `pairs`."""
    return f"""{name} AS (
  SELECT item_id, similar_item_id, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, similar_item_id) AS rank
    FROM (SELECT item_id_1 AS item_id, item_id_2 AS similar_item_id, similarity FROM {pairs}
          UNION ALL SELECT item_id_2, item_id_1, similarity FROM {pairs}))
  WHERE rank <= {k})"""


PURCHASE_COUNTS = "SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS weight FROM purchases GROUP BY ALL"


@query("w2_similar_purchased_items", with_(PURCHASES, cooccurrence_sql(PURCHASE_COUNTS), similar_sql("cooc", 10, "t")) + f"""
SELECT item_id, similar_item_id, {r6('similarity')} AS similarity, rank FROM t""")
def _w2p(spark, sf):
    similar = sim.similar_by_users(interaction_counts(b.purchases(spark, sf)), 10)
    return similar.withColumn("similarity", rounded("similarity"))
