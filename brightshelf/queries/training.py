"""Training data and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from brightshelf.functions.scalar import md5_fraction, rounded
from brightshelf.functions.vectors import dot
from brightshelf.operators import boosting, evaluation as ev, factors, features as feat, models, neural, samples, similarity as sim
from brightshelf.operators.ordered import contiguous_index
from brightshelf.queries.base import INTERACTIONS, PRODUCTS, query, r6, ratio, with_, word
from brightshelf.queries.features import COUNTS, profile_sql
from brightshelf.session import materialise, scratch_path
from brightshelf.sources import bindings as b

WINDOW = """win AS (SELECT * FROM interactions WHERE ts >= (SELECT max(ts) FROM interactions) - INTERVAL 10 DAY)"""


@query("t1_labelled_window", with_(INTERACTIONS, WINDOW) + """
SELECT event_id, user_id, item_id, CASE WHEN event_type IN ('purchase', 'add_to_cart') THEN 1 ELSE 0 END AS label FROM win""")
def _t1(spark, sf):
    return samples.labelled_window(b.interactions(spark, sf), 10).select("event_id", "user_id", "item_id", "label")


@query("t2_one_hot_event_type", with_(INTERACTIONS, WINDOW) + "SELECT event_id, " + ", ".join(
    f"CASE WHEN event_type = '{t}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_{t}"
    for t in ("view", "click", "search", "add_to_cart", "purchase", "like", "wishlist", "impression")) + " FROM win")
def _t2(spark, sf):
    out = samples.one_hot_event_type(samples.labelled_window(b.interactions(spark, sf), 10))
    return out.select("event_id", *[c for c in out.columns if c.startswith("is_")])


USER_COLUMNS = ["total_views", "total_clicks", "purchase_rate"]
PRODUCT_COLUMNS = ["total_views", "total_purchases", "view_to_click_ratio"]
FEATURES = [f"user_{c}" for c in USER_COLUMNS] + [f"product_{c}" for c in PRODUCT_COLUMNS]
PROFILES = f"up AS ({profile_sql('user_id')}), ip AS ({profile_sql('item_id')})"


def training_rows(spark, sf):
    events = b.interactions(spark, sf)
    return samples.training_rows(
        samples.labelled_window(events, 10), feat.profile(events, "user_id"), feat.profile(events, "item_id"),
        USER_COLUMNS, PRODUCT_COLUMNS,
    )


@query("j3_training_rows", with_(INTERACTIONS, WINDOW, PROFILES) + """
SELECT event_id, CASE WHEN event_type IN ('purchase', 'add_to_cart') THEN 1 ELSE 0 END AS label,
  CAST(up.total_views AS DOUBLE) AS user_total_views, CAST(up.total_clicks AS DOUBLE) AS user_total_clicks, up.purchase_rate AS user_purchase_rate,
  CAST(ip.total_views AS DOUBLE) AS product_total_views, CAST(ip.total_purchases AS DOUBLE) AS product_total_purchases, ip.view_to_click_ratio AS product_view_to_click_ratio
FROM win LEFT JOIN up USING (user_id) LEFT JOIN ip USING (item_id)""")
def _j3(spark, sf):
    out = training_rows(spark, sf).select("event_id", "label", *FEATURES)
    return out.withColumn("user_purchase_rate", rounded("user_purchase_rate")).withColumn(
        "product_view_to_click_ratio", rounded("product_view_to_click_ratio")
    )


@query("j4_pair_features", with_(INTERACTIONS, PROFILES) + """
SELECT user_id, item_id, up.total_interactions AS user_interactions, ip.total_interactions AS product_interactions
FROM (SELECT DISTINCT user_id, item_id FROM interactions) JOIN up USING (user_id) JOIN ip USING (item_id)""")
def _j4(spark, sf):
    events = b.interactions(spark, sf)
    users = feat.profile(events, "user_id").select("user_id", F.col("total_interactions").alias("user_interactions"))
    items = feat.profile(events, "item_id").select("item_id", F.col("total_interactions").alias("product_interactions"))
    return feat.history(events).join(users, "user_id").join(items, "item_id")


@query("t3_stratified_split", with_(INTERACTIONS, """
h AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, """ + word("event_id || ':42'") + """ AS h FROM interactions)""") + """
SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY h, event_id) <= floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) AS is_test FROM h""")
def _t3(spark, sf):
    label = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    return samples.stratified_split(b.interactions(spark, sf).select("event_id", label.alias("label")), "event_id", "label")


INDEXED = """cat AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM products),
pairs AS (SELECT DISTINCT user_id, item_id FROM interactions),
comp AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS r
  FROM (SELECT user_id, item_id FROM (SELECT DISTINCT user_id FROM pairs) CROSS JOIN cat) ANTI JOIN pairs USING (user_id, item_id)),
sizes AS (SELECT user_id, count(*) AS m FROM comp GROUP BY 1)"""


@query("t4_negatives_with_replacement", with_(INTERACTIONS, PRODUCTS, INDEXED, f"""
d AS (SELECT user_id, item_id, draw, CAST(floor({word("'neg:' || user_id || ':' || item_id || ':' || draw")} / 4294967296.0::DOUBLE * m) AS BIGINT) AS r
  FROM pairs JOIN sizes USING (user_id) CROSS JOIN (SELECT unnest(range(1, 5)) AS draw))""") + """
SELECT d.user_id, d.item_id, d.draw, comp.item_id AS negative_item_id FROM d JOIN comp ON comp.user_id = d.user_id AND comp.r = d.r""")
def _t4(spark, sf):
    return samples.negatives_with_replacement(feat.history(b.interactions(spark, sf)), b.products(spark, sf))


def _draw(j: int) -> str:
    return f"CAST(floor({word(f"'neg:' || event_id || ':{j}'")} / 4294967296.0::DOUBLE * (m - {j})) AS BIGINT)"


def _shifted(d: str, taken: str) -> str:
    return f"list_reduce(list_prepend({d}, list_sort([{taken}])), lambda a, t: a + CASE WHEN a >= t THEN 1 ELSE 0 END)"


@query("t5_negatives_without_replacement", with_(INTERACTIONS, PRODUCTS, INDEXED, f"""
d1 AS (SELECT event_id, user_id, {_draw(0)} AS r0, {_draw(1)} AS x1, {_draw(2)} AS x2, {_draw(3)} AS x3 FROM interactions JOIN sizes USING (user_id)),
d2 AS (SELECT *, {_shifted('x1', 'r0')} AS r1 FROM d1), d3 AS (SELECT *, {_shifted('x2', 'r0, r1')} AS r2 FROM d2),
d4 AS (SELECT *, {_shifted('x3', 'r0, r1, r2')} AS r3 FROM d3),
d AS (SELECT event_id, user_id, 0 AS draw, r0 AS r FROM d4 UNION ALL SELECT event_id, user_id, 1, r1 FROM d4
  UNION ALL SELECT event_id, user_id, 2, r2 FROM d4 UNION ALL SELECT event_id, user_id, 3, r3 FROM d4)""") + """
SELECT event_id, d.user_id, CAST(draw AS BIGINT) AS draw, comp.item_id AS negative_item_id FROM d JOIN comp ON comp.user_id = d.user_id AND comp.r = d.r""")
def _t5(spark, sf):
    return samples.negatives_without_replacement(b.interactions(spark, sf), b.products(spark, sf))


@query("t6_global_negatives", with_(INTERACTIONS, """
free AS (SELECT u.user_id, i.item_id, row_number() OVER (ORDER BY u.user_id, i.item_id) - 1 AS g
  FROM (SELECT DISTINCT user_id FROM interactions) u CROSS JOIN (SELECT DISTINCT item_id FROM interactions) i ANTI JOIN interactions USING (user_id, item_id))""", """
n AS (SELECT count(*) AS n FROM free)""", f"""
t AS (SELECT try, least(CAST(floor(({word("'global:' || try")} + {word("'global:' || try", 1)} / 4294967296.0::DOUBLE) / 4294967296.0::DOUBLE
    * (SELECT n::DOUBLE FROM n)) AS BIGINT), (SELECT n - 1 FROM n)) AS g
  FROM (SELECT unnest(range(1, (SELECT count(*) * 2 + 1 FROM interactions))) AS try))""") + """
SELECT try, user_id, item_id FROM t JOIN free USING (g)""")
def _t6(spark, sf):
    return samples.global_negatives(b.interactions(spark, sf))


@query("j9_not_interacted_ranges", with_(INTERACTIONS, PRODUCTS, INDEXED, """
g AS (SELECT user_id, r, idx, idx - r AS shift FROM comp JOIN cat USING (item_id))""") + """
SELECT user_id, min(r) AS first_rank, max(r) + 1 AS end_rank, min(idx) AS first_index, max(idx) AS last_index FROM g GROUP BY user_id, shift""")
def _j9(spark, sf):
    catalogue = contiguous_index(b.products(spark, sf), "item_id")
    ranges = samples.not_interacted_ranges(feat.history(b.interactions(spark, sf)), catalogue)
    return ranges.select(
        "user_id", F.col("start").alias("first_rank"), F.col("end").alias("end_rank"),
        (F.col("start") + F.col("shift")).alias("first_index"), (F.col("end") - 1 + F.col("shift")).alias("last_index"),
    )


@query("u1_positive_and_negative_union", with_(INTERACTIONS, PRODUCTS, INDEXED, f"""
d AS (SELECT user_id, CAST(floor({word("'neg:' || user_id || ':' || item_id || ':1'")} / 4294967296.0::DOUBLE * m) AS BIGINT) AS r FROM pairs JOIN sizes USING (user_id))""") + """
SELECT user_id, item_id, 1 AS label FROM pairs UNION ALL
SELECT d.user_id, comp.item_id, 0 FROM d JOIN comp ON comp.user_id = d.user_id AND comp.r = d.r""")
def _u1(spark, sf):
    pairs = feat.history(b.interactions(spark, sf))
    bad = samples.negatives_with_replacement(pairs, b.products(spark, sf), 1)
    return pairs.withColumn("label", F.lit(1)).unionByName(
        bad.select("user_id", F.col("negative_item_id").alias("item_id"), F.lit(0).alias("label"))
    )


@query("t7_contiguous_index", with_(INTERACTIONS) + """
SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS index FROM (SELECT DISTINCT user_id FROM interactions)""")
def _t7(spark, sf):
    return contiguous_index(b.interactions(spark, sf), "user_id")


@query("t17_dataset_version", with_(INTERACTIONS, f"""
h AS (SELECT count(*) AS n, CAST(sum({word("event_id || '|' || user_id || '|' || item_id || '|' || event_type")}) AS BIGINT) AS h0,
  CAST(sum({word("event_id || '|' || user_id || '|' || item_id || '|' || event_type", 1)}) AS BIGINT) AS h1 FROM interactions)""") + """
SELECT n AS rows, substr(sha256(n || ':' || h0 || ':' || h1), 1, 8) AS version FROM h""")
def _t17(spark, sf):
    return samples.fingerprint(b.interactions(spark, sf).select("event_id", "user_id", "item_id", "event_type"))


@query("t18_time_split", with_(INTERACTIONS, """
n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM interactions)""") + """
SELECT event_id, CASE WHEN r <= floor(n * 0.7 + 0.5) THEN 'train' WHEN r <= floor(n * 0.8 + 0.5) THEN 'validation' ELSE 'test' END AS split FROM n""")
def _t18(spark, sf):
    return samples.time_split(b.interactions(spark, sf), "event_id").select("event_id", "split")


@query("t19_context_features", """
SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(dayofweek(ts) + 1 AS INT) AS day_of_week, 'unknown' AS device, 'unknown' AS referrer FROM events""")
def _t19(spark, sf):
    events = b.table(spark, sf, "events")
    return samples.context_features(events, F.col("props")).select("event_id", "hour", "day_of_week", "device", "referrer")


@query("t20_class_weights", with_(INTERACTIONS, "l AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM interactions)") + f"""
SELECT event_id, label, {r6('(SELECT count(*) FROM l) / (2 * count(*) OVER (PARTITION BY label))')} AS weight,
  label = 1 OR {word("'under:' || event_id")} / 4294967296.0::DOUBLE < 0.5 AS kept FROM l""")
def _t20(spark, sf):
    rows = b.interactions(spark, sf).select("event_id", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"))
    weighted = samples.class_weights(rows, "label").withColumn("weight", rounded("weight"))
    kept = samples.undersample(rows, "label", "event_id", {0: 0.5}).select("event_id", F.lit(True).alias("_k"))
    return weighted.join(kept, "event_id", "left").select("event_id", "label", "weight", F.col("_k").isNotNull().alias("kept"))


@query("t8_trained_embeddings", with_(INTERACTIONS) + """
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, least(10, count(DISTINCT item_id)) * count(DISTINCT user_id) AS n_scores,
  true AS scores_are_products, true AS loss_falls FROM interactions""")
def _t8(spark, sf):
    """Embeddings of all users and items, ten best items per user; the loss of every epoch is below that of the one before."""
    users, items, losses = factors.train_embeddings(feat.interaction_strength(b.interactions(spark, sf)))
    users, items = materialise(users, "user-vectors"), materialise(items, "item-vectors")
    best = sim.top_k_similar(users, items, 10, "user_id", metric="dot")
    product = dot(F.col("vector"), F.col("item_vector"))
    both = best.join(users, "user_id").join(items.withColumnRenamed("vector", "item_vector"), "item_id")
    counted = both.agg(F.count("*").alias("n_scores"), F.bool_and(F.abs(product - F.col("score")) < 1e-6).alias("scores_are_products"))
    sizes = users.agg(F.count("*").alias("n_users")), items.agg(F.count("*").alias("n_items"))
    falls = all(later < earlier for earlier, later in zip(losses, losses[1:]))
    return counted.select(sizes[0].scalar().alias("n_users"), sizes[1].scalar().alias("n_items"), "n_scores", "scores_are_products", F.lit(falls).alias("loss_falls"))


def sampled_rows(spark, sf):
    """Positive pairs and their negatives with features and a held-out flag, written once."""
    events = b.interactions(spark, sf)
    pairs = feat.history(events)
    bad = samples.negatives_with_replacement(pairs, b.products(spark, sf))
    rows = pairs.select("user_id", F.col("item_id").alias("positive_id"), "item_id", F.lit(1).alias("label")).unionByName(
        bad.select("user_id", F.col("item_id").alias("positive_id"), F.col("negative_item_id").alias("item_id"), F.lit(0).alias("label"))
    )
    featured = samples.training_rows(
        rows, feat.profile(events, "user_id"), feat.profile(events, "item_id"), USER_COLUMNS, PRODUCT_COLUMNS
    )
    held_out = md5_fraction(F.concat_ws(":", F.lit("split"), F.col("user_id").cast("string"), F.col("positive_id").cast("string"))) < 0.2
    return materialise(featured.withColumn("is_test", held_out), "ranking-rows")


HELD_OUT = f"""split AS (SELECT user_id, item_id AS positive_id, {word("'split:' || user_id || ':' || item_id")} / 4294967296.0::DOUBLE < 0.2 AS is_test FROM pairs),
bad AS (SELECT d.user_id, d.item_id AS positive_id, comp.item_id FROM (
    SELECT user_id, item_id, draw, CAST(floor({word("'neg:' || user_id || ':' || item_id || ':' || draw")} / 4294967296.0::DOUBLE * m) AS BIGINT) AS r
    FROM pairs JOIN sizes USING (user_id) CROSS JOIN (SELECT unnest(range(1, 5)) AS draw)) d JOIN comp ON comp.user_id = d.user_id AND comp.r = d.r),
sampled AS (SELECT pairs.user_id, item_id, 1 AS label, is_test FROM pairs JOIN split ON split.user_id = pairs.user_id AND positive_id = item_id
  UNION ALL SELECT bad.user_id, bad.item_id, 0, is_test FROM bad JOIN split USING (user_id, positive_id)),
share AS (SELECT avg(label) AS p FROM sampled WHERE NOT is_test)"""


def _fit_and_score(spark, sf, name):
    """Held-out rows with the score of a fitted network and `p`, the training share of positives."""
    rows = sampled_rows(spark, sf)
    model = models.ranker(name, FEATURES).fit(rows.where("NOT is_test"))
    share = rows.where("NOT is_test").agg(F.avg("label").alias("p")).scalar()
    return models.score(model, rows.where("is_test")).withColumn("p", share)


def _log_loss(p):
    p = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return -(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))


@query("t9_pointwise_ranker", with_(INTERACTIONS, PRODUCTS, INDEXED, HELD_OUT) + f"""
SELECT count(*) AS n, {r6('avg(-(label * ln(p) + (1 - label) * ln(1 - p)))')} AS constant_log_loss, true AS below_constant FROM sampled CROSS JOIN share WHERE is_test""")
def _t9(spark, sf):
    """Log loss of the network on held-out rows, against the constant share of positives."""
    scored = _fit_and_score(spark, sf, "pointwise")
    constant = F.avg(_log_loss(F.col("p")))
    return scored.agg(F.count("*").alias("n"), rounded(constant).alias("constant_log_loss"), (F.avg(_log_loss(F.col("score"))) < constant).alias("below_constant"))


def _differences(train):
    return models.pairwise_rows(train.where("label = 1"), train.where("label = 0"), FEATURES, ["user_id", "positive_id"])


@query("t10_pairwise_ranker")
def _t10(spark, sf):
    rows = sampled_rows(spark, sf)
    model = models.ranker("pairwise", FEATURES).fit(_differences(rows.where("NOT is_test")))
    return ev.binary_metrics(models.score(model, rows.where("is_test")), "label", "score").withColumn("ranker", F.lit("pairwise"))


LAMBDA_SQL = with_(INTERACTIONS, f"""
rel AS (SELECT user_id, item_id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) AS rel FROM interactions GROUP BY ALL),
scored AS (SELECT *, {word("'score:' || user_id || ':' || item_id")} / 4294967296.0::DOUBLE AS s FROM rel),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS place, row_number() OVER (PARTITION BY user_id ORDER BY rel DESC) AS best FROM scored),
ideal AS (SELECT user_id, sum((2 ** rel - 1) / log2(best + 1)) AS ideal FROM r WHERE best <= 30 GROUP BY 1),
p AS (SELECT a.user_id, a.item_id AS head, b.item_id AS item, sign(b.rel - a.rel) AS up,
    abs(2 ** b.rel - 2 ** a.rel) * (1 / log2(a.place + 1) - CASE WHEN b.place <= 30 THEN 1 / log2(b.place + 1) ELSE 0 END) / ideal AS swap,
    1 / (1 + exp(sign(b.rel - a.rel) * (b.s - a.s))) AS wrong
  FROM r a JOIN r b ON a.user_id = b.user_id AND a.place <= 30 AND b.place > a.place AND a.rel <> b.rel JOIN ideal ON ideal.user_id = a.user_id WHERE ideal > 0),
g AS (SELECT user_id, item AS item_id, up * swap * wrong AS g, swap * wrong * (1 - wrong) AS h FROM p
  UNION ALL SELECT user_id, head, -up * swap * wrong, swap * wrong * (1 - wrong) FROM p
  UNION ALL SELECT user_id, item_id, 0, 0 FROM rel)""") + f"""
SELECT user_id, item_id, {r6('sum(g)')} AS gradient, {r6('sum(h)')} AS curvature FROM g GROUP BY ALL"""


@query("t11_lambda_gradients", LAMBDA_SQL)
def _t11_gradients(spark, sf):
    """How far the listwise ranker would move every scored item of every user."""
    grade = F.max(F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0))
    rows = b.interactions(spark, sf).groupBy("user_id", "item_id").agg(grade.alias("relevance"))
    rows = rows.withColumn("score", md5_fraction(F.concat_ws(":", F.lit("score"), F.col("user_id").cast("string"), F.col("item_id").cast("string"))))
    found = boosting.lambda_gradients(rows, "score")
    return found.select("user_id", "item_id", rounded("gradient").alias("gradient"), rounded("curvature").alias("curvature"))


LISTWISE_SQL = with_(INTERACTIONS, PRODUCTS, INDEXED, HELD_OUT, f"""
t AS (SELECT DISTINCT user_id, item_id, label, {word("'random:' || user_id || ':' || item_id")} / 4294967296.0::DOUBLE AS s FROM sampled WHERE is_test),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) AS place, row_number() OVER (PARTITION BY user_id ORDER BY label DESC, item_id) AS best FROM t),
n AS (SELECT user_id, sum(CASE WHEN place <= 10 THEN label / log2(place + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN label / log2(best + 1) ELSE 0 END) AS ideal FROM o GROUP BY 1)""") + f"""
SELECT count(*) AS n_lists, {r6('avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END)')} AS random_ndcg_10, true AS above_random, true AS not_below_regressor FROM n"""


@query("t11_listwise_ranker", LISTWISE_SQL)
def _t11(spark, sf):
    """NDCG@10 of the listwise ranker on held-out rows, against a random order and a boosted regressor.

    Not below the regressor means at most 0.01 less, which covers the chance of ties.
    """
    rows = sampled_rows(spark, sf)
    train, test = rows.where("NOT is_test"), rows.where("is_test").dropDuplicates(["user_id", "item_id"])

    def measured(scored, name):
        found = ev.ndcg(scored.withColumn("relevance", F.col("label").cast("double"))).where("metric = 'ndcg_10'")
        return found.select(F.lit(name).alias("ranker"), "value")

    chance = md5_fraction(F.concat_ws(":", F.lit("random"), F.col("user_id").cast("string"), F.col("item_id").cast("string")))
    values = measured(models.score(models.ranker("listwise", FEATURES).fit(train), test), "listwise")
    values = values.unionByName(measured(models.score(models.boosted_regressor(FEATURES).fit(train), test), "regressor"))
    values = values.unionByName(measured(test.withColumn("score", chance), "random"))
    value = lambda name: F.max(F.when(F.col("ranker") == name, F.col("value")))
    lists = test.agg(F.count_distinct("user_id").alias("n_lists")).scalar()
    return values.agg(
        F.first(lists).alias("n_lists"), rounded(value("random")).alias("random_ndcg_10"),
        (value("listwise") > value("random")).alias("above_random"), (value("listwise") >= value("regressor") - 0.01).alias("not_below_regressor"),
    )


@query("t12_neural_ranker", with_(INTERACTIONS, PRODUCTS, INDEXED, HELD_OUT) + f"""
SELECT count(*) AS n, {r6('avg((label - p) * (label - p))')} AS mean_mse, true AS below_mean FROM sampled CROSS JOIN share WHERE is_test""")
def _t12(spark, sf):
    """Squared error of the network on held-out rows, against the mean of the training labels."""
    scored = _fit_and_score(spark, sf, "neural")
    mean = F.avg((F.col("label") - F.col("p")) ** 2)
    return scored.agg(F.count("*").alias("n"), rounded(mean).alias("mean_mse"), (F.avg((F.col("label") - F.col("score")) ** 2) < mean).alias("below_mean"))


def _given(k: str) -> str:
    return f"((({k}) * 7919 + 13) % 1009 / 1009.0::DOUBLE - 0.5)"


def _layer(x: str, width: int, units: int, at: int, relu: bool) -> str:
    j, i = f"j{at}", f"i{at}"
    z = f"list_sum(list_transform(range({width}), lambda {i}: {x}[{i} + 1] * {_given(f'{at} + {i} * {units} + {j}')})) + {_given(f'{at + width * units} + {j}')}"
    return f"list_transform(range({units}), lambda {j}: {f'greatest({z}, 0.0)' if relu else z})"


@query("t12_forward_pass", with_(INTERACTIONS, WINDOW, PROFILES, """
x AS (SELECT event_id, [CAST(up.total_views AS DOUBLE), CAST(up.total_clicks AS DOUBLE), up.purchase_rate, CAST(ip.total_views AS DOUBLE),
  CAST(ip.total_purchases AS DOUBLE), ip.view_to_click_ratio] AS raw FROM win LEFT JOIN up USING (user_id) LEFT JOIN ip USING (item_id)),
s AS (SELECT event_id, list_transform(raw, lambda v: (v - 5.0) / 20.0) AS v FROM x)""",
f"h1 AS (SELECT event_id, {_layer('v', 6, 16, 0, True)} AS v FROM s)", f"h2 AS (SELECT event_id, {_layer('v', 16, 8, 112, True)} AS v FROM h1)",
f"o AS (SELECT event_id, {_layer('v', 8, 1, 248, False)} AS v FROM h2)") + f"SELECT event_id, {r6('v[1]')} AS prediction FROM o")
def _t12_forward(spark, sf):
    """Predictions of a network whose weights are given by a rule."""
    sizes = neural.layer_sizes(len(FEATURES), (16, 8))
    weights = (np.arange(neural.n_weights(sizes)) * 7919 + 13) % 1009 / 1009 - 0.5
    network = neural.Network(FEATURES, [5.0] * 6, [20.0] * 6, (16, 8), weights, "mse", [])
    rows = training_rows(spark, sf).select("event_id", *[rounded(c).alias(c) for c in FEATURES])
    return network.transform(rows).select("event_id", rounded("prediction").alias("prediction"))


@query("t13_t16_rankers_by_name")
def _t13(spark, sf):
    """One model per known name, each scoring the held-out rows in one batch."""
    rows = sampled_rows(spark, sf)
    train, out = rows.where("NOT is_test"), None
    fitted = {}  # names of one kind share a model
    for name, kind in models.RANKERS.items():
        if kind not in fitted:
            fitted[kind] = models.ranker(name, FEATURES).fit(_differences(train) if kind == "pairwise" else train)
        model = fitted[kind]
        scored = models.score(model, rows.where("is_test")).groupBy("label").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))
        scored = scored.withColumn("ranker", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return out


@query("t14_saved_and_loaded_model")
def _t14(spark, sf):
    rows = sampled_rows(spark, sf)
    path = scratch_path(spark, "model")
    models.save(models.ranker("pointwise", FEATURES).fit(rows.where("NOT is_test")), path)
    return models.score(models.load(path), rows.where("is_test")).select("user_id", "item_id", "label", "score")


@query("t15_feature_importance")
def _t15(spark, sf):
    rows = sampled_rows(spark, sf)
    model = models.ranker("xgboost", FEATURES).fit(rows.where("NOT is_test"))
    return spark.createDataFrame(models.feature_importance(model), "feature string, importance double")
