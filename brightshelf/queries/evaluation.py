"""Offline evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightshelf.functions.scalar import rounded
from brightshelf.operators import candidates as cand, evaluation as ev, features as feat
from brightshelf.plans import evaluate as plan
from brightshelf.queries.base import INTERACTIONS, PRODUCTS, VECTORS, query, r6, ratio, with_
from brightshelf.queries.candidates import (
    FOUR, collaborative_sql, content_sql, embedding_sql, popularity_sql, weighted_sql,
)
from brightshelf.session import materialise
from brightshelf.sources import bindings as b

CUTOFF = "2024-01-24 00:00:00"
ALL = INTERACTIONS.replace("interactions AS", "all_events AS")
TRAIN = f"interactions AS (SELECT * FROM all_events WHERE ts < TIMESTAMP '{CUTOFF}')"
TRUTH = f"truth AS (SELECT DISTINCT user_id, item_id FROM all_events WHERE ts >= TIMESTAMP '{CUTOFF}')"
HISTORY = "history AS (SELECT DISTINCT user_id, item_id FROM interactions)"


def _cutoff():
    return F.lit(CUTOFF).cast("timestamp")


def _popular_recs(spark, sf, k=10):
    train, truth = plan.split_at(b.interactions(spark, sf), _cutoff())
    return cand.popularity(train.select("user_id").distinct(), feat.decayed_popularity(train), k), truth


def metric_sql(source: str, table: str) -> str:
    body = ", ".join(f"({r6(f'count(*) FILTER (rank <= {k}) / (SELECT count(*) FROM truth)')}) AS hit_at_{k}" for k in (1, 5, 10))
    return f"""SELECT '{source}' AS source, metric, value FROM (
  UNPIVOT (SELECT {body}, ({r6('coalesce(sum(1.0::DOUBLE / rank), 0.0) / (SELECT count(*) FROM truth)')}) AS mrr
           FROM {table} SEMI JOIN truth USING (user_id, item_id) WHERE rank <= 10)
  ON hit_at_1, hit_at_5, hit_at_10, mrr INTO NAME metric VALUE value)"""


@query("e1_e2_a11_hit_and_mrr", with_(ALL, TRAIN, TRUTH, popularity_sql(10)) + metric_sql("popularity", "popular"))
def _e1(spark, sf):
    recs, truth = _popular_recs(spark, sf)
    return ev.hit_and_mrr(recs, truth, ["popularity"]).withColumn("value", rounded("value"))


@query("e3_all_generators", with_(
    ALL, TRAIN, TRUTH, HISTORY, VECTORS, collaborative_sql(10), content_sql(10), popularity_sql(10), embedding_sql(10),
    weighted_sql(FOUR, 10, "mixed")) + " UNION ALL ".join(
    metric_sql(n, t) for n, t in [("collaborative", "collab"), ("content", "content"), ("popularity", "popular"),
                                  ("embedding", "embed"), ("hybrid", "mixed")]))
def _e3(spark, sf):
    out = plan.evaluate_generators(
        b.interactions(spark, sf), b.user_vectors(spark, sf), b.item_vectors(spark, sf), _cutoff()
    )
    return out.withColumn("value", rounded("value"))


GRADED = """graded AS (SELECT user_id, item_id, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS relevance,
  sum(CASE WHEN event_type = 'purchase' THEN 0.0 ELSE value END) AS score FROM interactions GROUP BY ALL)"""


def _graded(spark, sf):
    kind = F.col("event_type")
    return b.interactions(spark, sf).groupBy("user_id", "item_id").agg(
        F.count(F.when(kind == "purchase", 1)).cast("double").alias("relevance"),
        F.sum(F.when(kind == "purchase", 0.0).otherwise(F.col("value"))).alias("score"),
    )


def _dcg(prefix: str) -> str:
    return ", ".join(f"sum(CASE WHEN rank <= {k} THEN relevance / log2(rank + 1) ELSE 0.0 END) AS {prefix}{k}" for k in (1, 3, 10))


@query("e4_ndcg", with_(INTERACTIONS, GRADED, f"""
d AS (SELECT user_id, {_dcg('d')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM graded) GROUP BY user_id)""", f"""
i AS (SELECT user_id, {_dcg('i')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(relevance, 9) DESC, item_id) AS rank FROM graded) GROUP BY user_id)""") + f"""
SELECT metric, value FROM (UNPIVOT (SELECT {", ".join(f"({r6(f'avg(CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 0.0 END)')}) AS ndcg_{k}" for k in (1, 3, 10))}
FROM d JOIN i USING (user_id)) ON ndcg_1, ndcg_3, ndcg_10 INTO NAME metric VALUE value)""")
def _e4(spark, sf):
    return ev.ndcg(_graded(spark, sf)).withColumn("value", rounded("value"))


SCORED = """scored AS (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, value / (value + 50.0) AS score FROM events)"""


def _scored(spark, sf):
    return b.interactions(spark, sf).select(
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
        (F.col("value") / (F.col("value") + 50.0)).alias("score"),
    )


@query("e5_mse", with_(SCORED) + f"SELECT {r6('avg((label - score) * (label - score))')} AS mse, count(*) AS n FROM scored")
def _e5(spark, sf):
    return ev.mean_squared_error(_scored(spark, sf), "label", "score").withColumn("mse", rounded("mse"))


def binary_sql(name: str, table: str) -> str:
    return f"""SELECT '{name}' AS dataset, n, {r6('(tp + tn) / n')} AS accuracy, {r6('p')} AS precision, {r6('r')} AS recall,
  {r6(ratio('2 * p * r', '(p + r)'))} AS f1, {r6('auc')} AS auc FROM (
  SELECT *, {ratio('tp', '(tp + fp)')} AS p, {ratio('tp', '(tp + fn)')} AS r FROM (
    SELECT count(*) AS n, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
      count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score < 0.5) AS tn,
      (sum(CASE WHEN label = 1 THEN mid END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
        / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc
    FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mid FROM {table})))"""


@query("e6_binary_metrics", with_(SCORED, """
doc_scored AS (SELECT quality AS label, n_chars / (n_chars + 500.0::DOUBLE) AS score FROM labels JOIN documents USING (doc_id))""")
    + binary_sql("events", "scored") + " UNION ALL " + binary_sql("labels", "doc_scored"))
def _e6(spark, sf):
    labelled = b.table(spark, sf, "labels").join(b.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    docs = labelled.select(F.col("quality").alias("label"), (F.col("n_chars") / (F.col("n_chars") + 500.0)).alias("score"))
    out = None
    for name, df in (("events", _scored(spark, sf)), ("labels", docs)):
        row = ev.binary_metrics(df, "label", "score").withColumn("dataset", F.lit(name))
        out = row if out is None else out.unionByName(row)
    for c in ("accuracy", "precision", "recall", "f1", "auc"):
        out = out.withColumn(c, rounded(c))
    return out


DAILY_VALUES = """SELECT CAST(ts AS DATE) AS d, {m} FROM events GROUP BY 1"""


@query("e7_metric_grades", f"""
WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS day, {ratio("count(*) FILTER (event_type = 'click')", 'count(*)')} AS v FROM events GROUP BY 1)
SELECT day, metric, {r6('v2')} AS value, CASE WHEN metric LIKE 'ndcg%' THEN CASE WHEN v2 >= 0.7 THEN 'good' ELSE 'poor' END
  WHEN metric = 'mse' THEN CASE WHEN v2 <= 0.1 THEN 'good' WHEN v2 <= 0.3 THEN 'fair' ELSE 'poor' END
  ELSE CASE WHEN v2 >= 0.7 THEN 'good' WHEN v2 >= 0.4 THEN 'fair' ELSE 'poor' END END AS grade
FROM (SELECT day, 'hit_at_10' AS metric, v * 3.0 AS v2 FROM m UNION ALL SELECT day, 'ndcg@10', v * 3.5 FROM m UNION ALL SELECT day, 'mse', v FROM m)""")
def _e7(spark, sf):
    events = b.interactions(spark, sf)
    daily = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        (F.count(F.when(F.col("event_type") == "click", 1)) / F.count("*")).alias("v")
    )
    rows = daily.select("day", (F.col("v") * 3.0).alias("hit_at_10"), (F.col("v") * 3.5).alias("ndcg@10"), F.col("v").alias("mse"))
    metrics = ev.long_metrics(rows.withColumnRenamed("ndcg@10", "ndcg_10"), ["day"], ["hit_at_10", "ndcg_10", "mse"])
    named = metrics.withColumn("metric", F.regexp_replace("metric", "^ndcg_", "ndcg@"))
    return named.withColumn("grade", ev.grade(F.col("metric"), F.col("value"))).withColumn("value", rounded("value"))


@query("e8_precision_recall_map", with_(ALL, TRAIN, TRUTH, popularity_sql(10), """
h AS (SELECT user_id, rank, count(*) OVER (PARTITION BY user_id ORDER BY rank) / rank AS p FROM popular SEMI JOIN truth USING (user_id, item_id))""", """
u AS (SELECT t.user_id, t.relevant, coalesce(x.hits, 0) AS hits, coalesce(x.ps, 0) AS ps FROM (SELECT user_id, count(*) AS relevant FROM truth GROUP BY 1) t
  LEFT JOIN (SELECT user_id, count(*) AS hits, sum(p) AS ps FROM h GROUP BY 1) x USING (user_id))""") + f"""
SELECT {r6('avg(hits / 10.0)')} AS precision, {r6('avg(hits / relevant)')} AS recall, {r6('avg(ps / relevant)')} AS map, count(*) AS users FROM u""")
def _e8(spark, sf):
    recs, truth = _popular_recs(spark, sf)
    out = ev.precision_recall_map(recs, truth, 10)
    for c in ("precision", "recall", "map"):
        out = out.withColumn(c, rounded(c))
    return out


CONTENT_RECS = with_(ALL, TRAIN, TRUTH, HISTORY, VECTORS, PRODUCTS, content_sql(10))


def _content_recs(spark, sf):
    train, truth = plan.split_at(b.interactions(spark, sf), _cutoff())
    return materialise(cand.content_based(feat.history(train), b.item_vectors(spark, sf), 10), "recs"), truth


@query("e9_coverage_hit_rate", CONTENT_RECS + f"""
SELECT {r6("(SELECT avg(n) FROM (SELECT count(*) AS n FROM content GROUP BY user_id))")} AS avg_candidates,
       {r6("(SELECT count(DISTINCT item_id) FROM content SEMI JOIN products USING (item_id)) / (SELECT count(*) FROM products)")} AS coverage,
       {r6("(SELECT count(DISTINCT user_id) FROM content SEMI JOIN truth USING (user_id, item_id)) / (SELECT count(DISTINCT user_id) FROM truth)")} AS hit_rate""")
def _e9(spark, sf):
    recs, truth = _content_recs(spark, sf)
    out = ev.coverage_metrics(recs, truth, b.products(spark, sf))
    for c in ("avg_candidates", "coverage", "hit_rate"):
        out = out.withColumn(c, rounded(c))
    return out


@query("e10_diversity", CONTENT_RECS + f""",
x AS (SELECT item_id, category, coalesce(n, 0) AS n FROM products LEFT JOIN (SELECT item_id, count(*) AS n FROM content GROUP BY 1) USING (item_id)),
c AS (SELECT category, sum(n) AS n, sum(n) / (SELECT sum(n) FROM x) AS p FROM x GROUP BY 1),
g AS (SELECT n, row_number() OVER (ORDER BY n, item_id) AS i FROM x)
SELECT {r6("(SELECT count(*) FILTER (n > 0) / count(*) FROM c)")} AS category_coverage,
       {r6("(SELECT sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0.0 END) FROM c)")} AS entropy,
       {r6("(SELECT (2.0 * sum(i * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)) FROM g)")} AS gini""")
def _e10(spark, sf):
    recs, _ = _content_recs(spark, sf)
    out = ev.diversity(recs, b.products(spark, sf))
    for c in ("category_coverage", "entropy", "gini"):
        out = out.withColumn(c, rounded(c))
    return out


RATES = f"""count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
  count(*) FILTER (event_type = 'purchase') AS purchases,
  {r6("sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END)")} AS revenue,
  {r6(ratio("count(*) FILTER (event_type = 'click')", "count(*) FILTER (event_type = 'view')"))} AS ctr,
  {r6(ratio("count(*) FILTER (event_type = 'purchase')", "count(*) FILTER (event_type = 'view')"))} AS conversion_rate,
  {r6(ratio("sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END)", "count(*) FILTER (event_type = 'view')"))} AS revenue_per_recommendation"""


def show_rates(df):
    for c in ("revenue", "ctr", "conversion_rate", "revenue_per_recommendation"):
        df = df.withColumn(c, rounded(c))
    return df


@query("e11_business_rates", with_(SCORED) + f"""
SELECT {RATES}, (SELECT {r6('avg(-(label * ln(score) + (1 - label) * ln(1 - score)))')} FROM scored) AS log_loss FROM events""")
def _e11(spark, sf):
    rates = show_rates(ev.business_rates(b.interactions(spark, sf)))
    return rates.withColumn("log_loss", rounded(ev.log_loss(_scored(spark, sf), "label", "score").scalar()))


@query("e12_cohorts_and_propensity", with_(INTERACTIONS, """
co AS (SELECT user_id, CASE WHEN count(*) >= 75 THEN 'power' WHEN count(*) >= 60 THEN 'returning' ELSE 'new' END AS cohort FROM interactions GROUP BY 1)""", """
ex AS (SELECT item_id, count(*) / (SELECT count(*) FROM interactions) AS propensity FROM interactions GROUP BY 1)""") + f"""
SELECT cohort, {RATES}, {r6("sum(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END / propensity) / sum(1.0 / propensity)")} AS weighted_click_rate
FROM interactions JOIN co USING (user_id) JOIN ex USING (item_id) GROUP BY cohort""")
def _e12(spark, sf):
    events = b.interactions(spark, sf)
    total = events.agg(F.count("*").alias("n")).scalar()
    share = events.groupBy("item_id").agg(F.count("*").alias("_n")).select("item_id", (F.col("_n") / total).alias("propensity"))
    joined = events.join(ev.user_cohorts(events, 60, 75), "user_id").join(share, "item_id")
    clicks = joined.withColumn("clicked", (F.col("event_type") == "click").cast("double"))
    weighted = ev.propensity_weighted_mean(clicks, "clicked", "propensity", ["cohort"])
    rates = show_rates(ev.business_rates(joined, ["cohort"]))
    return rates.join(weighted.select("cohort", rounded("weighted_mean").alias("weighted_click_rate")), "cohort")
