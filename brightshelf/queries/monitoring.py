"""Drift, alerts and the retrain decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightshelf.functions.scalar import rounded
from brightshelf.operators import alerts, drift, evaluation as ev
from brightshelf.plans.retrain import retrain_decision
from brightshelf.queries.base import INTERACTIONS, query, r6, ratio, with_
from brightshelf.sources import bindings as b

SPLIT = "2024-01-21 00:00:00"
LINE_SPLIT = "1999-01-01 00:00:00"
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sides(spark, sf):
    events = b.interactions(spark, sf)
    at = F.lit(SPLIT).cast("timestamp")
    return events.where(F.col("ts") < at), events.where(F.col("ts") >= at)


def _line_sides(spark, sf):
    """Order lines before and after a date; the later ones get 10% dearer, so one feature drifts."""
    lines = b.table(spark, sf, "lineitem").select("l_shipdate", *LINE_COLUMNS)
    at = F.lit(LINE_SPLIT).cast("timestamp")
    later = lines.where(F.col("l_shipdate") >= at).withColumn("l_extendedprice", F.col("l_extendedprice") * 1.1)
    return lines.where(F.col("l_shipdate") < at), later


def drift_sql(unpivoted: str, coefficient: float = 1.358) -> str:
    """CTE chain ending in fd(feature, ks, n_ref, n_cur, psi, critical, drifted)."""
    return f"""vals AS ({unpivoted}),
cnt AS (SELECT feature, value, sum(ref) AS ref, sum(1 - ref) AS cur FROM vals GROUP BY ALL),
cum AS (SELECT *, sum(ref) OVER w AS rc, sum(cur) OVER w AS cc, sum(ref) OVER (PARTITION BY feature) AS nr,
  sum(cur) OVER (PARTITION BY feature) AS nc FROM cnt WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, max(abs(rc / nr - cc / nc)) AS ks, CAST(max(nr) AS BIGINT) AS n_ref, CAST(max(nc) AS BIGINT) AS n_cur FROM cum GROUP BY 1),
bins AS (SELECT feature, least(floor((rc - ref) * 10 / nr), 9) AS bin, greatest(sum(ref) / max(nr), 0.0001::DOUBLE) AS e,
  greatest(sum(cur) / max(nc), 0.0001::DOUBLE) AS a FROM cum GROUP BY ALL),
fd AS (SELECT feature, ks, n_ref, n_cur, psi, {coefficient}::DOUBLE * sqrt((n_ref + n_cur) / (n_ref::DOUBLE * n_cur)) AS critical,
  ks > {coefficient}::DOUBLE * sqrt((n_ref + n_cur) / (n_ref::DOUBLE * n_cur)) AS drifted
  FROM ks JOIN (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM bins GROUP BY 1) USING (feature))"""


EVENT_VALUES = f"SELECT 'value' AS feature, value, CASE WHEN ts < TIMESTAMP '{SPLIT}' THEN 1 ELSE 0 END AS ref FROM events"
LINE_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {'CASE WHEN late THEN l_extendedprice * 1.1::DOUBLE ELSE l_extendedprice END' if c == 'l_extendedprice' else c} AS value, "
    f"CASE WHEN late THEN 0 ELSE 1 END AS ref FROM (SELECT *, l_shipdate >= TIMESTAMP '{LINE_SPLIT}' AS late FROM lineitem)"
    for c in LINE_COLUMNS
)
SHOW_FD = f"SELECT feature, {r6('ks')} AS ks, {r6('psi')} AS psi, n_ref, n_cur, {r6('critical')} AS critical, drifted FROM fd"


def _show_fd(df):
    for c in ("ks", "psi", "critical"):
        df = df.withColumn(c, rounded(c))
    return df


@query("d1_feature_drift", with_(drift_sql(LINE_VALUES)) + SHOW_FD)
def _d1(spark, sf):
    return _show_fd(drift.feature_drift(*_line_sides(spark, sf), LINE_COLUMNS))


@query("d1_dataset_drift", with_(drift_sql(LINE_VALUES)) + f"""
SELECT count(*) AS number_of_columns, count(*) FILTER (drifted) AS number_of_drifted_columns, {r6('max(ks)')} AS drift_score,
  {r6('count(*) FILTER (drifted) / count(*)')} AS share_of_drifted_columns, count(*) FILTER (drifted) / count(*) >= 0.5 AS dataset_drift FROM fd""")
def _d1d(spark, sf):
    out = drift.dataset_drift(drift.feature_drift(*_line_sides(spark, sf), LINE_COLUMNS))
    return out.withColumn("drift_score", rounded("drift_score")).withColumn("share_of_drifted_columns", rounded("share_of_drifted_columns"))


@query("d2_target_drift", f"""
WITH t AS (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS target, ts < TIMESTAMP '{SPLIT}' AS ref FROM events),
s AS (SELECT target, count(*) FILTER (ref) / (SELECT count(*) FILTER (ref) FROM t) AS e, count(*) FILTER (NOT ref) / (SELECT count(*) FILTER (NOT ref) FROM t) AS a FROM t GROUP BY 1)
SELECT CAST(target AS BIGINT) AS target, {r6('e')} AS reference_share, {r6('a')} AS current_share, {r6('a - e')} AS difference, {r6('(a - e) * ln(a / e)')} AS psi FROM s""")
def _d2(spark, sf):
    label = F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("bigint")
    ref, cur = (df.withColumn("target", label) for df in _sides(spark, sf))
    out = drift.target_drift(ref, cur, "target")
    for c in ("reference_share", "current_share", "difference", "psi"):
        out = out.withColumn(c, rounded(c))
    return out


@query("d3_daily_ctr", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
  {r6(ratio("count(*) FILTER (event_type = 'click')", "count(*) FILTER (event_type = 'view')"))} AS ctr FROM events GROUP BY 1""")
def _d3(spark, sf):
    daily = b.interactions(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return ev.business_rates(daily, ["day"]).select("day", "impressions", "clicks", rounded("ctr").alias("ctr"))


WINDOWS = f"""w AS (SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS window_start, count(*) AS events,
  count(*) FILTER (event_type = 'error') AS errors, {ratio("count(*) FILTER (event_type = 'click')", "count(*) FILTER (event_type = 'view')")} AS ctr,
  {ratio("count(*) FILTER (event_type = 'purchase')", "count(*) FILTER (event_type = 'view')")} AS cr, avg(value) AS mean_latency FROM events GROUP BY 1)"""


def held_sql(condition: str, n: int) -> str:
    joins = " AND ".join(f"window_start - {300 * i} IN (SELECT window_start FROM w WHERE {condition})" for i in range(1, n)) or "TRUE"
    return f"SELECT window_start FROM w WHERE {condition} AND {joins}"


@query("d4_low_ctr_and_conversion", with_(WINDOWS) + f"""
SELECT 'LowCTR' AS alert, window_start FROM ({held_sql('ctr < 0.02', 3)})
UNION ALL SELECT 'LowConversionRate', window_start FROM ({held_sql('cr < 0.01', 3)})""")
def _d4(spark, sf):
    rates = alerts.windowed_rates(b.interactions(spark, sf))
    ctr = alerts.held_for(rates, F.col("ctr") < 0.02, 3).withColumn("alert", F.lit("LowCTR"))
    conversion = alerts.held_for(rates, F.col("conversion_rate") < 0.01, 3).withColumn("alert", F.lit("LowConversionRate"))
    return ctr.unionByName(conversion).select("alert", "window_start")


@query("d5_high_error_rate", with_(WINDOWS) + f"""
SELECT w.window_start, errors, events, {r6('errors / events')} AS error_rate FROM w WHERE errors / events > 0.05""")
def _d5(spark, sf):
    rates = alerts.windowed_rates(b.interactions(spark, sf))
    fired = alerts.held_for(rates, F.col("error_rate") > 0.05, 1)
    return rates.join(fired, "window_start", "left_semi").select("window_start", "errors", "events", rounded("error_rate").alias("error_rate"))


@query("d6_latency_quantiles", f"""
SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS window_start, count(*) AS n, {r6('quantile_cont(value, 0.5)')} AS p50,
  {r6('quantile_cont(value, 0.95)')} AS p95, quantile_cont(value, 0.95) > 100 AS high FROM events GROUP BY 1""")
def _d6(spark, sf):
    out = alerts.latency_quantiles(b.interactions(spark, sf), "value", {"p50": 0.5, "p95": 0.95})
    return out.select("window_start", "n", rounded("p50").alias("p50"), rounded("p95").alias("p95"), (F.col("p95") > 100).alias("high"))


@query("d7_mean_latency", with_(WINDOWS) + f"SELECT window_start, {r6('mean_latency')} AS mean_latency FROM w WHERE mean_latency > 2.0")
def _d7(spark, sf):
    rates = alerts.windowed_rates(b.interactions(spark, sf)).where("mean_latency > 2.0")
    return rates.select("window_start", rounded("mean_latency").alias("mean_latency"))


@query("d9_drift_alerts", with_(drift_sql(EVENT_VALUES + " UNION ALL " + LINE_VALUES)) + f"""
SELECT feature, {r6('ks')} AS ks, ks > 0.3 AS feature_alert, ks > 0.1 AS prediction_alert FROM fd WHERE ks > 0.005""")
def _d9(spark, sf):
    lines = drift.feature_drift(*_line_sides(spark, sf), LINE_COLUMNS)
    scores = lines.unionByName(drift.feature_drift(*_sides(spark, sf), ["value"]))
    return scores.where("ks > 0.005").select(
        "feature", rounded("ks").alias("ks"),
        (F.col("ks") > drift.FEATURE_DRIFT_BOUND).alias("feature_alert"),
        (F.col("ks") > drift.PREDICTION_DRIFT_BOUND).alias("prediction_alert"),
    )


@query("d11_psi_and_ks_thresholds", with_(drift_sql(LINE_VALUES, 1.628)) + """
SELECT feature, psi > 0.2 AS psi_drift, drifted AS ks_drift FROM fd""")
def _d11(spark, sf):
    out = drift.feature_drift(*_line_sides(spark, sf), LINE_COLUMNS, alpha=0.01)
    return out.select("feature", (F.col("psi") > drift.PSI_BOUND).alias("psi_drift"), F.col("drifted").alias("ks_drift"))


@query("d12_retrain_decision", with_(drift_sql(EVENT_VALUES), f"""
c AS (SELECT count(*) FILTER (ref AND event_type = 'click') / count(*) FILTER (ref AND event_type = 'view') AS b,
  count(*) FILTER (NOT ref AND event_type = 'click') / count(*) FILTER (NOT ref AND event_type = 'view') AS a,
  count(*) FILTER (NOT ref) / count(*) FILTER (ref) AS share FROM (SELECT *, ts < TIMESTAMP '{SPLIT}' AS ref FROM events))""") + f"""
SELECT {r6('b')} AS reference_ctr, {r6('a')} AS current_ctr, (SELECT count(*) FILTER (drifted) FROM fd) AS drifted_features, {r6('share')} AS new_share,
  a < b * 0.9 AS metric_dropped, a < b * 0.9 OR (SELECT count(*) FILTER (drifted) FROM fd) > 0 OR share > 0.2 AS retrain FROM c""")
def _d12(spark, sf):
    out = retrain_decision(*_sides(spark, sf), ["value"])
    for c in ("reference_ctr", "current_ctr", "new_share"):
        out = out.withColumn(c, rounded(c))
    return out
