"""Experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightshelf.functions.scalar import rounded
from brightshelf.operators import evaluation as ev, experiments as ex, lookups
from brightshelf.queries.base import INTERACTIONS, PRODUCTS, USERS, iso, query, r6, ratio, with_, word
from brightshelf.queries.evaluation import RATES, show_rates
from brightshelf.session import materialise
from brightshelf.sources import bindings as b

EXPERIMENT = "exp_001"
ALLOCATION = [("control", 0.5), ("treatment", 0.5)]
MODELS = {"control": "v1", "treatment": "v2"}


def bucket_sql(experiment: str, user: str) -> str:
    text = f"'{experiment}:' || {user}"
    folded = f"({word(text, 0)} % 10000)"
    for i in (1, 2, 3):
        folded = f"(({folded} * 7296 + {word(text, i)}) % 10000)"
    return f"({folded} / 10000.0)"


ASSIGNED = f"""assigned AS (SELECT user_id, variant, CASE variant WHEN 'control' THEN 'v1' ELSE 'v2' END AS model_version FROM (
  SELECT user_id, CASE WHEN {bucket_sql(EXPERIMENT, 'user_id')} < 0.5 THEN 'control' ELSE 'treatment' END AS variant
  FROM (SELECT DISTINCT user_id FROM interactions)))"""


def event_users(spark, sf):
    return b.interactions(spark, sf).select("user_id").distinct()


def assignments(spark, sf):
    return ex.assign(event_users(spark, sf), EXPERIMENT, ALLOCATION, MODELS)


@query("x1_hash_assignment", with_(USERS) + f"""
SELECT user_id, CASE WHEN {bucket_sql('exp_three', 'user_id')} < 0.2 THEN 'a' WHEN {bucket_sql('exp_three', 'user_id')} < 0.2 + 0.3 THEN 'b' ELSE 'c' END AS three_way,
  CASE WHEN {bucket_sql('exp_zero', 'user_id')} < 0.5 THEN 'control' ELSE 'treatment' END AS zero_total,
  CASE WHEN {bucket_sql('exp_none', 'user_id')} < 0.5 THEN 'control' ELSE 'treatment' END AS no_config
FROM users""")
def _x1(spark, sf):
    user = F.col("user_id")
    return b.users(spark, sf).select(
        "user_id",
        ex.variant_of(F.lit("exp_three"), user, [("a", 2.0), ("b", 3.0), ("c", 5.0)]).alias("three_way"),
        ex.variant_of(F.lit("exp_zero"), user, [("control", 0.0), ("treatment", 0.0)]).alias("zero_total"),
        ex.variant_of(F.lit("exp_none"), user, []).alias("no_config"),
    )


@query("x2_sticky_assignment", with_(USERS) + f"""
SELECT '{EXPERIMENT}' AS experiment_id, user_id,
  CASE WHEN segment = 'MACHINERY' OR {bucket_sql(EXPERIMENT, 'user_id')} >= 0.5 THEN 'treatment' ELSE 'control' END AS variant,
  CASE WHEN segment = 'MACHINERY' THEN 'v0' WHEN {bucket_sql(EXPERIMENT, 'user_id')} < 0.5 THEN 'v1' ELSE 'v2' END AS model_version,
  segment <> 'MACHINERY' AS is_new FROM users""")
def _x2(spark, sf):
    users = b.users(spark, sf)
    stored = users.where("segment = 'MACHINERY'").select(
        F.lit(EXPERIMENT).alias("experiment_id"), "user_id", F.lit("treatment").alias("variant"), F.lit("v0").alias("model_version")
    )
    return ex.assign_sticky(users, stored, EXPERIMENT, ALLOCATION, MODELS)


EXPERIMENTS = """experiments AS (SELECT 'exp_' || lower(o_orderstatus) AS experiment_id, o_orderstatus AS name,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS status, count(*) AS size FROM orders GROUP BY ALL)"""


@query("x3_experiment_lookup", with_(EXPERIMENTS) + """
SELECT 'get' AS lookup, experiment_id, name, status FROM experiments WHERE experiment_id = 'exp_o'
UNION ALL SELECT 'create', 'exp_new', 'new', 'draft'
UNION ALL SELECT 'running', experiment_id, name, status FROM experiments WHERE status = 'running'""")
def _x3(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    experiments = b.table(spark, sf, "orders").select(
        F.concat(F.lit("exp_"), F.lower("o_orderstatus")).alias("experiment_id"), F.col("o_orderstatus").alias("name"), status.alias("status")
    ).distinct()
    got = ex.get_or_create(experiments, "exp_o", {})
    made = ex.get_or_create(experiments, "exp_new", {"name": "new", "status": "draft"})
    listed = lookups.first_matching(experiments, "status", "running", "experiment_id", 100)
    out = got.withColumn("lookup", F.lit("get")).unionByName(made.withColumn("lookup", F.lit("create")))
    return out.unionByName(listed.withColumn("lookup", F.lit("running"))).select("lookup", "experiment_id", "name", "status")


def _log(spark, sf):
    """Views are exposures; clicks, purchases and errors are outcomes of the user's variant."""
    events = b.interactions(spark, sf).join(assignments(spark, sf), "user_id")
    shown = events.where("event_type = 'view'")
    kind = F.col("event_type")
    outcomes = events.where("event_type <> 'view'").select(
        "user_id", "experiment_id", "variant",
        F.when(kind == "click", "ctr").when(kind == "purchase", "revenue_per_recommendation").otherwise(kind).alias("outcome_type"),
        F.when(kind == "purchase", F.col("value")).alias("value"),
    )
    sold = outcomes.where("outcome_type = 'revenue_per_recommendation'").withColumn("outcome_type", F.lit("conversion_rate")).withColumn(
        "value", F.lit(None).cast("double")
    )
    # The tracking rows are a stored table in use; the results read it several times.
    return materialise(ex.exposure_rows(shown).unionByName(ex.outcome_rows(outcomes.unionByName(sold))), "tracking")


@query("x4_exposure_and_outcome_rows", with_(INTERACTIONS, ASSIGNED) + f"""
SELECT user_id, 'experiment_exposure' AS event_type, '{{"experiment_id":"{EXPERIMENT}","variant":"' || variant || '"}}' AS metadata
FROM interactions JOIN assigned USING (user_id) WHERE event_type = 'view'
UNION ALL
SELECT user_id, 'experiment_outcome', '{{"experiment_id":"{EXPERIMENT}","variant":"' || variant || '","outcome_type":"' ||
  CASE event_type WHEN 'click' THEN 'ctr' WHEN 'purchase' THEN 'revenue_per_recommendation' ELSE event_type END || '"' ||
  CASE WHEN event_type = 'purchase' THEN ',"value":' || value ELSE '' END || '}}'
FROM interactions JOIN assigned USING (user_id) WHERE event_type <> 'view'
UNION ALL
SELECT user_id, 'experiment_outcome', '{{"experiment_id":"{EXPERIMENT}","variant":"' || variant || '","outcome_type":"conversion_rate"}}'
FROM interactions JOIN assigned USING (user_id) WHERE event_type = 'purchase'""")
def _x4(spark, sf):
    return _log(spark, sf)


RESULTS = f"""res AS (
  SELECT v.variant, v.users, v.exposures, metric, CASE WHEN metric IN ('ctr', 'conversion_rate') THEN n / v.exposures
         WHEN metric = 'revenue_per_recommendation' THEN mean ELSE CAST(n AS DOUBLE) END AS value
  FROM (SELECT variant, count(*) AS users, (SELECT count(DISTINCT user_id) FROM interactions JOIN assigned a USING (user_id)
          WHERE event_type = 'view' AND a.variant = o.variant) AS exposures FROM assigned o GROUP BY variant) v
  JOIN (SELECT variant, m AS metric, count(*) AS n, avg(value) AS mean FROM (
          SELECT variant, value, unnest(CASE event_type WHEN 'click' THEN ['ctr'] WHEN 'purchase' THEN ['revenue_per_recommendation', 'conversion_rate']
            ELSE [event_type] END) AS m FROM interactions JOIN assigned USING (user_id) WHERE event_type <> 'view') GROUP BY ALL) USING (variant))"""


@query("x5_experiment_results", with_(INTERACTIONS, ASSIGNED, RESULTS) + f"SELECT variant, users, exposures, metric, {r6('value')} AS value FROM res")
def _x5(spark, sf):
    return ex.results(assignments(spark, sf), _log(spark, sf), EXPERIMENT).withColumn("value", rounded("value"))


@query("x6_simple_significance", with_(INTERACTIONS, ASSIGNED, RESULTS, """
p AS (SELECT metric, max(value) FILTER (variant = 'control') AS control, max(value) FILTER (variant = 'treatment') AS treatment
  FROM res WHERE metric IN ('ctr', 'conversion_rate', 'revenue_per_recommendation', 'ndcg@10') GROUP BY metric)""") + f"""
SELECT metric, {r6('control')} AS control, {r6('treatment')} AS treatment,
  abs(treatment - control) / control > 0.1 AS significant,
  CASE WHEN abs(treatment - control) / control > 0.1 THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END AS p_value FROM p""")
def _x6(spark, sf):
    out = ex.significance(ex.results(assignments(spark, sf), _log(spark, sf), EXPERIMENT), "control")
    return out.withColumn("control", rounded("control")).withColumn("treatment", rounded("treatment"))


UNITS = """units AS (SELECT user_id, variant, CASE WHEN r IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS converted, coalesce(r, 0.0) AS revenue
  FROM assigned_all LEFT JOIN (SELECT user_id, sum(value) AS r FROM interactions WHERE event_type = 'purchase' GROUP BY 1) USING (user_id))"""
ASSIGNED_ALL = ASSIGNED.replace("assigned AS", "assigned_all AS").replace("(SELECT DISTINCT user_id FROM interactions)", "users")


def _units(spark, sf):
    everyone = ex.assign(b.users(spark, sf), EXPERIMENT, ALLOCATION, MODELS)
    return ex.per_user_totals(everyone, b.interactions(spark, sf))


@query("x7_two_sample_tests", with_(INTERACTIONS, USERS, ASSIGNED_ALL, UNITS, """
s AS (SELECT count(*) FILTER (variant = 'control')::DOUBLE AS cn, sum(converted) FILTER (variant = 'control') AS cx,
  avg(revenue) FILTER (variant = 'control') AS cm, var_samp(revenue) FILTER (variant = 'control') AS cv,
  count(*) FILTER (variant <> 'control')::DOUBLE AS tn, sum(converted) FILTER (variant <> 'control') AS tx,
  avg(revenue) FILTER (variant <> 'control') AS tm, var_samp(revenue) FILTER (variant <> 'control') AS tv FROM units)""", """
z AS (SELECT *, cx / cn AS pc, tx / tn AS pt, (cx + tx) / (cn + tn) AS pp FROM s)""", """
q AS (SELECT *, (pt - pc) / sqrt(pp * (1 - pp) * (1 / cn + 1 / tn)) AS zz FROM z)""") + f"""
SELECT {r6('pc')} AS control_rate, {r6('pt')} AS treatment_rate, {r6('(pt - pc) / pc')} AS lift, {r6('zz')} AS z,
  {r6('zz * zz')} AS chi_squared, abs(zz) > 1.959964 AS significant, {r6('(tm - cm) / sqrt(cv / cn + tv / tn)')} AS welch_t FROM q""")
def _x7(spark, sf):
    out = ex.two_sample_tests(_units(spark, sf), "control", "converted", "revenue")
    for c in ("control_rate", "treatment_rate", "lift", "z", "chi_squared", "welch_t"):
        out = out.withColumn(c, rounded(c))
    return out


REPLICATES = 2000


def _steps(table: str, start: str) -> list[str]:
    """One step of the finaliser per table, so that no expression holds another one twice."""
    first = f"{table}1 AS (SELECT *, (xor({start}, {start} >> 16) * {ex.MIX_1}::HUGEINT % {ex.WORD})::BIGINT AS h1 FROM {table}0)"
    second = f"{table}2 AS (SELECT *, (xor(h1, h1 >> 13) * {ex.MIX_2}::HUGEINT % {ex.WORD})::BIGINT AS h2 FROM {table}1)"
    return [first, second, f"{table} AS (SELECT *, xor(h2, h2 >> 16) AS h FROM {table}2)"]


@query("x7_bootstrap_interval", with_(INTERACTIONS, USERS, ASSIGNED_ALL, UNITS,
f"rep0 AS (SELECT r, (r * {ex.GOLDEN}::HUGEINT % {ex.WORD})::BIGINT AS c FROM (SELECT unnest(range(1, {REPLICATES + 1})) AS r))", *_steps("rep", "c"),
f"draw0 AS (SELECT variant, revenue, r, (s + rep.h) % {ex.WORD} AS c FROM (SELECT *, {word("'boot:' || user_id")} AS s FROM units) CROSS JOIN rep)", *_steps("draw", "c"), f"""
m AS (SELECT r, variant, sum(k * revenue) / sum(k) AS mean FROM (SELECT *, {' + '.join(f'(h >= {bound})::INT' for bound in ex.poisson_bounds())} AS k FROM draw) GROUP BY ALL)""", """
d AS (SELECT r, max(mean) FILTER (variant = 'treatment') - max(mean) FILTER (variant = 'control') AS difference FROM m GROUP BY r)""") + f"""
SELECT count(*) AS n, {r6('quantile_cont(difference, 0.025)')} AS low, {r6('quantile_cont(difference, 0.975)')} AS high FROM d""")
def _x7b(spark, sf):
    differences = ex.bootstrap_means(_units(spark, sf), "revenue", REPLICATES, "boot")
    # One row per replicate, so the built-in exact percentile is enough.
    return differences.agg(
        F.count("*").alias("n"),
        rounded(F.percentile("difference", F.lit(0.025))).alias("low"),
        rounded(F.percentile("difference", F.lit(0.975))).alias("high"),
    )


@query("f7_assignment_lookup", with_(INTERACTIONS, ASSIGNED) + """
SELECT 'pair' AS lookup, user_id, variant FROM assigned WHERE user_id = 7
UNION ALL SELECT 'experiment', user_id, variant FROM assigned""")
def _f7(spark, sf):
    rows = assignments(spark, sf)
    by_experiment = lookups.by_id(rows, "experiment_id", EXPERIMENT)
    pair = lookups.by_id(by_experiment, "user_id", 7).withColumn("lookup", F.lit("pair"))
    out = pair.unionByName(by_experiment.withColumn("lookup", F.lit("experiment")))
    return out.select("lookup", "user_id", "variant")


@query("d8_exposure_balance", with_(INTERACTIONS, ASSIGNED, """
e AS (SELECT variant, count(*) AS exposures FROM interactions JOIN assigned USING (user_id) WHERE event_type = 'view' GROUP BY 1)""") + f"""
SELECT '{EXPERIMENT}' AS experiment_id, variant, exposures, {r6('exposures / (SELECT sum(exposures) FROM e)')} AS share,
  exposures / (SELECT sum(exposures) FROM e) NOT BETWEEN 0.4 AND 0.6 AS imbalanced FROM e""")
def _d8(spark, sf):
    shown = b.interactions(spark, sf).where("event_type = 'view'").join(assignments(spark, sf), "user_id")
    return ex.exposure_balance(shown).withColumn("share", rounded("share"))


@query("d10_business_gauges", with_(INTERACTIONS, PRODUCTS, ASSIGNED) + f"""
SELECT '{EXPERIMENT}' AS experiment_id, variant, {RATES},
  {r6(ratio("count(*) FILTER (event_type = 'add_to_cart')", "count(*) FILTER (event_type = 'view')"))} AS add_to_cart_rate,
  {r6("count(DISTINCT item_id) / (SELECT count(*) FROM products)")} AS coverage
FROM interactions JOIN assigned USING (user_id) GROUP BY variant""")
def _d10(spark, sf):
    events = b.interactions(spark, sf).join(assignments(spark, sf), "user_id")
    keys = ["experiment_id", "variant"]
    rates = show_rates(ev.business_rates(events, keys))
    carts = events.groupBy(*keys).agg(F.count(F.when(F.col("event_type") == "add_to_cart", 1)).alias("_carts"))
    seen = events.select(*keys, "item_id").distinct().groupBy(*keys).agg(F.count("*").alias("_items"))
    size = b.products(spark, sf).agg(F.count("*").alias("n")).scalar()
    joined = rates.join(carts, keys).join(seen, keys)
    return joined.select(
        *rates.columns,
        rounded(F.when(F.col("impressions") > 0, F.col("_carts") / F.col("impressions")).otherwise(0.0)).alias("add_to_cart_rate"),
        rounded(F.col("_items") / size).alias("coverage"),
    )


@query("d10_experiment_gauges", with_(INTERACTIONS, PRODUCTS, ASSIGNED, f"""
shown AS (SELECT '{EXPERIMENT}' AS experiment_id, item_id FROM interactions JOIN assigned USING (user_id) WHERE event_type = 'view')""", """
c AS (SELECT experiment_id, category, count(*) AS n FROM shown JOIN products USING (item_id) GROUP BY ALL)""", """
p AS (SELECT *, n / sum(n) OVER (PARTITION BY experiment_id) AS p FROM c)""") + f"""
SELECT experiment_id, (SELECT count(*) FROM shown) AS exposures,
  {r6("(SELECT count(DISTINCT item_id) FROM shown JOIN products USING (item_id)) / (SELECT count(*) FROM products)")} AS coverage,
  {r6("sum(-p * ln(p))")} AS diversity FROM p GROUP BY experiment_id""")
def _d10e(spark, sf):
    events = b.interactions(spark, sf).where("event_type = 'view'").join(assignments(spark, sf), "user_id")
    out = ev.exposure_gauges(events, b.products(spark, sf), ["experiment_id"])
    return out.withColumn("coverage", rounded("coverage")).withColumn("diversity", rounded("diversity"))
