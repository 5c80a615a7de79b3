"""A/B experiments: assignment, exposure and outcome rows, results and tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brightshelf.functions.scalar import count_when, md5_mod_10000, md5_word, safe_divide

# Outcome types that are rates per exposed user, and those that are means.
RATE_OUTCOMES = ["ctr", "conversion_rate"]
MEAN_OUTCOMES = ["revenue_per_recommendation", "ndcg@10", "avg_latency_ms"]

# Metrics compared between two variants, and the simplified rule.
COMPARED_METRICS = ["ctr", "conversion_rate", "revenue_per_recommendation", "ndcg@10"]
SIGNIFICANT_LIFT = 0.1
P_SIGNIFICANT, P_NOT_SIGNIFICANT = 0.05, 0.5

METADATA_DDL = "experiment_id string, variant string, outcome_type string, value double"


def cumulative_bounds(allocation: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """(variant, upper bound) in configured order; an empty allocation is 50/50, a zero one is equal."""
    allocation = allocation or [("control", 0.5), ("treatment", 0.5)]
    total = sum(share for _, share in allocation)
    bounds, upper = [], 0.0
    for variant, share in allocation:
        upper += share / total if total else 1.0 / len(allocation)
        bounds.append((variant, upper))
    return bounds


def variant_of(experiment: Column, user: Column, allocation: list[tuple[str, float]]) -> Column:
    """Variant by md5 of "experiment:user" against the cumulative allocation; the last one is the default."""
    draw = md5_mod_10000(F.concat_ws(":", experiment, user.cast("string"))) / F.lit(10000.0)
    bounds = cumulative_bounds(allocation)
    choice = F.lit(bounds[-1][0])
    for variant, upper in reversed(bounds):
        choice = F.when(draw < upper, F.lit(variant)).otherwise(choice)
    return choice


def assign(users: DataFrame, experiment_id: str, allocation: list[tuple[str, float]], models: dict[str, str]) -> DataFrame:
    """(experiment_id, user_id, variant, model_version) for every user."""
    experiment = F.lit(experiment_id)
    out = users.select(experiment.alias("experiment_id"), "user_id", variant_of(experiment, F.col("user_id"), allocation).alias("variant"))
    model = F.lit(None).cast("string")
    for variant, version in models.items():
        model = F.when(F.col("variant") == variant, F.lit(version)).otherwise(model)
    return out.withColumn("model_version", model)


def assign_sticky(users: DataFrame, existing: DataFrame, experiment_id: str, allocation: list[tuple[str, float]], models: dict[str, str]) -> DataFrame:
    """As `assign`, but a user with a stored row keeps it; `is_new` marks rows to append."""
    fresh = assign(users, experiment_id, allocation, models)
    kept = existing.where(F.col("experiment_id") == experiment_id).select(
        "user_id", F.col("variant").alias("_v"), F.col("model_version").alias("_m")
    )
    joined = fresh.join(kept, "user_id", "left")
    known = F.col("_v").isNotNull()
    return joined.select(
        "experiment_id", "user_id",
        F.coalesce("_v", "variant").alias("variant"),
        F.when(known, F.col("_m")).otherwise(F.col("model_version")).alias("model_version"),
        (~known).alias("is_new"),
    )


def get_or_create(experiments: DataFrame, experiment_id: str, defaults: dict[str, str]) -> DataFrame:
    """The row of an experiment, or a new row made of the defaults when there is none."""
    found = experiments.where(F.col("experiment_id") == experiment_id)
    columns = [
        F.lit(experiment_id if f.name == "experiment_id" else defaults.get(f.name)).cast(f.dataType).alias(f.name)
        for f in experiments.schema
    ]
    known = found.agg(F.count("*").alias("n")).scalar()
    created = experiments.sparkSession.range(1).where(known == 0).select(*columns)
    return found.unionByName(created)


def exposure_rows(shown: DataFrame) -> DataFrame:
    """Exposure events; details travel as JSON metadata."""
    return shown.select(
        "user_id", F.lit("experiment_exposure").alias("event_type"),
        F.to_json(F.struct("experiment_id", "variant")).alias("metadata"),
    )


def outcome_rows(outcomes: DataFrame) -> DataFrame:
    """Outcome events; a null value is left out of the metadata."""
    return outcomes.select(
        "user_id", F.lit("experiment_outcome").alias("event_type"),
        F.to_json(F.struct("experiment_id", "variant", "outcome_type", "value")).alias("metadata"),
    )


def results(assignments: DataFrame, log: DataFrame, experiment_id: str) -> DataFrame:
    """Long table (variant, users, exposures, metric, value) of one experiment.

    Only variants with assignments are reported. Exposed users are made distinct before
    they are counted per variant, so the few variant keys see pre-aggregated rows.
    """
    parsed = log.select("user_id", "event_type", F.from_json("metadata", METADATA_DDL).alias("m")).where(
        F.col("m.experiment_id") == experiment_id
    )
    assigned = assignments.where(F.col("experiment_id") == experiment_id).select("user_id", "variant").distinct()
    exposed = parsed.where(F.col("event_type") == "experiment_exposure").select("user_id", F.col("m.variant").alias("variant")).distinct()
    both = exposed.join(assigned.withColumn("_a", F.lit(1)), ["user_id", "variant"], "left")
    exposure = both.groupBy("variant").agg(F.count("*").alias("exposures"), F.count("_a").alias("_exposed_assigned"))
    users = assigned.groupBy("variant").agg(F.count("*").alias("users"))
    outcomes = (
        parsed.where(F.col("event_type") == "experiment_outcome")
        .groupBy(F.col("m.variant").alias("variant"), F.col("m.outcome_type").alias("metric"))
        .agg(F.count("*").alias("_n"), F.avg("m.value").alias("_mean"))
    )
    joined = users.join(exposure, "variant", "left").join(outcomes, "variant", "left").fillna(0, subset=["exposures", "_exposed_assigned"])
    value = (
        F.when(F.col("metric").isin(RATE_OUTCOMES), safe_divide(F.col("_n"), F.col("_exposed_assigned")))
        .when(F.col("metric").isin(MEAN_OUTCOMES), F.coalesce(F.col("_mean"), F.lit(0.0)))
        .otherwise(F.col("_n").cast("double"))
    )
    return joined.select("variant", "users", "exposures", "metric", value.alias("value"))


def significance(result: DataFrame, control: str) -> DataFrame:
    """Simplified comparison per metric, only where exactly two variants have results."""
    variants = result.agg(F.countDistinct("variant").alias("n")).scalar()
    by_metric = result.where(F.col("metric").isin(COMPARED_METRICS)).groupBy("metric").agg(
        F.coalesce(F.max(F.when(F.col("variant") == control, F.col("value"))), F.lit(0.0)).alias("control"),
        F.coalesce(F.max(F.when(F.col("variant") != control, F.col("value"))), F.lit(0.0)).alias("treatment"),
    )
    lift = F.abs(F.col("treatment") - F.col("control")) / F.col("control")
    both = (F.col("control") > 0) & (F.col("treatment") > 0)
    decided = by_metric.withColumn("_n", variants).where("_n = 2").withColumn(
        "significant", F.when(both, lift > SIGNIFICANT_LIFT).otherwise(F.lit(False))
    )
    return decided.select(
        "metric", "control", "treatment", "significant",
        F.when(F.col("significant"), P_SIGNIFICANT).otherwise(P_NOT_SIGNIFICANT).alias("p_value"),
    )


def exposure_balance(exposures: DataFrame, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """Share of exposures per (experiment, variant), flagged outside the bounds."""
    counts = exposures.groupBy("experiment_id", "variant").agg(F.count("*").alias("exposures"))
    # One row per variant is left, so an experiment's window is short.
    total = F.sum("exposures").over(Window.partitionBy("experiment_id"))
    share = counts.withColumn("share", F.col("exposures") / total)
    return share.withColumn("imbalanced", (F.col("share") < low) | (F.col("share") > high))


def per_user_totals(assignments: DataFrame, events: DataFrame) -> DataFrame:
    """(user_id, variant, converted 0/1, revenue): the unit of analysis of the tests below."""
    bought = events.where(F.col("event_type") == "purchase").groupBy("user_id").agg(F.sum("value").alias("revenue"))
    return assignments.select("user_id", "variant").join(bought, "user_id", "left").select(
        "user_id", "variant",
        F.when(F.col("revenue").isNotNull(), 1.0).otherwise(0.0).alias("converted"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
    )


def two_sample_tests(units: DataFrame, control: str, binary: str, measure: str) -> DataFrame:
    """Lift, two-proportion z, 2x2 chi-squared and Welch t, from one pass of sums."""
    is_control = F.col("variant") == control

    def side(condition: Column, p: str) -> list[Column]:
        return [
            count_when(condition).cast("double").alias(f"{p}n"),
            F.sum(F.when(condition, F.col(binary))).alias(f"{p}x"),
            F.avg(F.when(condition, F.col(measure))).alias(f"{p}m"),
            F.var_samp(F.when(condition, F.col(measure))).alias(f"{p}v"),
        ]

    s = units.agg(*side(is_control, "c"), *side(~is_control, "t"))
    pc, pt = F.col("cx") / F.col("cn"), F.col("tx") / F.col("tn")
    pooled = (F.col("cx") + F.col("tx")) / (F.col("cn") + F.col("tn"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("cn") + 1 / F.col("tn")))
    z = F.when(se > 0, (pt - pc) / se).otherwise(F.lit(0.0))
    spread = F.sqrt(F.col("cv") / F.col("cn") + F.col("tv") / F.col("tn"))
    t = F.when(spread > 0, (F.col("tm") - F.col("cm")) / spread).otherwise(F.lit(0.0))
    return s.select(
        pc.alias("control_rate"), pt.alias("treatment_rate"),
        safe_divide(pt - pc, pc).alias("lift"),
        z.alias("z"), (z * z).alias("chi_squared"), (F.abs(z) > 1.959964).alias("significant"),
        t.alias("welch_t"),
    )


# The finaliser of MurmurHash3 (32 bits), and the step between counters.
MIX_1, MIX_2, GOLDEN = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B9
WORD = 2**32
DRAW_CELLS = 1 << 20  # draws held at once by a task
MERGE_TASKS = 32


def poisson_bounds() -> list[int]:
    """A 32-bit draw at or above the k-th bound counts more than k: Poisson(1), exact to 1e-9."""
    bounds, cumulative, term = [], 0.0, math.exp(-1)
    for k in range(12):
        cumulative += term
        bounds.append(math.ceil(cumulative * WORD))
        term /= k + 1
    return bounds


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser on 32-bit values held in 64 bits."""
    h = (h ^ (h >> np.uint64(16))) * np.uint64(MIX_1) & np.uint64(WORD - 1)
    h = (h ^ (h >> np.uint64(13))) * np.uint64(MIX_2) & np.uint64(WORD - 1)
    return h ^ (h >> np.uint64(16))


def poisson_weights(seeds: np.ndarray, replicates: int) -> np.ndarray:
    """seed x replicate counts, each from the seed and the replicate's number (from 1) alone."""
    counter = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(GOLDEN) & np.uint64(WORD - 1)
    draws = _mixed((seeds[:, None] + _mixed(counter)) & np.uint64(WORD - 1))
    return np.searchsorted(np.array(poisson_bounds(), np.uint64), draws.ravel(), "right").reshape(draws.shape).astype(np.float64)


SUMS_DDL = "variant string, weights array<double>, totals array<double>"


def _sums_batch(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = sorted(sums)
    columns = [pa.array([sums[v][i].tolist() for v in names], pa.list_(pa.float64())) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], names=["variant", "weights", "totals"])


def _merged_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for v, w, t in zip(*[batch.column(n).to_pylist() for n in ("variant", "weights", "totals")]):
            sums[v] = sums.get(v, 0.0) + np.array([w, t])
    yield _sums_batch(sums)


def bootstrap_sums(units: DataFrame, measure: str, replicates: int, seed: str) -> DataFrame:
    """Per variant the sum of weights and of weighted measures of every replicate, as two arrays.

    Every unit draws its own Poisson(1) weight per replicate from a hash, so a replicate is a weighted
    sum. A task adds up all replicates while it reads its units and hands on one row per variant, so
    no unit is ever copied per replicate; rows are merged by element, first in up to `MERGE_TASKS`
    tasks, whose few rows are merged in one. Units without an id, variant or measure are left out.
    """
    text = F.concat_ws(":", F.lit(seed), F.col("user_id").cast("string"))
    source = units.where(F.col("user_id").isNotNull()).select("variant", F.col(measure).cast("double").alias("x"), md5_word(text).alias("seed")).dropna()

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        step = max(1, DRAW_CELLS // replicates)
        for batch in batches:
            variant = batch.column("variant").to_numpy(zero_copy_only=False)
            x, seeds = batch.column("x").to_numpy(), batch.column("seed").to_numpy().astype(np.uint64)
            for v in set(variant.tolist()):
                at = np.flatnonzero(variant == v)
                for i in range(0, len(at), step):
                    part = at[i : i + step]
                    weights = poisson_weights(seeds[part], replicates)
                    sums[v] = sums.get(v, 0.0) + np.stack([weights.sum(axis=0), x[part] @ weights])
        yield _sums_batch(sums)

    partial = source.mapInArrow(run, SUMS_DDL)
    return partial.repartition(MERGE_TASKS).mapInArrow(_merged_sums, SUMS_DDL).repartition(1).mapInArrow(_merged_sums, SUMS_DDL)


def bootstrap_means(units: DataFrame, measure: str, replicates: int, seed: str, control: str = "control", treatment: str = "treatment") -> DataFrame:
    """Bootstrap difference of means per replicate: (replicate, difference).

    Null where a replicate gives all units of a side the weight zero; without units of both sides no rows.
    """
    sums = bootstrap_sums(units, measure, replicates, seed)
    mean = F.transform(F.arrays_zip("weights", "totals"), lambda s: F.when(s["weights"] > 0, s["totals"] / s["weights"]))
    sides = sums.select("variant", mean.alias("mean")).groupBy().agg(
        F.max(F.when(F.col("variant") == treatment, F.col("mean"))).alias("t"), F.max(F.when(F.col("variant") == control, F.col("mean"))).alias("c")
    )
    zipped = sides.where("t IS NOT NULL AND c IS NOT NULL").select(F.posexplode(F.arrays_zip("t", "c")).alias("i", "m"))
    return zipped.select((F.col("i") + 1).cast("bigint").alias("replicate"), (F.col("m.t") - F.col("m.c")).alias("difference"))
