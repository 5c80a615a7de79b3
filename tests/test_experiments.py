"""Bootstrap sums and exposure gauges against brute force, with nulls, ties and empty tables."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from brightshelf.functions.scalar import md5_word
from brightshelf.operators import evaluation as ev, experiments as ex

UNITS = "user_id bigint, variant string, revenue double"


def test_weights_are_poisson():
    weights = ex.poisson_weights(np.arange(7, 4007, dtype=np.uint64) * np.uint64(2654435), 500)
    assert abs(weights.mean() - 1) < 0.005 and abs(weights.var() - 1) < 0.01
    for k, share in enumerate([math.exp(-1), math.exp(-1), math.exp(-1) / 2, math.exp(-1) / 6]):
        assert abs((weights == k).mean() - share) < 0.003
    # Units and replicates are drawn apart from each other.
    assert np.abs(np.corrcoef(weights[:40])[np.triu_indices(40, 1)]).max() < 0.25
    assert np.abs(np.corrcoef(weights.T[:40])[np.triu_indices(40, 1)]).max() < 0.1


def test_bootstrap_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["control", "treatment", "other"]), rng.choice([0.0, 0.0, 2.5, 40.0])) for i in range(900)]
    rows += [(None, "control", 1.0), (5000, None, 1.0), (5001, "treatment", None), rows[0]]
    units = spark.createDataFrame(rows, UNITS).repartition(7)
    got = {r.replicate: r.difference for r in ex.bootstrap_means(units, "revenue", 2000, "s").collect()}
    seeds = {r.user_id: r.s for r in units.select("user_id", md5_word(F.concat_ws(":", F.lit("s"), F.col("user_id").cast("string"))).alias("s")).collect()}
    used = [r for r in rows if None not in r]
    weights = ex.poisson_weights(np.array([seeds[u] for u, _, _ in used], np.uint64), 2000)
    side = np.array([v for _, v, _ in used])
    x = np.array([r for _, _, r in used])
    mean = {v: x[side == v] @ weights[side == v] / weights[side == v].sum(axis=0) for v in ("control", "treatment")}
    assert sorted(got) == list(range(1, 2001))
    assert np.allclose([got[r] for r in range(1, 2001)], mean["treatment"] - mean["control"])


def test_bootstrap_interval_covers_the_normal_one(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "control" if i % 2 else "treatment", float(v)) for i, v in enumerate(rng.exponential(10, 4000))]
    got = [r.difference for r in ex.bootstrap_means(spark.createDataFrame(rows, UNITS), "revenue", 2000, "b").collect()]
    c, t = (np.array([x for _, v, x in rows if v == name]) for name in ("control", "treatment"))
    spread = math.sqrt(c.var() / len(c) + t.var() / len(t))
    assert abs(np.std(got) / spread - 1) < 0.06
    assert abs(np.mean(got) - (t.mean() - c.mean())) < 0.1 * spread


def test_bootstrap_without_a_side_is_empty(spark):
    assert ex.bootstrap_means(spark.createDataFrame([], UNITS), "revenue", 2000, "s").count() == 0
    assert ex.bootstrap_means(spark.createDataFrame([(1, "control", 2.0)], UNITS), "revenue", 2000, "s").count() == 0


def test_bootstrap_has_no_row_per_replicate(spark):
    units = spark.range(50_000).select(F.col("id").alias("user_id"), F.lit("control").alias("variant"), F.lit(1.0).alias("revenue")).repartition(6)
    sums = ex.bootstrap_sums(units, "revenue", 2000, "s")
    row = sums.collect()
    assert len(row) == 1 and len(row[0].weights) == 2000 and row[0].weights == row[0].totals
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_exposure_gauges(spark):
    catalogue = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c"), (1, "a")], "item_id bigint, category string")
    shown = [("e", 1)] * 6 + [("e", 3)] * 3 + [("e", 4), ("e", 99), ("e", None), ("f", 99), (None, 2)]
    got = {r.experiment_id: r for r in ev.exposure_gauges(spark.createDataFrame(shown, "experiment_id string, item_id bigint"), catalogue, ["experiment_id"]).collect()}
    entropy = -sum(p * math.log(p) for p in (0.6, 0.3, 0.1))
    assert got["e"].exposures == 12 and got["e"].coverage == 0.6 and abs(got["e"].diversity - entropy) < 1e-12
    assert (got["f"].exposures, got["f"].coverage, got["f"].diversity) == (1, 0.0, 0.0)
    assert (got[None].exposures, got[None].coverage, got[None].diversity) == (1, 0.2, 0.0)
    empty = ev.exposure_gauges(spark.createDataFrame([], "experiment_id string, item_id bigint"), catalogue, ["experiment_id"])
    assert empty.count() == 0
