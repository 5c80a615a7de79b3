"""Hand-made frames for the operators."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brightshelf.functions.scalar import md5_mod_10000, safe_divide
from brightshelf.operators import (
    alerts, asof, combine, drift, evaluation as ev, experiments as ex, features as feat, filters, models, quality, samples, topk,
)
from brightshelf.operators.ordered import contiguous_index

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (user, item, type, hours after T0, value)"""
    data = [(n, u, i, t, T0 + timedelta(hours=h), v) for n, (u, i, t, h, v) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id bigint, user_id bigint, item_id bigint, event_type string, ts timestamp, value double")


def test_md5_modulus_equals_big_integer(spark):
    ids = [f"exp:{i}" for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").select("id", md5_mod_10000(F.col("id")).alias("m"))
    assert all(r.m == int(hashlib.md5(r.id.encode()).hexdigest(), 16) % 10000 for r in df.collect())


def test_safe_divide(spark):
    row = spark.range(1).select(safe_divide(F.lit(3), F.lit(0)).alias("a"), safe_divide(F.lit(3), F.lit(2)).alias("b")).first()
    assert (row.a, row.b) == (0.0, 1.5)


def scores(spark, rows):
    return spark.createDataFrame(rows, "item_id string, score double")


def test_new_user_anchor(spark):
    popular, trending = scores(spark, [("item_3", 1.0), ("item_4", 0.8)]), scores(spark, [("item_5", 0.9)])
    by_category = spark.createDataFrame(
        [("category_1", "item_6", 0.7), ("category_1", "item_7", 0.6)], "category string, item_id string, score double"
    )
    lists = combine.new_user_lists_by_category(popular, trending, by_category, 5)
    got = [(r.item_id, round(r.score, 6)) for r in lists.orderBy("rank").collect()]
    assert got == [("item_5", 1.08), ("item_6", 1.05), ("item_3", 1.0), ("item_7", 0.9), ("item_4", 0.8)]
    plain = [r.item_id for r in combine.new_user_list(popular, trending, 2).orderBy("rank").collect()]
    assert plain == ["item_5", "item_3"]


def test_weights():
    assert combine.recommender_weights() == pytest.approx({"collaborative": 0.35, "content": 0.25, "popularity": 0.15, "embedding": 0.25})
    custom = combine.recommender_weights({"collaborative": 5, "content": 3, "popularity": 1, "embedding": 1})
    assert custom == pytest.approx({"collaborative": 0.5, "content": 0.3, "popularity": 0.1, "embedding": 0.1})
    with pytest.raises(ValueError):
        combine.recommender_weights(dict.fromkeys(combine.RECOMMENDER_WEIGHTS, 0.0))
    assert combine.generator_weights(["a", "b"]) == {"a": 0.5, "b": 0.5}
    assert combine.generator_weights(["a", "b"], [0, 0]) == {"a": 0.0, "b": 0.0}
    with pytest.raises(ValueError):
        combine.generator_weights(["a"], [1, 2])


def test_weight_zero_generator_is_not_run(spark):
    ok = spark.createDataFrame([(1, "x", 2.0)], "user_id bigint, item_id string, score double")
    asked = []

    def good(n):
        asked.append(n)
        return ok

    def never(n):
        raise AssertionError("asked")

    out = combine.hybrid_generator({"a": good, "b": never}, 4, [1.0, 0.0]).collect()
    assert asked == [12] and out[0].score == 2.0
    assert combine.by_source("nothing", {"popularity": good}, 4) is None


def test_ties_go_to_the_lower_id(spark):
    df = spark.createDataFrame([(1, i, 0.3 + 1e-12 * i) for i in (5, 2, 9)], "user_id bigint, item_id bigint, score double")
    assert [r.item_id for r in topk.top_k(df, 2, ["user_id"]).orderBy("rank").collect()] == [2, 5]


def test_product_with_no_views_and_tied_time(spark):
    df = events(spark, [(1, 7, "purchase", 0, 5.0), (1, 8, "view", 48, 0.0)])
    rows = {r.item_id: r for r in feat.product_window_features(df, 1).collect()}
    assert rows[7].conversion_rate == 0.0 and rows[7].days_since_last_interaction == 2 and rows[7].interactions_last_1d == 0
    assert rows[8].interactions_last_1d == 1 and rows[8].interaction_ratio_last_1d == 1.0


def test_decay_halves(spark):
    df = events(spark, [(1, 7, "purchase", 0, 0.0), (1, 8, "odd", 24, 0.0)])
    got = {r.item_id: r.score for r in feat.decayed_popularity(df, 1.0).collect()}
    assert got[7] == pytest.approx(1.5) and got[8] == pytest.approx(1.0)


def test_asof_carries_over_buckets(spark):
    spine = spark.createDataFrame(
        [(1, "a", T0), (2, "a", T0 + timedelta(days=5)), (3, "a", T0 - timedelta(days=1)), (4, "b", T0), (5, None, T0)],
        "id bigint, k string, ts timestamp",
    )
    feats = spark.createDataFrame(
        [("a", T0, 1), ("a", T0 + timedelta(days=1, hours=1), 2), ("a", T0 + timedelta(days=6), 3)], "k string, feature_ts timestamp, x bigint"
    )
    got = {r.id: r.x for r in asof.asof_join(spine, feats, "k", ["x"]).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None, 5: None}
    assert asof.latest(feats, "k", ["x"]).first().x == 3


def test_filters(spark):
    recs = spark.createDataFrame([(1, i, 1.0 - i / 10, i + 1) for i in range(5)], "user_id bigint, item_id bigint, score double, rank bigint")
    products = spark.createDataFrame([(i, "c" if i < 4 else "d", 0 if i == 1 else 5) for i in range(5)], "item_id bigint, category string, inventory bigint")
    assert {(r.item_id, r["rank"]) for r in filters.drop_unavailable(recs, products).collect()} == {(0, 1), (2, 2), (3, 3), (4, 4)}
    assert {(r.item_id, r["rank"]) for r in filters.limit_per_category(recs, products, 2).collect()} == {(0, 1), (1, 2), (4, 3)}
    bought = events(spark, [(1, 0, "purchase", 0, 1.0), (1, 2, "purchase", 30, 1.0)])
    left = filters.drop_recently_purchased(recs, bought, feat.max_ts(bought))
    assert {r.item_id for r in left.collect()} == {0, 1, 3, 4}


def catalogue_frame(spark, n):
    return spark.range(n).select(F.col("id").alias("item_id"))


def test_negatives_avoid_history_and_cover_the_rest(spark):
    hot = [(1, i) for i in range(0, 60, 2)]
    full = [(2, i) for i in range(60)]
    pairs = spark.createDataFrame(hot + full + [(3, 59)], "user_id bigint, item_id bigint")
    out = samples.negatives_with_replacement(pairs, catalogue_frame(spark, 60), 40).collect()
    seen = set(hot) | set(full) | {(3, 59)}
    assert all((r.user_id, r.negative_item_id) not in seen for r in out)
    assert len(out) == (len(hot) + 1) * 40  # user 2 has interacted with everything
    assert {r.negative_item_id for r in out if r.user_id == 1} == set(range(1, 60, 2))


def test_negatives_without_replacement_are_distinct(spark):
    rows = [(1, i, "view", i, 0.0) for i in range(57)] + [(2, 5, "view", 1, 0.0)]
    out = samples.negatives_without_replacement(events(spark, rows), catalogue_frame(spark, 60)).toPandas()
    per_event = out.groupby("event_id")["negative_item_id"]
    assert (per_event.nunique() == per_event.size()).all()
    assert set(out[out.user_id == 1]["negative_item_id"]) == {57, 58, 59}  # three are left, so three are drawn
    assert (out[out.user_id == 2].groupby("event_id").size() == 4).all()


def test_ranges_are_the_whole_complement(spark):
    pairs = spark.createDataFrame([(1, 0), (1, 1), (1, 9), (2, 4)], "user_id bigint, item_id bigint")
    rows = samples.not_interacted_ranges(pairs, contiguous_index(catalogue_frame(spark, 10), "item_id")).collect()
    items = {(r.user_id, x + r.shift) for r in rows for x in range(r.start, r.end)}
    assert items == {(1, i) for i in range(2, 9)} | {(2, i) for i in range(10) if i != 4}


def test_global_negatives_with_a_dense_table(spark):
    rows = [(u, i, "view", 0, 0.0) for u in range(10) for i in range(10) if (u + i) % 10]
    out = samples.global_negatives(events(spark, rows), ratio=1).collect()
    assert out and all((r.user_id + r.item_id) % 10 == 0 for r in out) and len(out) <= 90


def test_stratified_split_is_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = samples.stratified_split(df, "id", "label").groupBy("label").agg(F.count(F.when(F.col("is_test"), 1)).alias("n"))
    assert {r.label: r.n for r in got.collect()} == {0: 180, 1: 20}


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("x"))
    a, b = samples.fingerprint(df).first(), samples.fingerprint(df.orderBy(F.desc("id")).repartition(7)).first()
    c = samples.fingerprint(df.withColumn("x", F.col("x") + (F.col("id") == 3).cast("int"))).first()
    assert a == b and a.version != c.version


def test_metrics(spark):
    recs = spark.createDataFrame([(1, i, i) for i in range(1, 12)], "user_id bigint, item_id bigint, rank bigint").withColumn("source", F.lit("s"))
    truth = spark.createDataFrame([(1, 1), (1, 4), (1, 11), (2, 1)], "user_id bigint, item_id bigint")
    got = {(r.source, r.metric): r.value for r in ev.hit_and_mrr(recs, truth, ["s", "none"]).collect()}
    assert got[("s", "hit_at_1")] == 0.25 and got[("s", "hit_at_5")] == 0.5 and got[("s", "mrr")] == pytest.approx(1.25 / 4)
    assert got[("none", "mrr")] == 0.0
    m = ev.precision_recall_map(recs, truth, 10).first()
    assert m.precision == pytest.approx(0.1) and m["map"] == pytest.approx((1 + 2 / 4) / 3 / 2)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_binary_metrics_edges(spark):
    assert ev.binary_metrics(labelled(spark, []), "label", "score").first().asDict() == {"n": 0, **ev.NO_SAMPLE_METRICS}
    one = ev.binary_metrics(labelled(spark, [(1, 0.9), (1, 0.1)]), "label", "score").first()
    assert one.auc == 0.5 and one.recall == 0.5 and one.precision == 1.0
    tied = ev.binary_metrics(labelled(spark, [(1, 0.5), (0, 0.5), (1, 0.8), (0, 0.1)]), "label", "score").first()
    assert tied.auc == pytest.approx(0.875)


def test_gini(spark):
    equal = spark.createDataFrame([(i, 4) for i in range(5)], "i int, n int")
    one = spark.createDataFrame([(i, 10 if i == 0 else 0) for i in range(5)], "i int, n int")
    assert ev.gini(equal, "n").first().gini == pytest.approx(0.0)
    assert ev.gini(one, "n").first().gini == pytest.approx(0.8)


def test_allocation_bounds_and_sticky(spark):
    assert ex.cumulative_bounds([]) == [("control", 0.5), ("treatment", 1.0)]
    assert [round(b, 6) for _, b in ex.cumulative_bounds([("a", 0), ("b", 0), ("c", 0)])] == [0.333333, 0.666667, 1.0]
    users = spark.range(4).select(F.col("id").alias("user_id"))
    stored = spark.createDataFrame([("e", 2, "old", None), ("other", 3, "old", "m")], "experiment_id string, user_id bigint, variant string, model_version string")
    got = {r.user_id: r for r in ex.assign_sticky(users, stored, "e", [("new", 1.0)], {"new": "m2"}).collect()}
    assert got[2].variant == "old" and got[2].model_version is None and not got[2].is_new
    assert got[3].variant == "new" and got[3].model_version == "m2" and got[3].is_new


def test_significance_needs_two_variants(spark):
    schema = "variant string, users bigint, exposures bigint, metric string, value double"
    two = spark.createDataFrame([("control", 1, 1, "ctr", 0.10), ("treatment", 1, 1, "ctr", 0.12)], schema)
    row = ex.significance(two, "control").first()
    assert row.significant and row.p_value == 0.05
    assert ex.significance(two.where("variant = 'control'"), "control").count() == 0


def test_drift_of_equal_tables_is_zero(spark):
    df = spark.range(500).select((F.col("id") % 37).cast("double").alias("a"))
    same = drift.feature_drift(df, df, ["a"]).first()
    assert same.ks == 0.0 and same.psi == pytest.approx(0.0) and not same.drifted
    moved = drift.feature_drift(df, df.select((F.col("a") + 40).alias("a")), ["a"]).first()
    assert moved.ks == 1.0 and moved.drifted


def test_alert_holds_only_over_unbroken_windows(spark):
    w = spark.createDataFrame([(0, 1), (300, 1), (600, 1), (900, 0), (1200, 1), (1500, 1), (2100, 1)], "window_start bigint, bad int")
    got = [r.window_start for r in alerts.held_for(w, F.col("bad") == 1, 3).collect()]
    assert got == [600]
    assert alerts.held_for(w, F.col("bad") == 1, 1).count() == 6


def test_quality(spark):
    df = events(spark, [(1, 7, "view", 0, 1.0), (-1, 7, "teleport", 0, 1.0)])
    valid, bad = quality.split_valid(df, quality.event_rules())
    assert valid.count() == 1 and bad.first().failed == ["user_id", "event_type"]
    with pytest.raises(ValueError, match="nope"):
        quality.require_columns(df, ["user_id", "nope"])


def test_rankers(spark):
    with pytest.raises(ValueError):
        models.ranker("catboost", ["x"])
    rows = spark.range(200).select((F.col("id") / 200).alias("x"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") > 100).cast("int").alias("label"))
    model = models.ranker("xgboost", ["x", "y"], rounds=3).fit(rows)
    importance = dict(models.feature_importance(model))
    assert importance["x"] > importance["y"]
    assert ev.auc(models.score(model, rows), "label", "score").first().auc > 0.95
