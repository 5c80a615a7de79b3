"""Models against brute force, and the registered training queries with the operators' own rounds."""

import glob
import inspect
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from brightshelf import session
from brightshelf.operators import boosting, classifier, factors, models, neural
from brightshelf.queries import training
from tests.test_queries import QUERIES, SF


@pytest.fixture
def asked(monkeypatch):
    """Names and rounds of the rankers asked for; they are fitted with two rounds only."""
    seen, real = [], models.ranker

    def ranker(name, features, seed=42, rounds=models.BOOST_ROUNDS):
        seen.append((name, rounds))
        return real(name, features, seed, rounds=2)

    monkeypatch.setattr(training.models, "ranker", ranker)
    return seen


def test_every_known_name_has_rows(spark, asked):
    rows = QUERIES["t13_t16_rankers_by_name"](spark, SF).collect()
    assert sorted((r.ranker, r.label) for r in rows) == sorted((name, label) for name in models.RANKERS for label in (0, 1))
    kinds = list(dict.fromkeys(models.RANKERS.values()))
    assert [(models.RANKERS[name], rounds) for name, rounds in asked] == [(kind, models.BOOST_ROUNDS) for kind in kinds]


@pytest.mark.parametrize("name", ["t10_pairwise_ranker", "t15_feature_importance"])
def test_rounds_are_the_default(spark, asked, name):
    assert QUERIES[name](spark, SF).count() > 0
    assert [rounds for _, rounds in asked] == [models.BOOST_ROUNDS]


def test_defaults_are_the_production_values():
    assert inspect.signature(boosting.fit_listwise).parameters["rounds"].default == models.BOOST_ROUNDS == 100
    assert inspect.signature(factors.train_embeddings).parameters["epochs"].default == factors.EPOCHS == 10
    assert inspect.signature(neural.fit_network).parameters["epochs"].default == neural.EPOCHS == 10


# --- lambda gradients -----------------------------------------------------------------------


def brute_gradients(rows, head):
    lists, out = defaultdict(list), {}
    for user, item, rel, score in rows:
        lists[user].append((item, rel, score))
        out[user, item] = [0.0, 0.0]
    for user, members in lists.items():
        members.sort(key=lambda m: (-m[2], m[0]))
        best = sorted((2**m[1] - 1 for m in members), reverse=True)[:head]
        ideal = sum(g / math.log2(k + 2) for k, g in enumerate(best))
        weight = [1 / math.log2(k + 2) if k < head else 0.0 for k in range(len(members))]
        for a in range(min(head, len(members))):
            for c in range(a + 1, len(members)):
                (i, r, s), (j, q, t) = members[a], members[c]
                if r == q or ideal == 0:
                    continue
                swap = abs(2**r - 2**q) * (weight[a] - weight[c]) / ideal
                hi, lo, gap = (((user, i), (user, j), s - t) if r > q else ((user, j), (user, i), t - s))
                wrong = 1 / (1 + math.exp(gap))
                out[hi][0] += swap * wrong
                out[lo][0] -= swap * wrong
                for key in (hi, lo):
                    out[key][1] += swap * wrong * (1 - wrong)
    return out


@pytest.mark.parametrize(("head", "piece"), [(30, 4096), (3, 4096), (5, 7), (40, 2)])
def test_gradients_against_brute_force(spark, head, piece):
    rng = random.Random(head)
    rows = [(u, f"i{k}", rng.choice([0.0, 0.0, 1.0, 3.0]), round(rng.random(), 1)) for u in range(6) for k in range(rng.choice([1, 8, 40]))]
    rows += [(9, "a", 0.0, 0.5), (9, "b", 0.0, 0.1)]
    extra = [(9, "a", None, 0.5), (None, "a", 1.0, 1.0), (9, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows + extra, "user_id long, item_id string, relevance double, score double")
    got = boosting.lambda_gradients(df, "score", head=head, piece=piece).collect()
    want = brute_gradients(rows, head)
    assert len(got) == len(want)
    for r in got:
        assert (r.gradient, r.curvature) == pytest.approx(want[r.user_id, r.item_id], abs=1e-12)


def ranked_rows(spark, users=40, items=30):
    """Lists whose order follows from a - |b|; the scale of a list says nothing."""
    rng = np.random.default_rng(2)
    rows = []
    for u in range(users):
        scale = rng.uniform(0.5, 20)  # differs by list: only the order inside one counts
        for k in range(items):
            a, b = rng.uniform(-1, 1, 2)
            rows.append((u, k, float(np.clip(np.floor(5 * (a - abs(b))), 0, 4)), float(a), float(b), float(scale)))
    return spark.createDataFrame(rows, "user_id long, item_id long, label double, a double, b double, scale double")


def mean_ndcg(rows, score):
    lists = defaultdict(list)
    for r in rows:
        lists[r.user_id].append((score(r), r.label))
    out = []
    for members in lists.values():
        dcg = lambda ls: sum((2**x - 1) / math.log2(k + 2) for k, x in enumerate(ls[:10]))
        ideal = dcg(sorted((x for _, x in members), reverse=True))
        out.append(dcg([x for _, x in sorted(members, key=lambda m: -m[0])]) / ideal if ideal else 1.0)
    return sum(out) / len(out)


def test_listwise_ranker_learns_an_interaction(spark, tmp_path):
    rows = ranked_rows(spark)
    model = models.ranker("lightgbm", ["a", "b", "scale"], rounds=12).fit(rows.where("user_id < 30"))
    test = models.score(model, rows.where("user_id >= 30")).collect()
    assert mean_ndcg(test, lambda r: r.score) > 0.9 > 0.6 > mean_ndcg(test, lambda r: hash((r.user_id, r.item_id, "x")))
    importance = dict(models.feature_importance(model))
    assert sum(importance.values()) == pytest.approx(1) and importance["scale"] < 0.2
    models.save(model, f"{tmp_path}/listwise")
    again = models.score(models.load(f"{tmp_path}/listwise"), rows.where("user_id >= 30")).collect()
    assert sorted(again) == sorted(test)


def test_split_lists_grow_the_same_trees(spark):
    rows = ranked_rows(spark, users=4, items=60)
    whole, cut = (boosting.fit_listwise(rows, ["a", "b"], relevance="label", rounds=2, leaves=4, head=10, piece=p) for p in (4096, 13))
    assert [t.feature for t in whole.trees] == [t.feature for t in cut.trees] and [t.bin for t in whole.trees] == [t.bin for t in cut.trees]
    for x, y in zip(whole.trees, cut.trees):
        assert x.value == pytest.approx(y.value, abs=1e-9)


def test_forest_without_rows_or_signal(spark):
    rows = ranked_rows(spark, users=2, items=3)
    for part in (rows.where("false"), rows.withColumn("label", F.lit(1.0))):
        model = boosting.fit_listwise(part, ["a"], relevance="label", rounds=2)
        assert {r.prediction for r in model.transform(rows).collect()} == {0.0}


def test_a_tree_forms_gradients_once_on_all_cores(spark, monkeypatch):
    """Every level formed all gradients again, in as many tasks as adaptive merging had left files: one."""
    monkeypatch.setattr(session, "TASK_LEAST", 100)
    passes, real = [], boosting._pulled
    monkeypatch.setattr(boosting, "_pulled", lambda blocks_of, *rest: passes.append(blocks_of.getNumPartitions()) or real(blocks_of, *rest))
    rows, kept = ranked_rows(spark), set(spark.sparkContext._jsc.getPersistentRDDs())
    model = boosting.fit_listwise(rows, ["a", "b", "scale"], relevance="label", rounds=12)
    assert len(model.trees) == len(passes) == 12 and set(passes) == {spark.sparkContext.defaultParallelism}
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept


def test_levels_read_sums_of_equal_rows(spark):
    """Every level went through all rows of all lists; now through the different bin codes of a task."""
    rows = ranked_rows(spark).withColumn("a", F.floor(F.col("a") * 2).cast("double"))
    cuts = boosting.cut_points(rows, ["a"])
    parts = boosting._parts_of(boosting.list_pieces(rows, ["a"], cuts, "user_id", "item_id", "label"))
    sums = boosting._pulled(parts, None, None, 30, False, 1)
    tree = boosting.Tree()
    tree.split(0, 0, 1, 1.0, (0.25, -0.5))
    later = boosting._pulled(parts, sums, tree, 30, False, 1)
    (first,), (second,) = sums.collect()[0], later.collect()[0]
    assert len(first.codes) == len(first.pulls[0][0]) == 4 and len(first.pulls) == 1
    assert 0.7 * 1200 < first.pulls[0][2][2].sum() < 0.9 * 1200
    assert second.scores.tolist() == [0.25, 0.25, -0.5, -0.5]
    # Gradients of a list add up to zero over all its rows, whatever the scores.
    (part,) = parts.collect()
    for b in part.blocks:
        own, _, _ = b.gradients(second.scores[b.cell], 30)
        assert np.abs(np.bincount(b.of, own[0])).max() < 1e-12
    for rdd in (parts, sums, later):
        rdd.unpersist()


def test_far_apart_scores_overflow_nothing():
    """Exponentials of differences are products of two only where neither can overflow."""
    s = np.array([[900.0, 400.0, 0.0], [1.0, 0.5, 0.0]])
    one, w = np.ones((2, 3)), np.array([1.0, 0.6, 0.5])
    gain = one * [0.0, 1.0, 3.0]
    with np.errstate(all="raise", under="ignore"):
        both = boosting.pulls(gain, s, one * w, gain, s, w)
        alone = [boosting.pulls(gain[k : k + 1], s[k : k + 1], one[:1] * w, gain[k : k + 1], s[k : k + 1], w) for k in (0, 1)]
    for x, a, b in zip(both, *alone):
        assert np.isfinite(x).all() and x == pytest.approx(np.concatenate([a, b]), abs=1e-15)


def test_tasks_follow_cores_and_are_bounded():
    assert [session.tasks_for(n, 12) for n in (0, 1_000, 1_750_000, 108_000_000)] == [1, 1, 12, 216]


# --- boosted classifier ---------------------------------------------------------------------


def labelled_rows(spark, n=400):
    """Labels that follow from a and b, with noise; few values, so that every one has a bin of its own."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(n):
        a, b, c = (int(rng.integers(k)) for k in (19, 23, 7))
        rows.append((float(rng.random() < 1 / (1 + np.exp(-(a - 9) * (b - 11) / 20 - 0.3 * c))), a / 3, b / 7, float(c)))
    return spark.createDataFrame(rows, "label double, a double, b double, c double")


def test_classifier_equals_sparks_without_draws(spark, monkeypatch):
    """With all rows and features in every tree nothing is left to chance: scores are those of Spark's boosted classifier."""
    monkeypatch.setattr(classifier, "ROW_SHARE", 1.0)
    monkeypatch.setattr(classifier, "FEATURE_SHARE", 1.0)
    names, rows = ["a", "b", "c"], labelled_rows(spark).repartition(3)
    got = models.score(models.ranker("pairwise", names, rounds=5).fit(rows), rows)
    spark_rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=5, maxDepth=6, stepSize=0.1, seed=1).fit(spark_rows)
    want = models.score(model, spark_rows).select(*names, "label", "score")
    for x, y in zip(sorted(got.collect(), key=lambda r: (r.a, r.b, r.c, r.label)), sorted(want.collect(), key=lambda r: (r.a, r.b, r.c, r.label))):
        assert x.score == pytest.approx(y.score, abs=1e-9)


def test_regressor_equals_sparks(spark):
    """Spark's boosted regressor went through all rows at every level; cells of equal bins give its scores."""
    names, rows = ["a", "b", "c"], labelled_rows(spark).withColumn("label", F.col("label") + F.col("c") / 3 + F.col("a") * F.col("b")).repartition(3)
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    got = models.score(models.boosted_regressor(names, rounds=12).fit(rows), rows)
    spark_rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    want = models.score(GBTRegressor(maxIter=12, maxDepth=5, stepSize=0.1, seed=1).fit(spark_rows), spark_rows).select(*names, "label", "score")
    for x, y in zip(sorted(got.collect(), key=lambda r: (r.a, r.b, r.c, r.label)), sorted(want.collect(), key=lambda r: (r.a, r.b, r.c, r.label))):
        assert x.score == pytest.approx(y.score, abs=1e-9)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
    cells = [classifier._cells(x, names, "label", means=True)[1] for x in (rows, rows.withColumn("label", F.col("label") + 1))]
    assert cells[0].count() == cells[1].count() == rows.select(*names).distinct().count()
    for bad in (rows.where("false"), rows.withColumn("label", F.lit(None).cast("double")), rows.withColumn("b", F.lit(math.nan))):
        with pytest.raises(Exception, match="no rows|labels must be|null or NaN"):
            models.boosted_regressor(names, rounds=1).fit(bad)


def test_passes_do_not_grow_with_equal_rows(spark):
    """Every level of every tree went through all rows; equal ones are now one cell with a number."""
    rows = labelled_rows(spark)
    many = rows.crossJoin(spark.range(20).select()).repartition(4)
    (_, few), (_, all_of) = (classifier._cells(x, ["a", "b", "c"], "label") for x in (rows, many))
    assert {(bytes(r.codes), r.label, 20 * r.n, r.draw) for r in few.collect()} == {(bytes(r.codes), r.label, r.n, r.draw) for r in all_of.collect()}
    assert all_of.agg(F.sum("n")).first()[0] == 8000


def test_differences_have_bounded_cells(spark):
    """Differences within a user say nothing about the user, so their cells are those of the product features."""
    rows = training.sampled_rows(spark, SF)
    cuts, cells = classifier._cells(training._differences(rows), training.FEATURES, "label")
    assert cuts[:3] == [[], [], []] and all(len(c) < classifier.BINS for c in cuts)
    assert cells.count() <= 2 * classifier.BINS**3


def test_a_frequent_value_takes_no_bins_from_the_rest(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 4 > 0, 0.0).otherwise(F.col("id") / 7).alias("x"), F.col("id").cast("double").alias("y"))
    x, y = classifier.cuts_of(rows, ["x", "y"])
    assert len(x) == len(y) == classifier.BINS - 1
    assert max(abs(c - 1250 * (k + 1)) for k, c in enumerate(y)) < 100


@pytest.mark.parametrize("n", [1, 5, 32, 400])
def test_draws_of_equal_rows(n):
    got = classifier.drawn(np.full(40_000, n), np.arange(40_000), 3, 0.8)
    assert set(np.unique(got)) <= set(range(n + 1))
    assert got.mean() == pytest.approx(0.8 * n, rel=0.01) and got.var() == pytest.approx(0.16 * n, rel=0.05)
    assert (got == classifier.drawn(np.full(40_000, n), np.arange(40_000), 3, 0.8)).all()
    assert (got != classifier.drawn(np.full(40_000, n), np.arange(40_000), 4, 0.8)).any()


def test_classifier_is_stored_and_refuses_bad_rows(spark, tmp_path):
    rows, kept = labelled_rows(spark), set(spark.sparkContext._jsc.getPersistentRDDs())
    model = models.ranker("pairwise", ["a", "b", "c"], rounds=12).fit(rows)
    assert len(model.trees) == 12 and set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
    models.save(model, f"{tmp_path}/boosted")
    scored = models.score(model, rows).collect()
    assert sorted(models.score(models.load(f"{tmp_path}/boosted"), rows).collect()) == sorted(scored)
    assert all(0 < r.score < 1 for r in scored)
    fit = lambda df: models.ranker("pairwise", ["a", "b"], rounds=1).fit(df)
    with pytest.raises(ValueError, match="no rows"):
        fit(rows.where("false"))
    for bad in (rows.withColumn("label", F.lit(2.0)), rows.withColumn("label", F.lit(None).cast("double")), rows.withColumn("b", F.lit(None).cast("double"))):
        with pytest.raises(Exception, match="labels must be|null or NaN"):
            fit(bad)
    one = fit(rows.withColumn("label", F.lit(1.0)))
    assert {round(r.score, 6) for r in models.score(one, rows).collect()} == {round(1 / (1 + math.exp(-2)), 6)}


# --- networks -------------------------------------------------------------------------------


@pytest.mark.parametrize("loss", ["mse", "bce"])
def test_gradient_against_differences(loss):
    sizes = neural.layer_sizes(3, (5, 4))
    rng = np.random.default_rng(0)
    weights, x, y = neural.initial_weights(sizes, 1), rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float)
    masks = neural.keep_masks(np.arange(7), sizes, 3, 0.3)
    found, _ = neural.gradient(x, y, weights, sizes, loss, masks)
    for k in range(len(weights)):
        step = np.zeros(len(weights))
        step[k] = 1e-6
        slope = (neural.gradient(x, y, weights + step, sizes, loss, masks)[1] - neural.gradient(x, y, weights - step, sizes, loss, masks)[1]) / 2e-6
        assert found[k] == pytest.approx(slope, abs=1e-5)


def test_masks_keep_the_share_and_repeat():
    sizes = neural.layer_sizes(3, (200, 100))
    one, two = neural.keep_masks(np.arange(500), sizes, 1, 0.2), neural.keep_masks(np.arange(500), sizes, 1, 0.2)
    assert all((a == b).all() for a, b in zip(one, two)) and set(np.unique(one[0])) == {0.0, 1.25}
    assert abs(one[0].mean() - 1) < 0.02 and (one[0] != neural.keep_masks(np.arange(500), sizes, 2, 0.2)[0]).any()


def test_network_learns_and_is_stored(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(abs(a) - b * b)) for a, b in rng.normal(size=(3000, 2))] + [(None, 0.0, 0.0), (math.nan, 0.0, 0.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    model = neural.fit_network(df, ["a", "b"], hidden=(32, 16), dropout=0.05, epochs=6, steps=6, rate=0.02)
    assert model.losses[-1] < model.losses[0] / 2
    scored = [r for r in model.transform(df).collect() if r.label is not None]
    labels = np.array([r.label for r in scored])
    assert np.mean([(r.prediction - r.label) ** 2 for r in scored]) < labels.var() / 3
    models.save(model, f"{tmp_path}/net")
    assert sorted(r.prediction for r in models.load(f"{tmp_path}/net").transform(df).collect()) == pytest.approx(sorted(r.prediction for r in model.transform(df).collect()))
    none = neural.fit_network(df.where("false"), ["a", "b"], hidden=(4,), epochs=1, steps=2)
    assert none.losses == [0.0] and none.transform(df).count() == len(rows)


def test_minibatches_hold_every_row_once_on_all_cores(spark, monkeypatch):
    """A step had as many tasks as its folder had files; equal rows share a minibatch and still spread over its partitions."""
    monkeypatch.setattr(session, "TASK_LEAST", 10)
    df = spark.range(2000).select((F.col("id") % 50).alias("draw"), F.array(F.col("id").cast("double")).alias("x"), F.lit(1.0).alias("y"))
    dealt, tasks = neural._minibatches(df, 4, 1)
    assert tasks == spark.sparkContext.defaultParallelism and dealt.getNumPartitions() == 4 * tasks
    found = [(i // tasks, int(d), float(x)) for i, part in enumerate(dealt.glom().collect()) for draws, xs, _ in part for d, x in zip(draws, xs[:, 0])]
    dealt.unpersist()
    assert sorted(x for _, _, x in found) == [float(i) for i in range(2000)]
    assert len({(step, d) for step, d, _ in found}) == 50


def test_equal_rows_of_a_minibatch_are_kept_once(spark):
    """Every epoch went through every row; without dropout equal rows have equal gradients, which their number multiplies."""
    df = spark.range(600).select((F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("label"), F.col("id").alias("item_id"))
    model = neural.fit_network(df, ["a"], hidden=(8, 4), loss="bce", dropout=0.0, epochs=2, steps=4)
    dealt = df.select(F.xxhash64(*df.columns).alias("draw"), F.array("a").alias("x"), F.col("label").alias("y"))
    counted = neural._counted(dealt, 4)
    assert counted.count() == 4 * 6 and counted.agg(F.sum("draw")).first()[0] == 600
    # The same steps on all rows.
    x = (df.toPandas()["a"].to_numpy()[:, None] - model.mean[0]) / model.scale[0]
    y, step = df.toPandas()["label"].to_numpy(), np.array([r[0] for r in dealt.select(neural._step_of(F.col("draw"), 4)).collect()])
    sizes = neural.layer_sizes(1, (8, 4))
    weights, rng = neural.initial_weights(sizes, 42), np.random.default_rng(43)
    adam = neural.Adam(len(weights), neural.RATE)
    for _ in range(2):
        for s in rng.permutation(4):
            mine = step == s
            weights = adam.step(weights, neural.gradient(x[mine], y[mine], weights, sizes, "bce")[0] / mine.sum())
    assert model.weights == pytest.approx(weights, abs=1e-9)


# --- embeddings -----------------------------------------------------------------------------


def test_embeddings_find_planted_groups(spark):
    rng = random.Random(8)
    # Users like half of the items of their own group; ids are beyond 32 bits.
    pairs = [(2**40 + u, f"i{k}", 1.0) for u in range(60) for k in range(80) if k % 4 == u % 4 and rng.random() < 0.5]
    hidden = {p[:2] for p in pairs if rng.random() < 0.25}
    shown = [p for p in pairs if p[:2] not in hidden]
    df = spark.createDataFrame(shown + [(None, "i1", 1.0), (1, None, 1.0), (1, "i1", 0.0), (1, "i1", None)], "user_id long, item_id string, weight double")
    users, items, losses = factors.train_embeddings(df, dim=16, epochs=8, blocks=3)
    users, items = ({r[0]: np.array(r[1]) for r in t.collect()} for t in (users, items))
    assert set(users) == {p[0] for p in shown} and set(items) == {p[1] for p in shown}
    assert all(b < a for a, b in zip(losses, losses[1:]))
    count = defaultdict(int)
    for _, i, _ in shown:
        count[i] += 1

    def recall(score):
        found = 0
        for u in users:
            seen = {i for v, i, _ in shown if v == u}
            best = sorted((i for i in items if i not in seen), key=lambda i: -score(u, i))[:10]
            found += len({(u, i) for i in best} & hidden)
        return found / len(hidden)

    assert recall(lambda u, i: users[u] @ items[i]) > 2 * recall(lambda u, i: count[i])


def test_embeddings_of_nothing(spark):
    none = spark.createDataFrame([], "user_id long, item_id long, weight double")
    users, items, losses = factors.train_embeddings(none)
    assert users.count() == items.count() == 0 and losses == []


def test_steps_use_all_cores_and_leave_one_table(spark):
    """A step has a task per block: 26 million pairs on 12 cores were 6 tasks; vectors of earlier steps stayed on disk."""
    assert factors.blocks_for(26_000_000, 540_000, 36_000, 12) == 12
    assert factors.blocks_for(60_000, 1_500, 100, 12) == 2
    df = spark.createDataFrame([(u, i, 1.0) for u in range(20) for i in range(10) if (u + i) % 2], "user_id long, item_id long, weight double")
    users, items, _ = factors.train_embeddings(df, dim=4, epochs=2, blocks=3)
    (folder,) = {f.rsplit("/", 1)[0] for t in (users, items) for f in t.inputFiles()}
    tables = glob.glob(folder.removeprefix("file://").rsplit("-", 1)[0] + "-*")
    before = set(tables)
    factors.train_embeddings(df, dim=4, epochs=2, blocks=3)
    assert len(set(glob.glob(folder.removeprefix("file://").rsplit("-", 1)[0] + "-*")) - before) == 1


def test_blocks_bound_a_task():
    assert factors.blocks_for(10, 5, 5) == 2
    blocks = factors.blocks_for(10**10, 10**7, 10**6)
    assert 10**10 / blocks**2 <= factors.TASK_PAIRS and 10**7 / blocks <= factors.TASK_VECTORS
