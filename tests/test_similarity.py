import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightshelf.operators import candidates, neighbours, similarity as sim
from brightshelf.session import materialise


def brute_top(q, i, k, skip_self=False):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    s = np.round(unit(q) @ unit(i).T, 9)
    out = []
    for r in range(len(q)):
        order = sorted((c for c in range(len(i)) if not (skip_self and c == r)), key=lambda c: (-s[r, c], c))
        out += [(r, c, rank + 1) for rank, c in enumerate(order[:k])]
    return out


@pytest.mark.parametrize("query_block,item_block", [(1000, 1000), (7, 5)])
def test_top_k_over_blocks(spark, query_block, item_block):
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (40, 3)).astype(float)  # many exact ties
    m[4] = 0.0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "item_id bigint, vector array<float>")
    got = sim.top_k_similar(df, df, 6, "item_id", exclude_self=True, query_block=query_block, item_block=item_block)
    rows = {(r.item_id, r.similar_item_id, r["rank"]) for r in got.collect()}
    assert rows == set(brute_top(m, m, 6, skip_self=True))


@pytest.mark.parametrize("probes,refine,blocks", [(6, None, 1000), (6, None, 9), (6, 8, 7), (None, 8, 1000), (1, 2, 1000)])
def test_inverted_file(spark, probes, refine, blocks):
    rng = np.random.default_rng(4)
    # a third of all items are copies of one vector, so one cell is hot
    m = np.concatenate([rng.normal(size=(40, 4)), np.tile(rng.normal(size=(1, 4)), (20, 1))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "item_id bigint, vector array<float>")
    queries = df.withColumnRenamed("item_id", "user_id")
    exact = {(r.user_id, r["rank"]): round(r.score, 6) for r in sim.top_k_similar(queries, df, 5, "user_id").collect()}
    near = neighbours.search(neighbours.fit_index(df, cells=6), queries, 5, "user_id", probes=probes, refine=refine, query_block=blocks, item_block=blocks)
    got = {(r.user_id, r["rank"]): round(r.score, 6) for r in near.collect()}
    assert set(got) == set(exact)  # probes widen until five rows are found
    same = np.mean([abs(got[key] - score) < 1e-5 for key, score in exact.items()])
    assert same == 1.0 if refine is None else same > (0.9 if probes != 1 else 0.3)


def test_queries_are_sent_once_per_pack_of_cells(spark, monkeypatch):
    """A query's vector was written and shuffled for every cell it looks into, and again with every item compared exactly."""
    rng = np.random.default_rng(14)
    m = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i % 110, v.tolist()) for i, v in enumerate(m)], "item_id bigint, vector array<double>")
    queries = df.withColumnRenamed("item_id", "user_id")
    written, real = {}, neighbours.materialise
    monkeypatch.setattr(neighbours, "materialise", lambda t, name: written.setdefault(name, real(t, name)))
    index = neighbours.fit_index(df, cells=10)
    found = neighbours.search(index, queries, 5, "user_id", probes=10, query_block=50, item_block=30)
    assert found.count() == 110 * 5
    assert written["probed-cells"].count() == 120 and {len(r["_cells"]) for r in written["probed-cells"].collect()} == {len(index.centres)}
    # Ids with more than one vector: every pair of vectors is compared.
    pairs = spark.createDataFrame([(3, 3), (3, 50), (3, None)], "_q bigint, _i bigint")
    asked = queries.select(F.col("user_id").alias("_q"), F.col("vector").alias("_v"))
    got = sorted((r.user_id, r.item_id, round(r.score, 9)) for r in neighbours._compared(index, asked, pairs, "user_id", "item_id", 40).collect())
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    both = {i: [u[j] for j in range(120) if j % 110 == i] for i in (3, 50)}
    assert got == sorted((3, i, round(float(a @ b), 9)) for i in (3, 50) for a in both[3] for b in both[i])


def test_probes_follow_the_recall(spark):
    rng = np.random.default_rng(6)
    centres = 5 * rng.normal(size=(12, 8))
    m = centres[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 8))
    df = spark.createDataFrame([(f"i{i}", v.tolist()) for i, v in enumerate(m)], "item_id string, vector array<double>")
    queries = df.withColumnRenamed("item_id", "user_id")
    index = neighbours.fit_index(df)
    assert len(index.centres) == 25 and index.sizes.sum() == 600
    probes = neighbours.probes_for(index, queries, 10, "user_id")
    assert probes < 8 and probes <= neighbours.probes_for(index, queries, 10, "user_id", recall=1.0)
    exact = {(r.user_id, r.item_id) for r in sim.top_k_similar(queries, df, 10, "user_id").collect()}
    got = {(r.user_id, r.item_id) for r in neighbours.search(index, queries, 10, "user_id").collect()}
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("clustered", [True, False])
def test_cells_out_of_reach_are_not_compared(spark, clustered):
    rng = np.random.default_rng(7)
    centres = 5 * rng.normal(size=(12, 8))
    m = (centres[rng.integers(0, 12, 500)] if clustered else 0) + 0.3 * rng.normal(size=(500, 8))
    m[3] = m[4] = 0.0
    m[10:40] = m[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "item_id long, vector array<double>")
    queries = df.withColumnRenamed("item_id", "user_id")
    index = neighbours.fit_index(df)
    exact = {(r.user_id, r["rank"], r.item_id) for r in sim.top_k_similar(queries, df, 5, "user_id").collect()}
    assert {(r.user_id, r["rank"], r.item_id) for r in neighbours.exact_top_k(index, queries, 5, "user_id", query_block=90, item_block=20).collect()} == exact
    compared = sum(index.sizes[r["_cell"]] for r in neighbours.cells_within_reach(index, queries, 5, "user_id").collect())
    assert compared < (0.35 if clustered else 1.01) * 500 * 500


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "user_id long, vector array<float>")
    assert neighbours.search(neighbours.fit_index(none), queries, 3, "user_id").count() == 0
    one = spark.createDataFrame([(7, [0.0, 2.0])], none.schema)
    assert [(r.user_id, r.item_id) for r in neighbours.search(neighbours.fit_index(one), queries, 3, "user_id").collect()] == [(1, 7)]


def test_embedding_anchor(spark):
    users = spark.createDataFrame([("user_1", [0.1, 0.2, 0.3])], "user_id string, vector array<float>")
    items = spark.createDataFrame(
        [("product_1", [0.1, 0.2, 0.3]), ("product_2", [0.2, 0.1, 0.4])], "item_id string, vector array<float>"
    )
    got = {r.item_id: round(r.score, 4) for r in candidates.embedding(users, items, 5).collect()}
    assert got == {"product_1": 1.0, "product_2": 0.9331}


def test_matrix_blocks(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(23, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "item_id bigint, vector array<float>")
    got = np.full((23, 23), np.nan)
    for r in sim.similarity_matrix(df, block=6).collect():
        got[r.item_id, r.ids] = r.similarities
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    assert np.allclose(got, u @ u.T)


@pytest.mark.parametrize("chunk", [1024, 4])
def test_cooccurrence_with_a_hot_user(spark, chunk):
    rng = np.random.default_rng(7)
    dense = rng.integers(0, 4, (12, 30)) * (rng.random((12, 30)) < 0.3)
    dense[0] = rng.integers(1, 5, 30)  # one user has every item
    rows = [(int(u), int(i), float(dense[u, i])) for u, i in zip(*np.nonzero(dense))]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, weight double")
    got = {(r.item_id_1, r.item_id_2): r.similarity for r in sim.cooccurrence(df, chunk=chunk).collect()}
    unit = dense / np.linalg.norm(dense, axis=0, keepdims=True)
    gram = unit.T @ unit
    want = {(i, j): gram[i, j] for i in range(30) for j in range(i + 1, 30) if gram[i, j] > 0}
    assert got.keys() == want.keys()
    assert np.allclose([got[p] for p in want], list(want.values()))


@pytest.mark.parametrize("heavy_users,chunk", [(32, 1024), (1, 8), (3, 8), (32, 2)])
def test_best_partners_with_heavy_users(spark, heavy_users, chunk):
    rng = np.random.default_rng(11)
    dense = rng.integers(1, 6, (25, 40)) * (rng.random((25, 40)) < 0.08)
    dense[0] = rng.integers(1, 5, 40)  # every item
    dense[1] = rng.integers(1, 5, 40) * (rng.random(40) < 0.6)
    rows = [(int(u), int(i), float(dense[u, i])) for u, i in zip(*np.nonzero(dense))]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, weight double")
    got = {
        (r.item_id, r["rank"]): (r.similar_item_id, round(r.similarity, 7))
        for r in sim.similar_by_users(df, 6, chunk=chunk, heavy_users=heavy_users).collect()
    }
    unit = dense / np.linalg.norm(dense, axis=0, keepdims=True)
    gram = np.round(unit.T @ unit, 9)
    want = {}
    for i in range(40):
        order = sorted((j for j in range(40) if j != i and gram[i, j] > 0), key=lambda j: (-gram[i, j], j))
        want.update({(i, n + 1): (j, round(gram[i, j], 7)) for n, j in enumerate(order[:6])})
    assert got == want


@pytest.mark.parametrize("heavy_users,hot", [(0, 10_000), (0, 2), (2, 2)])
def test_pairs_are_summed_group_by_group(spark, monkeypatch, heavy_users, hot):
    """Only the pairs of one group of items are on disk at a time; hot items are spread, and nothing is lost."""
    rng = np.random.default_rng(5)
    dense = rng.integers(1, 4, (60, 50)) * (rng.random((60, 50)) < 0.15)
    dense[0] = rng.integers(1, 4, 50)
    rows = [(int(u), int(i) * 3 - 40, float(dense[u, i])) for u, i in zip(*np.nonzero(dense))]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, weight double")
    monkeypatch.setattr(sim, "GROUP_PAIRS", 1_000)
    monkeypatch.setattr(sim, "TASK_PAIRS", 50)
    monkeypatch.setattr(sim, "HOT_USERS", hot)
    monkeypatch.setattr(sim, "PAIR_BATCH", 64)
    written = []
    monkeypatch.setattr(sim, "materialise", lambda t, name: written.append(name) or materialise(t, name))
    found = sim.similar_by_users(df, 5, chunk=12, heavy_users=heavy_users).collect()
    assert written.count("similar-items") > 2
    unit = dense / np.linalg.norm(dense, axis=0, keepdims=True)
    gram = np.round(unit.T @ unit, 9)
    want = {}
    for i in range(50):
        order = sorted((j for j in range(50) if j != i and gram[i, j] > 0), key=lambda j: (-gram[i, j], j))
        want.update({(i * 3 - 40, n + 1, j * 3 - 40): gram[i, j] for n, j in enumerate(order[:5])})
    got = {(r.item_id, r["rank"], r.similar_item_id): r.similarity for r in found}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("far", [1, 2**40])
def test_best_pairs_with_ties(far):
    """Pairs are sorted by one whole number and only scores up to the k-th are ranked: several times faster than sorting by two keys."""
    rng = np.random.default_rng(3)
    one, other = rng.integers(-9, 9, 5_000) * far, rng.integers(-200, 200, 5_000) * far
    value = rng.choice([0.25, 0.5, -1.0, 0.1 + 1e-11, 0.1], 5_000)
    got = sim._summed_pairs(one, other, value)
    sums = {}
    for i, j, v in zip(one, other, value):
        sums[i, j] = sums.get((i, j), 0.0) + v
    assert [*zip(got[0], got[1])] == sorted(sums) and got[2] == pytest.approx([sums[p] for p in sorted(sums)])
    for values in (got[2], np.where(got[2] > 1, np.nan, got[2]), got[2] * 1e300):
        with np.errstate(over="ignore"):
            best = sim._best_pairs(got[0], values, 4)
            score = np.nan_to_num(np.rint(values * 1e9), nan=np.inf)
        want = [p for i in sorted({*got[0]}) for p in sorted(np.flatnonzero(got[0] == i), key=lambda p: -score[p])[:4]]
        assert best.tolist() == want
    assert sim._best_pairs(got[0][:0], got[2][:0], 4).tolist() == []


@pytest.mark.parametrize("left", [0.0, 0.8, 1.0])
def test_pairs_are_added_up_before_the_shuffle_where_that_helps(monkeypatch, left):
    monkeypatch.setattr(sim, "PAIRS_LEFT", left)
    monkeypatch.setattr(sim, "PAIR_BATCH", 40)
    rng = np.random.default_rng(4)
    histories = [sorted(rng.permutation(12)[: rng.integers(1, 7)].tolist()) for _ in range(60)]
    lists = lambda x, kind: pa.array(x, pa.list_(kind))
    none = [[] for _ in histories]
    batch = pa.RecordBatch.from_arrays(
        [lists(histories, pa.int64()), lists([[1.0] * len(h) for h in histories], pa.float64()), lists(none, pa.int64()), lists(none, pa.float64())],
        names=["items", "weights", "items2", "weights2"],
    )
    found, rows = {}, 0
    for group in range(3):
        for out in sim._group_sums(iter([batch, batch]), group, 3, 5, np.array([2], np.int64)):
            for r in out.to_pylist():
                one, other, value = (np.frombuffer(r[c], t) for c, t in (("one", np.int64), ("other", np.int64), ("sums", float)))
                rows += len(one)
                for i, j, v in zip(one.tolist(), other.tolist(), value.tolist()):
                    found[i, j] = found.get((i, j), 0.0) + v
    want = {}
    for h in histories * 2:
        for i in h:
            for j in h:
                if i != j:
                    want[i, j] = want.get((i, j), 0.0) + 1.0
    assert found == want
    assert rows < sum(want.values()) if left else rows > 0.7 * sum(want.values())


def test_given_pairs_count_twice(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (1, 3, 0.4)], "item_id_1 bigint, item_id_2 bigint, similarity double")
    history = spark.createDataFrame([(9, 1)], "user_id bigint, item_id bigint")
    got = {r.item_id: r.score for r in candidates.from_given_pairs(history, pairs, 10, "given").collect()}
    assert got == {2: 1.0, 3: 0.4}


def test_index_of_id(spark):
    ids = spark.createDataFrame([("user_123",), ("user_99999",), ("user_-4",), ("7",), ("other",)], "id string")
    got = {r.id: r["index"] for r in sim.index_of_id(ids, "id", "user", 1000).collect()}
    assert got["user_123"] == 123 and got["user_99999"] == 999 and got["user_-4"] == 0 and got["7"] == 7
    assert 0 <= got["other"] < 1000


def test_lookup_of_unknown_vector(spark):
    from brightshelf.functions.vectors import cosine, zero_vector
    from pyspark.sql import functions as F

    ids = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    vectors = spark.createDataFrame([(1, [3.0, 4.0])], "user_id bigint, vector array<float>")
    found = sim.lookup_vectors(ids, vectors, "user_id", zero_vector(2))
    rows = found.select("user_id", "vector", cosine(F.col("vector"), F.col("vector")).alias("c")).toPandas().set_index("user_id")
    assert list(rows.loc[2, "vector"]) == [0.0, 0.0] and rows.loc[2, "c"] == 0.0 and rows.loc[1, "c"] == 1.0
    assert isinstance(rows, pd.DataFrame)


def test_matrix_of_whole_rows(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(31, 4)).astype(np.float32)
    ids = [i if i < 29 else 5 for i in range(31)]  # one id three times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m)], "item_id bigint, vector array<float>")
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    got = {r.item_id: (r.ids, r.similarities) for r in sim.similarity_matrix(df, block=None, rows=4).collect()}
    assert len(got) == 29
    for item, (names, values) in got.items():
        pairs = sorted((i, s) for row, name in enumerate(ids) if name == item for i, s in zip(ids, u[row] @ u.T))
        assert names == [i for i, _ in pairs] and np.allclose(values, [s for _, s in pairs])


@pytest.mark.parametrize("kept", [True, False])
def test_matrix_vectors_are_dealt_once_per_task(spark, monkeypatch, kept):
    """A copy of all vectors was shuffled for every few rows that a task scores at a time; now one per task."""
    real, groups = sim._each, []
    monkeypatch.setattr(sim, "_each", lambda n: groups.append(n) or real(n))
    if not kept:
        monkeypatch.setattr(sim, "MATRIX_BYTES", 0)
    rng = np.random.default_rng(9)
    m = rng.normal(size=(200, 3))
    ids = [i % 150 for i in range(200)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m)] + [(7, None)], "item_id bigint, vector array<double>").repartition(3)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {r.item_id: (r.ids, r.similarities) for r in sim.similarity_matrix(df, block=None, rows=5).collect()}
    assert groups == [4 if kept else 40] and len(got) == 150
    for item, (names, values) in got.items():
        pairs = sorted((i, s) for row, name in enumerate(ids) if name == item for i, s in zip(ids, u[row] @ u.T))
        assert names == [i for i, _ in pairs] and np.allclose(values, [s for _, s in pairs])


def test_matrix_entries_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "item_id bigint, vector array<float>")
    plan = sim.similarity_matrix(df, block=None)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_in_block_with_ties(k, monkeypatch):
    monkeypatch.setattr(sim, "SCORE_CELLS", 500)
    rng = np.random.default_rng(9)
    q, i = rng.integers(-2, 3, (30, 3)).astype(float), rng.integers(-2, 3, (300, 3)).astype(float)
    found = [p for part in sim._best_in_block(sim._unit(q), sim._unit(i), k, None) for p in zip(*part[:2])]
    assert found == [(r, c) for r, c, _ in brute_top(q, i, k)]


def test_probed_rows_are_few_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neighbours, "PROBED_ROWS", 10)
    batch = pa.RecordBatch.from_pydict({"_q": list(range(8)), "_v": [[1.0]] * 8})
    row, cell = np.repeat(np.arange(8), 12), np.tile(np.arange(12), 8)
    packs = np.repeat([0, 1, 2], 4)
    parts = list(neighbours._in_packs(batch, row, cell, packs))
    assert max(p.num_rows for p in parts) <= 10 and sum(p.num_rows for p in parts) == 24
    seen = [(q, c) for p in parts for q, cells in zip(p["_q"].to_pylist(), p["_cells"].to_pylist()) for c in cells]
    assert sorted(seen) == [(r, c) for r in range(8) for c in range(12)]


@pytest.mark.parametrize("long_history", [1024, 3])
def test_similar_items_of_histories(spark, monkeypatch, long_history):
    monkeypatch.setattr(candidates, "LONG_HISTORY", long_history)
    rng = np.random.default_rng(12)
    history = [(int(u), int(i)) for u in range(8) for i in rng.choice(20, rng.integers(1, 8), replace=False)] + [(None, 3), (2, None)]
    similar = [(int(i), int(j), float(rng.integers(1, 5))) for i in range(15) for j in rng.choice(20, 4, replace=False)]
    h = spark.createDataFrame(history, "user_id long, item_id long")
    s = spark.createDataFrame(similar, "item_id long, similar_item_id long, similarity double")
    out = candidates.from_similar_items(h, s, 5, "x")
    sums = {}
    for u, i in history:
        for a, j, w in similar:
            if a == i:
                sums[u, j] = sums.get((u, j), 0) + w
    want = set()
    for u in {u for u, _ in sums}:
        best = sorted((-w, j) for (v, j), w in sums.items() if v == u)[:5]
        want |= {(u, j, -w, r + 1) for r, (w, j) in enumerate(best)}
    assert {(r.user_id, r.item_id, r.score, r["rank"]) for r in out.collect()} == want
    if long_history == 1024:  # one exchange, of the histories
        assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_neighbours_are_looked_for_where_a_history_asks(spark, monkeypatch):
    """All items were compared with all, though only lists of items in a history are read."""
    asked, real = [], candidates.sim.top_k_similar
    monkeypatch.setattr(candidates.sim, "top_k_similar", lambda queries, items, *rest, **more: asked.append((queries.count(), items.count())) or real(queries, items, *rest, **more))
    vectors = spark.createDataFrame([(i, [float(i), float(i % 3), 1.0]) for i in range(40)], "item_id long, vector array<double>")
    history = spark.createDataFrame([(1, 3), (1, 5), (2, 3), (2, None), (3, 99)], "user_id long, item_id long")
    got = {(r.user_id, r.item_id, r.rank): r.score for r in candidates.content_based(history, vectors, 4).collect()}
    assert asked == [(2, 40)]
    every = candidates.from_similar_items(history, candidates.sim.similar_items(vectors, 4), 4, "content")
    assert got == {(r.user_id, r.item_id, r.rank): r.score for r in every.collect()} and len(got) == 8
