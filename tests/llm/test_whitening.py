"""Eigenvectors against numpy, whitening against a whole-table computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from brightshelf.llm import whitening

SF = "/root/testdata/sf0.001"


def matrices():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 40):
        a = rng.normal(size=(n, n))
        yield a @ a.T
    yield np.eye(6)
    yield np.diag([5.0, 5, 5, 1, 0, 0])
    yield np.zeros((4, 4))
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    yield q @ np.diag([9 + 1e-9, 9, 9 - 1e-9, *range(17)]) @ q.T
    yield 1e12 * (q @ np.diag(np.arange(20.0)) @ q.T)


@pytest.mark.parametrize("a", list(matrices()))
def test_eigenvectors(a):
    k = min(4, len(a))
    a = (a + a.T) / 2
    size = max(np.abs(a).max(), 1e-300)
    d, e, q = whitening.tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert np.abs(q @ t @ q.T - a).max() <= 1e-13 * size * len(a)
    values, rows = whitening.leading_eigenvectors(a, k)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-13 * size * len(a)
    assert np.abs(rows @ rows.T - np.eye(k)).max() < 1e-12
    assert np.abs(a @ rows.T - rows.T * values).max() <= 1e-12 * size * len(a)


def test_sturm_counts():
    d, e = np.array([2.0, 0, 1, 5]), np.array([1.0, 0, 3])
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    for x in (-9, -1.7, 0.3, 1.9, 4, 9):
        assert whitening.sturm_count(d, e, x) == (values < x).sum()


def check(rows, table):
    """Rows of the operator against numpy over the usable (vec_id, vector) of `table`."""
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in table]
    fitted = np.array(sorted({tuple(v) for _, v in x}))
    n, s = len(fitted), fitted.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fitted.T, bias=True).reshape(fitted.shape[1], -1))
    assert len(rows) == len(x) * min(4, fitted.shape[1])
    for r in rows:
        value, v = values[-r.component], vectors[:, -r.component]
        mine = [np.array(w) for i, w in x if i == r.vec_id]
        assert r.n == n and any(r.deviation == ((n * w - s) ** 2).sum() for w in mine)
        assert any(abs(abs(r.whitened) - abs((w - s / n) @ v) / math.sqrt(value)) < 1e-7 for w in mine)
        assert abs(r.explained - value / values.sum()) < 1e-9 and 0 <= r.identity_error < 1e-9


def test_query_against_numpy(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(entry_points.queries()["op12_whitening"](spark, SF).collect(), table)


def test_rows_of_every_kind(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=5)]) for i in range(30)]
    good += [(30, good[0][1]), (0, good[0][1]), (31, good[5][1])]
    bad = [(40, None), (41, []), (42, [1.0, None, 1.0, 1.0, 1.0]), (43, [math.nan] * 5), (44, [math.inf] + [0.0] * 4), (45, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "s") for i, v in good + bad], "vec_id long, embedding array<float>, component string")
    check(whitening.whiten(df).collect(), good)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id in (40, 41, 42, 43, 44)")).count() == 0
    nameless = whitening.whiten(df.withColumn("vec_id", F.lit(None).cast("long")))
    assert nameless.count() == 4 * len(good) and nameless.where("vec_id is not null").count() == 0


def test_no_variance_gives_no_components(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    line = same.unionByName(spark.createDataFrame([(3, [2.0, 4.0])], same.schema))
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 and r.n == 2 for r in got)


def test_sums_beyond_64_bits_are_an_error():
    model = whitening.Whitening(1 << 40, np.array([0, 0]), np.zeros((0, 2)), np.zeros(0), 1.0, 0.0)
    with pytest.raises(OverflowError):
        model.deviation(np.array([[1 << 30, 0]]))
    assert whitening.Whitening(3, np.array([3, 0]), np.zeros((0, 2)), np.zeros(0), 1.0, 0.0).deviation(np.array([[2, 1]])).tolist() == [18]
