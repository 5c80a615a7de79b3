import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brightshelf.operators import ordered


@pytest.fixture(params=[4, 64])
def partitions(spark, request):
    """Few buckets (one search tree) and many (two-step lookup)."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def skewed(n=3000):
    rng = np.random.default_rng(1)
    key = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 20, n).astype(str))
    return pd.DataFrame({"id": np.arange(n), "key": key, "v": np.round(rng.lognormal(0, 2, n), 2)})


def test_bucket_is_monotone(spark, partitions):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    cuts = ordered.cut_points(df, "v")
    got = df.select("v", ordered.bucket_of(F.col("v"), cuts).alias("b")).toPandas().sort_values("v")
    assert (got["b"].values == np.searchsorted(cuts, got["v"].values, side="right")).all()
    assert len(cuts) > ordered.FINE or partitions == 4


def test_prefix_sums_match_pandas(spark, partitions):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    cuts = ordered.cut_points(df, "v")
    got = ordered.prefix_sums(
        df, [F.col("v"), F.col("id")], {"s": F.col("id")}, ordered.bucket_of(F.col("v"), cuts), ["key"]
    ).toPandas()
    want = pdf.sort_values(["v", "id"]).copy()
    want["s"] = want.groupby("key")["id"].cumsum()
    want["s_total"] = want.groupby("key")["id"].transform("sum")
    merged = want.merge(got, on="id", suffixes=("", "_got"))
    assert len(got) == len(pdf)
    assert (merged["s"] == merged["s_got"]).all() and (merged["s_total"] == merged["s_total_got"]).all()


def test_exact_quantiles(spark, partitions):
    pdf = skewed()
    got = ordered.exact_quantiles(spark.createDataFrame(pdf), "v", {"p10": 0.1, "p95": 0.95}, ["key"]).toPandas().set_index("key")
    for key, part in pdf.groupby("key"):
        assert got.loc[key, "n"] == len(part)
        assert np.allclose([got.loc[key, "p10"], got.loc[key, "p95"]], np.quantile(part["v"], [0.1, 0.95]))


def test_contiguous_index(spark, partitions):
    ids = [5, 5, -3, 10**15, 7, None]
    got = ordered.contiguous_index(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id").toPandas()
    assert dict(zip(got["id"], got["index"])) == {-3: 0, 5: 1, 7: 2, 10**15: 3}


def test_rows_with_null_keys_stay(spark):
    rows = [("a", 1), ("a", 2), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "key string, v bigint")
    got = ordered.prefix_sums(df, [F.col("v")], {"s": F.col("v")}, ordered.bucket_of(F.col("v"), [2.0, 4.0]), ["key"])
    assert {(r.key, r.v, r.s, r.s_total) for r in got.collect()} == {("a", 1, 1, 3), ("a", 2, 3, 3), (None, 3, 3, 7), (None, 4, 7, 7)}
