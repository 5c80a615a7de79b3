"""Code on the workers, whatever folder Spark is started in; limits of ranks; report kinds."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightshelf.operators import filters, similarity
from brightshelf.sources import sinks

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["w2_similar_items"](spark, "/root/testdata/sf0.001").count())
"""


def test_kernels_run_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, ROOT, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("ROWS")[1]) > 0


def test_large_ranks_are_pruned_before_the_shuffle(spark):
    n = F.row_number().over(Window.partitionBy(F.col("id") % 3).orderBy("id"))
    plan = spark.range(10_000_000).withColumn("n", n).where("n <= 1500")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_items_without_a_product_are_a_group_of_their_own(spark):
    recs = spark.createDataFrame([(1, i, r, 1.0) for r, i in enumerate([7, 8, 9, 1], 1)], "user_id long, item_id long, rank int, score double")
    products = spark.createDataFrame([(1, "a")], "item_id long, category string")
    assert {r.item_id for r in filters.limit_per_category(recs, products, 2).collect()} == {7, 8, 1}


def test_every_kind_of_a_column_is_reported(spark, tmp_path):
    kinds = [f"kind{i}" for i in range(6)]
    rows = spark.createDataFrame([(k, day, "n", 1.0) for k in kinds for day in ("2024-01-01", "2024-01-02")], "event_type string, day string, metric string, value double")
    sinks.append_report(rows, str(tmp_path / "r"), F.col("event_type"), F.col("day"))
    found = sinks.latest_reports(spark.read.json(str(tmp_path / "r"))).select("kind", "run_ts").collect()
    assert sorted((r.kind, r.run_ts) for r in found) == [(k, "2024-01-02") for k in kinds]


def test_null_vectors_take_no_part_and_ragged_ones_raise(spark):
    ddl = "item_id long, vector array<double>"
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.1])], ddl)
    rows = similarity.similarity_matrix(some).collect()
    assert {r.item_id for r in rows} == {1, 3} and all(r.ids == [1, 3] for r in rows)
    with pytest.raises(Exception, match="common length"):
        similarity.similarity_matrix(spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, [1.0])], ddl)).collect()
