"""Global negatives by rank among the free pairs: whole results at any density."""

from collections import Counter

from brightshelf.operators import samples

DDL = "user_id bigint, item_id bigint"


def test_a_dense_table_gives_every_row_asked_for(spark):
    rows = [(u, i) for u in range(20) for i in range(40) if (u + i) % 20]  # 95 % of all pairs
    rows += rows[:140]
    out = samples.global_negatives(spark.createDataFrame(rows, DDL), ratio=4).collect()
    assert sorted(r["try"] for r in out) == list(range(1, 4 * len(rows) + 1))
    found = Counter((r.user_id, r.item_id) for r in out)
    assert set(found) == {(u, i) for u in range(20) for i in range(40)} - set(rows)
    # 40 free pairs with about 90 draws each: none is preferred.
    assert 50 < min(found.values()) and max(found.values()) < 135


def test_one_user_with_most_of_the_rows_keeps_chances_equal(spark):
    rows = [(1, i) for i in range(500)] + [(2, 0), (3, 1)] + [(None, 4), (2, None)]
    out = samples.global_negatives(spark.createDataFrame(rows, DDL), ratio=4).collect()
    assert len(out) == 4 * len(rows)
    assert not {(r.user_id, r.item_id) for r in out} & set(rows)
    by_user = Counter(r.user_id for r in out)  # user 1 has no free pair
    assert set(by_user) == {2, 3} and abs(by_user[2] - by_user[3]) < 180
    assert len({(r.user_id, r.item_id) for r in out}) > 800


def test_no_free_pairs_and_empty_tables(spark):
    full = spark.createDataFrame([(u, i) for u in range(4) for i in range(5)], DDL)
    assert samples.global_negatives(full).count() == 0
    assert samples.global_negatives(full.limit(0)).count() == 0


def test_draws_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(samples, "TASK_DRAWS", 10)
    pairs = spark.createDataFrame([(u, u % 7) for u in range(50)], "user_id long, item_id long")
    products = spark.createDataFrame([(i,) for i in range(30)], "item_id long")
    out = samples.negatives_with_replacement(pairs, products)
    assert out.count() == 200 and out.where("negative_item_id = item_id").count() == 0
    assert "hashpartitioning(index" in (plan := out._jdf.queryExecution().toString()) and ", 20)" in plan
