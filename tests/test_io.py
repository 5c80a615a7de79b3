"""Sources, sinks and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors.exceptions.captured import StreamingQueryException
from pyspark.sql import functions as F

from brightshelf.session import scratch_path, shared_dir
from brightshelf.sources import readers, sinks
from brightshelf.sources.schemas import INTERACTION_DDL
from brightshelf.streaming import features as sfeat, ingest

T0 = datetime(2024, 1, 1)


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_unknown_batch_format(spark):
    with pytest.raises(ValueError):
        sinks.write_batch(spark.range(1), "/nowhere", "xml")


def test_vectors(spark):
    wide = spark.createDataFrame([("a", 1.0, 2.0)], "id string, embedding_10 double, embedding_9 double")
    assert readers.vectors_from_wide(wide, "id").first().vector == [2.0, 1.0]
    other = spark.createDataFrame([("a", 1.0, 2)], "id string, x double, y int")
    assert readers.vectors_from_wide(other, "id").first().vector == [1.0, 2.0]
    with pytest.raises(ValueError):
        readers.vectors_from_wide(wide, "id", 3)
    ragged = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<float>")
    with pytest.raises(ValueError):
        readers.checked_dim(ragged, None)


def test_topic_options():
    o = readers.topic_options("host:9092", ["a", "b"], 10_000)
    assert o["subscribe"] == "a,b" and o["startingOffsets"] == "earliest" and o["maxOffsetsPerTrigger"] == "10000"


def test_malformed_messages_are_split(spark):
    texts = ['{"event_type":"view","user_id":"1","timestamp":5}', "{broken", '{"event_type":"view"}']
    good, bad = readers.split_messages(readers.decode_messages(spark.createDataFrame([(t,) for t in texts], "value string")))
    assert good.count() == 1 and bad.count() == 2


def test_date_partition_is_utc(spark):
    df = spark.createDataFrame([(86_399,), (86_400,)], "timestamp bigint")
    assert [str(r.event_date) for r in sinks.with_event_date(df).orderBy("timestamp").collect()] == ["1970-01-01", "1970-01-02"]


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"b":"x"}')], "id int, meta string")
    flat = readers.flatten_structs(df, {"meta": readers.json_keys(df, "meta")})
    assert flat.columns == ["id", "meta_a", "meta_b"] and flat.where("id = 2").first().meta_a is None


def lines(spark, path, rows):
    spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string").coalesce(1).write.mode("append").text(path)


def message(i, kind="view"):
    return {"event_id": str(i), "event_type": kind, "product_id": "1", "user_id": "2", "timestamp": 1_704_067_200 + i}


def test_store_keeps_one_copy_over_restarts(spark):
    topic, store, side, mark = (scratch_path(spark, n) for n in ("t", "s", "p", "m"))
    lines(spark, topic, [message(1), message(2, "purchase"), message(2, "purchase")])
    ingest.store_query(ingest.message_files(spark, topic), store, side, mark).awaitTermination()
    lines(spark, topic, [message(1), message(3)])
    ingest.store_query(ingest.message_files(spark, topic), store, side, mark).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(store).collect()) == ["1", "2", "3"]
    assert [r.event_id for r in spark.read.parquet(side).collect()] == ["2"]


def test_too_many_bad_messages_stop_the_stream(spark):
    topic, store, bad, mark = (scratch_path(spark, n) for n in ("t", "s", "q", "m"))
    lines(spark, topic, ["{oops", "{again", message(1)])
    q = ingest.quarantine_query(ingest.message_files(spark, topic), store, bad, mark, max_bad_share=0.5)
    with pytest.raises(StreamingQueryException):
        q.awaitTermination()
    assert spark.read.parquet(bad).count() == 2


def test_late_rows_are_dropped(spark):
    source, target, mark = (scratch_path(spark, n) for n in ("e", "w", "m"))
    schema = INTERACTION_DDL

    def put(rows):
        spark.createDataFrame([(i, 1, 1, "view", t, 1.0) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        sfeat.file_query(sfeat.windowed_features(stream, "1 hour", lateness="10 minutes"), target, mark).awaitTermination()

    put([(1, T0), (2, T0 + timedelta(hours=3))])
    run()
    put([(3, T0 + timedelta(minutes=5)), (4, T0 + timedelta(hours=9))])  # row 3 is far behind the watermark
    run()
    first = spark.read.parquet(target).where(F.col("window_start") == T0).collect()
    assert len(first) == 1 and first[0].events == 1
