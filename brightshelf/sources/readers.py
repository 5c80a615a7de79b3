"""Reading event lakes, CSV and Parquet tables, embeddings and topics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from brightshelf.sources.schemas import MESSAGE_DDL


def read_event_lake(spark: SparkSession, path: str, ddl: str = MESSAGE_DDL) -> DataFrame:
    """JSON-lines lake partitioned by `event_date`; the schema is given, so no pass infers it
    and a filter on event_date prunes directories."""
    return spark.read.schema(f"{ddl}, event_date date").json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whichever file system its scheme names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_interactions_csv(spark: SparkSession, path: str, ddl: str, ts: str = "timestamp") -> DataFrame:
    """Interactions from CSV with `ts` parsed to a timestamp; a missing file is an empty table."""
    if not path_exists(spark, path):
        df = spark.createDataFrame([], ddl)
    else:
        df = spark.read.schema(ddl).option("header", True).csv(path)
    return df.withColumn(ts, F.to_timestamp(ts))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def checked_dim(vectors: DataFrame, dim: int | None) -> DataFrame:
    """Fail on ragged vectors, or on a size other than `dim`; two numbers reach the driver."""
    sizes = vectors.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if sizes["low"] != sizes["high"]:
        raise ValueError(f"vectors of {sizes['low']} to {sizes['high']} values")
    if dim is not None and sizes["low"] is not None and sizes["low"] != dim:
        raise ValueError(f"expected {dim} values per vector, found {sizes['low']}")
    return vectors


def vectors_from_wide(df: DataFrame, id_column: str, dim: int | None = None) -> DataFrame:
    """Wide rows to (id, vector): columns embedding_0.. in numeric order, else all other numeric columns."""
    numbered = sorted(
        (c for c in df.columns if re.fullmatch(r"embedding_\d+", c)), key=lambda c: int(c.rsplit("_", 1)[1])
    )
    columns = numbered or [
        f.name for f in df.schema if f.name != id_column and isinstance(f.dataType, T.NumericType)
    ]
    if not columns:
        raise ValueError("no embedding columns")
    if dim is not None and len(columns) != dim:
        raise ValueError(f"expected {dim} embedding columns, found {len(columns)}")
    return df.select(F.col(id_column), F.array(*[F.col(c).cast("float") for c in columns]).alias("vector"))


def read_wide_vectors(spark: SparkSession, path: str, id_column: str, dim: int | None = None) -> DataFrame:
    """Embeddings from CSV with one column per dimension."""
    header = spark.read.option("header", True).csv(path).columns
    ddl = ", ".join(f"`{c}` {'string' if c == id_column else 'float'}" for c in header)
    return vectors_from_wide(spark.read.schema(ddl).option("header", True).csv(path), id_column, dim)


def read_json_vectors(spark: SparkSession, path: str, id_column: str, dim: int | None = None) -> DataFrame:
    """Embeddings from lines of {id: [values]} objects."""
    parsed = spark.read.text(path).select(F.from_json("value", "map<string,array<float>>").alias("m"))
    return checked_dim(parsed.select(F.explode("m").alias(id_column, "vector")), dim)


def topic_options(servers: str, topics: str | list[str], per_trigger: int | None = None, starting: str = "earliest") -> dict[str, str]:
    """Options of the topic source: one or many topics, from the earliest offset."""
    names = topics if isinstance(topics, str) else ",".join(topics)
    options = {"kafka.bootstrap.servers": servers, "subscribe": names, "startingOffsets": starting}
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def read_topic(spark: SparkSession, servers: str, topics: str | list[str], per_trigger: int | None = None) -> DataFrame:
    """Streaming topic source; needs the Kafka connector package on the class path."""
    return spark.readStream.format("kafka").options(**topic_options(servers, topics, per_trigger)).load()


def decode_messages(messages: DataFrame, ddl: str = MESSAGE_DDL) -> DataFrame:
    """JSON text in `value` to columns; `_corrupt_record` keeps a text that does not parse."""
    schema = T.StructType.fromDDL(f"{ddl}, _corrupt_record string")
    parsed = F.from_json(
        F.col("value").cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    return messages.select(parsed.alias("_m")).select("_m.*")


def split_messages(decoded: DataFrame, required: tuple = ("event_type", "user_id", "timestamp")) -> tuple[DataFrame, DataFrame]:
    """(good messages, malformed or incomplete ones)."""
    bad = F.col("_corrupt_record").isNotNull()
    for c in required:
        bad = bad | F.col(c).isNull()
    return decoded.where(~bad).drop("_corrupt_record"), decoded.where(bad)


def flatten_structs(df: DataFrame, json_columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Structs to columns <parent>_<child>, arrays to JSON text; JSON text columns by their known keys."""
    out = []
    for f in df.schema:
        if json_columns and f.name in json_columns:
            out += [F.get_json_object(f.name, f"$.{k}").alias(f"{f.name}_{k}") for k in json_columns[f.name]]
        elif isinstance(f.dataType, T.StructType):
            for child in f.dataType:
                value = F.col(f"{f.name}.{child.name}")
                nested = isinstance(child.dataType, (T.ArrayType, T.MapType, T.StructType))
                out.append((F.to_json(value) if nested else value).alias(f"{f.name}_{child.name}"))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def json_keys(df: DataFrame, column: str, limit: int = 1_000) -> list[str]:
    """Keys seen in a JSON text column; fails beyond `limit` rather than widening without bound."""
    keys = df.select(F.explode(F.json_object_keys(column)).alias("k")).distinct().limit(limit + 1).collect()
    if len(keys) > limit:
        raise ValueError(f"more than {limit} keys in {column}")
    return sorted(r["k"] for r in keys)
