"""The test data set seen as interactions, catalogue, users, purchases and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightshelf.session import configure
from brightshelf.sources.schemas import TABLE_DDL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.schema(TABLE_DDL[name]).parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log: event_id, user_id, item_id, event_type, ts, value."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        "event_type",
        "ts",
        "value",
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as purchases: user_id, item_id, ts, quantity, price, discount."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue: item_id, name, category, brand, price, inventory."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").cast("bigint").alias("inventory"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users: user_id, name, segment, location (nation name)."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("location"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item embeddings: item_id, vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")
    )


def user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User embeddings: user_id, vector (the vector of the same id)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("user_id"), F.col("embedding").alias("vector")
    )
