"""Query registry and the SQL building blocks the oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under `name`, with the SQL that must give the same rows."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


INTERACTIONS = """interactions AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         event_type, ts, value
  FROM events)"""

PRODUCTS = """products AS (
  SELECT p_partkey AS item_id, p_name AS name, p_type AS category, p_brand AS brand,
         p_retailprice AS price, CAST(p_size AS BIGINT) AS inventory
  FROM part)"""

USERS = """users AS (
  SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS segment, n_name AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

PURCHASES = """purchases AS (
  SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, o_custkey AS user_id,
         l_partkey AS item_id, o_orderdate AS ts, l_quantity AS quantity,
         l_extendedprice AS price, l_discount AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

VECTORS = """vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""

SAFE_RATIO = "CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} ELSE 0.0 END"


def ratio(n: str, d: str) -> str:
    return SAFE_RATIO.format(n=n, d=d)


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def word(text: str, i: int = 0) -> str:
    """32-bit word of an md5 digest as BIGINT."""
    return f"CAST(('0x' || substr(md5({text}), {1 + 8 * i}, 8)) AS BIGINT)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
