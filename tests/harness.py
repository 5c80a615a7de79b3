"""Run registered queries in Spark and in DuckDB and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(series: pd.Series) -> str:
    kinds = {type(v).__name__ for v in series if v is not None and not (isinstance(v, float) and math.isnan(v))}
    return ",".join(sorted(k.replace("64", "").replace("_", "") for k in kinds))


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if value is pd.NA:
        return "~"
    if isinstance(value, float):
        return repr(value + 0.0)
    if hasattr(value, "item"):
        return _cell(value.item())
    return str(value)


def _whole(series: pd.Series) -> bool:
    """Integers, or integers with nulls whatever pandas made of them."""
    if series.dtype.kind in "iu":
        return True
    return bool(series.dtype.kind == "f" and series.isna().any() and (series.dropna() % 1 == 0).all())


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    df = df.assign(**{c: df[c].astype("Int64") for c in df if df[c].dtype.kind == "f" and df[c].isna().any() and _whole(df[c])})
    return sorted(tuple(_cell(v) for v in row) for row in df.itertuples(index=False))


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(duck_df.columns)}"
    for c in spark_df.columns:
        a, b = spark_df[c].dtype, duck_df[c].dtype
        # Nulls turn integers into floats or nullable integers; a column of nulls alone has any type.
        empty = spark_df[c].isna().all() and duck_df[c].isna().all()
        whole = all(_whole(df[c]) for df in (spark_df, duck_df))
        if len(spark_df) and a != b and not empty and not whole and not {a.kind, b.kind} & {"O", "T"}:
            return f"type of {c}: {a} != {b}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} != {len(duck_df)}"
    a, b = canonical(spark_df), canonical(duck_df)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, first: {bad[0][0]} | {bad[0][1]}"
    return None


def main(argv: list[str]) -> int:
    import logging

    from brightshelf.session import local_session
    import __spark_entry__ as e

    logging.disable(logging.CRITICAL)
    sf_dir = f"/root/testdata/{argv[0]}"
    wanted = argv[1:]
    qs, sqls = e.queries(), e.oracle_sql()
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    names = [n for n in qs if not wanted or any(n == w or n.startswith(w) for w in wanted)]
    for name in names:
        t = time.time()
        try:
            got = qs[name](spark, sf_dir).toPandas()
            took = time.time() - t
            if name in sqls:
                t = time.time()
                want = con.execute(sqls[name]).df()
                duck_took = time.time() - t
                diff = compare(got, want)
                status = "ok" if diff is None else f"DIFF {diff}"
                if diff is None and len(got) == 0:
                    status = "ok EMPTY"
            else:
                duck_took, status = 0.0, "rows-only"
        except Exception as ex:  # noqa: BLE001
            took, duck_took, got = time.time() - t, 0.0, []
            status = "ERROR " + type(ex).__name__ + " " + str(ex)[:700].replace("\n", " ")
        if not status.startswith(("ok", "rows-only")):
            bad += 1
        print(f"{name:45s} {len(got):7d} rows {took:6.2f}s duck {duck_took:5.2f}s {status}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(min(1, main(sys.argv[1:])))
