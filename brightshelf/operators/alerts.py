"""Windowed rates, latency quantiles and alert conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brightshelf.functions.scalar import count_when, safe_divide
from brightshelf.operators.ordered import exact_quantiles

STEP_SECONDS = 300


def window_start(ts: str = "ts", seconds: int = STEP_SECONDS) -> Column:
    """Start of the tumbling window as epoch seconds."""
    return F.unix_seconds(F.window(ts, f"{seconds} seconds")["start"])


def windowed_rates(events: DataFrame, seconds: int = STEP_SECONDS) -> DataFrame:
    """Counts and rates per window, in one pass with partial aggregation."""
    kind = F.col("event_type")
    counted = events.groupBy(window_start(seconds=seconds).alias("window_start")).agg(
        F.count("*").alias("events"),
        count_when(kind == "view").alias("views"),
        count_when(kind == "click").alias("clicks"),
        count_when(kind == "purchase").alias("purchases"),
        count_when(kind == "error").alias("errors"),
        F.avg("value").alias("mean_latency"),
    )
    return counted.select(
        "*",
        safe_divide(F.col("clicks"), F.col("views")).alias("ctr"),
        safe_divide(F.col("purchases"), F.col("views")).alias("conversion_rate"),
        safe_divide(F.col("errors"), F.col("events")).alias("error_rate"),
    )


def held_for(windows: DataFrame, breached: Column, periods: int, seconds: int = STEP_SECONDS) -> DataFrame:
    """Windows at which the condition has held for the last `periods` windows in a row.

    Each breached window votes for itself and the next periods - 1 windows; a window with
    all votes that is breached itself fires. No ordering over the whole table is needed.
    A missing window breaks a run.
    """
    bad = windows.where(breached).select("window_start")
    steps = F.sequence(F.lit(0), F.lit(periods - 1))
    votes = bad.select("window_start", F.explode(steps).alias("_s")).select(
        (F.col("window_start") + F.col("_s") * seconds).alias("window_start")
    )
    full = votes.groupBy("window_start").agg(F.count("*").alias("_v")).where(F.col("_v") == periods)
    return bad.join(full.select("window_start"), "window_start", "left_semi")


def latency_quantiles(events: DataFrame, value: str, probs: dict[str, float], seconds: int = STEP_SECONDS) -> DataFrame:
    """Exact latency quantiles per window."""
    keyed = events.select(window_start(seconds=seconds).alias("window_start"), value)
    return exact_quantiles(keyed, value, probs, ["window_start"])
