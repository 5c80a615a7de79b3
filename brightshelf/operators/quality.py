"""Event quality: rule checks, duplicates, outliers, volume and null rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brightshelf.operators.ordered import exact_quantiles
from brightshelf.session import small_side
from brightshelf.sources.schemas import EVENT_TYPES


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail before any job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def event_rules() -> dict[str, Column]:
    """Rule name -> condition a valid event meets."""
    return {
        "event_id": F.col("event_id").isNotNull(),
        "user_id": F.col("user_id").isNotNull() & (F.col("user_id") >= 0),
        "item_id": F.col("item_id").isNotNull() & (F.col("item_id") >= 0),
        "event_type": F.col("event_type").isin(EVENT_TYPES),
        "ts": F.col("ts").isNotNull(),
        "value": F.col("value").isNull() | (F.col("value") >= 0),
    }


def failed_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `failed`: the names of the rules a row breaks (empty for a valid row)."""
    checks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.withColumn("failed", F.array_compact(checks))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their failed rules)."""
    checked = failed_rules(df, rules)
    return checked.where(F.size("failed") == 0).drop("failed"), checked.where(F.size("failed") > 0)


def deduplicate(df: DataFrame, key: str, ts: str) -> DataFrame:
    """First arrival per id, by partial aggregation rather than by sorting copies in one group."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), ts).alias("_r")).select(key, "_r.*")


def outliers(df: DataFrame, value: str, key: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the interquartile fences of their key (such as the event type)."""
    q = exact_quantiles(df, value, {"_q1": 0.25, "_q3": 0.75}, [key])
    spread = F.col("_q3") - F.col("_q1")
    fences = q.select(key, (F.col("_q1") - factor * spread).alias("low"), (F.col("_q3") + factor * spread).alias("high"))
    return df.join(small_side(fences, "fences"), key).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def daily_volume(df: DataFrame, max_drop: float = 0.5) -> DataFrame:
    """Events per day, the day before, and whether volume fell by more than `max_drop`."""
    days = df.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    previous = days.select(F.date_add("day", 1).alias("day"), F.col("events").alias("previous"))
    joined = days.join(previous, "day", "left")
    return joined.withColumn(
        "dropped", F.coalesce(F.col("events") < F.col("previous") * (1 - max_drop), F.lit(False))
    )


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of nulls per column: (column, null_rate)."""
    means = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in columns])
    return means.select(F.explode(pairs).alias("_p")).select("_p.*")
