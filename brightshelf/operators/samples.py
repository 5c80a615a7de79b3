"""Training sets: labels, feature rows, splits and negative samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from brightshelf.functions.scalar import md5_fraction, md5_word
from brightshelf.operators.features import time_slice
from brightshelf.operators.ordered import bucket_of, contiguous_index, cut_points, hash_bucket, prefix_sums
from brightshelf.session import materialise, partitions_for, small_side
from brightshelf.sources.schemas import EVENT_TYPES, POSITIVE_EVENTS

INDEX_BUCKET = 65_536
# Rows of drawn negatives a task sorts.
TASK_DRAWS = 250_000


def labelled_window(events: DataFrame, window_days: int) -> DataFrame:
    """Events of the window with label 1 for a purchase or add-to-cart."""
    label = F.when(F.col("event_type").isin(POSITIVE_EVENTS), 1).otherwise(0)
    return time_slice(events, window_days).withColumn("label", label)


def one_hot_event_type(df: DataFrame) -> DataFrame:
    """One 0/1 column per event type. It reveals the label, so assembly leaves it out by default."""
    flags = [F.when(F.col("event_type") == t, 1.0).otherwise(0.0).alias(f"is_{t}") for t in EVENT_TYPES]
    return df.select("*", *flags)


def training_rows(
    labelled: DataFrame,
    user_features: DataFrame,
    product_features: DataFrame,
    user_columns: list[str],
    product_columns: list[str],
    one_hot: bool = False,
) -> DataFrame:
    """Every labelled row with its user and product features; a missing entity has zeros."""
    users = user_features.select("user_id", *[F.col(c).cast("double").alias(f"user_{c}") for c in user_columns])
    items = product_features.select("item_id", *[F.col(c).cast("double").alias(f"product_{c}") for c in product_columns])
    joined = labelled.join(users, "user_id", "left").join(items, "item_id", "left")
    names = [f"user_{c}" for c in user_columns] + [f"product_{c}" for c in product_columns]
    filled = joined.fillna(0.0, subset=names)
    return one_hot_event_type(filled) if one_hot else filled


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `is_test`: exactly round(share x n) rows of every class, picked by hash order."""
    draw = md5_word(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    hashed = df.withColumn("_h", draw)
    ranked = prefix_sums(
        hashed, [F.col("_h"), F.col(key)], {"_rank": F.lit(1)}, hash_bucket(F.col("_h"), df), [label]
    )
    wanted = F.floor(F.col("_rank_total") * F.lit(test_share) + 0.5)
    return ranked.withColumn("is_test", F.col("_rank") <= wanted).select(*df.columns, "is_test")


def time_split(df: DataFrame, key: str, shares: tuple = (0.7, 0.1, 0.2), ts: str = "ts") -> DataFrame:
    """Add `split` by time order: the oldest rows train, the next validate, the newest test."""
    micros = df.withColumn("_t", F.unix_micros(ts))
    cuts = cut_points(micros, "_t")
    ranked = prefix_sums(micros, [F.col("_t"), F.col(key)], {"_rank": F.lit(1)}, bucket_of(F.col("_t"), cuts))
    first, second = shares[0], shares[0] + shares[1]
    split = (
        F.when(F.col("_rank") <= F.floor(F.col("_rank_total") * F.lit(first) + 0.5), "train")
        .when(F.col("_rank") <= F.floor(F.col("_rank_total") * F.lit(second) + 0.5), "validation")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).select(*df.columns, "split")


def not_interacted_ranges(pairs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """What a user has not interacted with, as ranges over the catalogue index.

    Rows (user_id, start, end, shift, n_other, buckets): the complement items of rank
    start <= r < end have catalogue index r + shift. A user has at most (history + 1)
    ranges, so the complement is whole without a row per user and item. `catalogue`
    holds (item_id, index).
    """
    indexed = pairs.join(catalogue, "item_id").select("user_id", F.col("index"))
    ranked = prefix_sums(
        indexed, [F.col("index")], {"_rank": F.lit(1)}, F.floor(F.col("index") / INDEX_BUCKET), ["user_id"]
    ).select("user_id", F.col("_rank").alias("rank"), (F.col("index") - F.col("_rank") + 1).alias("gap"))
    ranked = materialise(ranked, "history-ranks")
    size = catalogue.agg(F.count("*").alias("n")).scalar()
    users = ranked.groupBy("user_id").agg(F.count("*").alias("buckets")).withColumn("_size", size)
    users = users.select("user_id", "buckets", (F.col("_size") - F.col("buckets")).alias("n_other"))
    starts = ranked.select("user_id", F.col("gap").alias("start"), F.col("rank").alias("shift")).unionByName(
        users.select("user_id", F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("shift"))
    )
    ends = ranked.select("user_id", (F.col("rank") - 1).alias("shift"), F.col("gap").alias("_end"))
    joined = starts.join(ends, ["user_id", "shift"], "left").join(users, "user_id")
    ranges = joined.withColumn("end", F.coalesce("_end", "n_other")).where("start < end")
    return ranges.select("user_id", "start", "end", "shift", "n_other", "buckets")


def pick_from_ranges(draws: DataFrame, ranges: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Resolve complement ranks `r` of `draws` (user_id, r, ...) to item ids.

    Draws and ranges meet on (user, bucket of r); a user has as many buckets as history
    items, so a bucket holds about one range and a hot user is spread over many keys.
    """
    bucket = F.floor(F.col("r") * F.col("buckets") / F.col("n_other"))
    first = F.floor(F.col("start") * F.col("buckets") / F.col("n_other"))
    last = F.floor((F.col("end") - 1) * F.col("buckets") / F.col("n_other"))
    spread = ranges.select(
        F.col("user_id").alias("_u"), "start", "end", "shift", F.explode(F.sequence(first, last)).alias("_b")
    )
    # A task's share stays the same however many draws there are: joins alone would keep to a fixed number of tasks.
    draws = materialise(draws.withColumn("_bucket", bucket), "draws")
    parts = partitions_for(draws.sparkSession, draws.count(), TASK_DRAWS)
    keyed = draws.repartition(parts, "user_id", "_bucket")
    spread = spread.repartition(parts, "_u", "_b")
    on = (
        (F.col("user_id") == F.col("_u")) & (F.col("_bucket") == F.col("_b"))
        & (F.col("r") >= F.col("start")) & (F.col("r") < F.col("end"))
    )
    found = keyed.join(spread, on).withColumn("index", F.col("r") + F.col("shift"))
    named = catalogue.withColumnRenamed("item_id", "negative_item_id").repartition(parts, "index")
    return found.repartition(parts, "index").join(named, "index")


def _with_complement_size(df: DataFrame, ranges: DataFrame) -> DataFrame:
    sizes = ranges.groupBy("user_id").agg(F.max("n_other").alias("n_other"), F.max("buckets").alias("buckets"))
    return df.join(sizes, "user_id")


def negatives_with_replacement(pairs: DataFrame, products: DataFrame, per_positive: int = 4, seed: str = "neg") -> DataFrame:
    """`per_positive` items per positive (user, item) pair that the user has not interacted with.

    Draws are independent, so an item may come twice; none has to be rejected. A user who
    has interacted with everything has none.
    """
    catalogue = materialise(contiguous_index(products, "item_id"), "catalogue")
    ranges = materialise(not_interacted_ranges(pairs, catalogue), "complement")
    sized = _with_complement_size(pairs, ranges).select(
        "*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(per_positive).cast("bigint"))).alias("draw")
    )
    text = F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in ("user_id", "item_id", "draw")])
    draws = sized.withColumn("r", F.floor(md5_fraction(text) * F.col("n_other")))
    return pick_from_ranges(draws, ranges, catalogue).select("user_id", "item_id", "draw", "negative_item_id")


def _with_distinct_draws(df: DataFrame, text: Column, size: str, k: int) -> DataFrame:
    """Add columns _r0.. of k different uniform ranks below `size`; null beyond it.

    Draw j picks among size - j ranks and steps over the ranks taken before, lowest first.
    """
    for j in range(k):
        rank = F.floor(md5_fraction(F.concat_ws(":", text, F.lit(str(j)))) * (F.col(size) - j))
        if j:
            taken = F.array_sort(F.array(*[F.col(f"_r{i}") for i in range(j)]))
            rank = F.aggregate(taken, rank, lambda acc, t: acc + F.when(acc >= t, 1).otherwise(0))
        df = df.withColumn(f"_r{j}", F.when(F.col(size) > j, rank))
    return df


def negatives_without_replacement(
    events: DataFrame, products: DataFrame, per_event: int = 4, key: str = "event_id", seed: str = "neg"
) -> DataFrame:
    """Up to `per_event` different items per interaction from the user's complement."""
    catalogue = materialise(contiguous_index(products, "item_id"), "catalogue")
    ranges = materialise(not_interacted_ranges(events.select("user_id", "item_id").distinct(), catalogue), "complement")
    sized = _with_complement_size(events.select(key, "user_id"), ranges)
    text = F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))
    drawn = _with_distinct_draws(sized, text, "n_other", per_event)
    ranks = F.array(*[F.col(f"_r{j}") for j in range(per_event)])
    draws = drawn.select(*sized.columns, F.posexplode(ranks).alias("draw", "r")).where(F.col("r").isNotNull())
    return pick_from_ranges(draws, ranges, catalogue).select(
        key, "user_id", F.col("draw").cast("bigint").alias("draw"), "negative_item_id"
    )


def global_negatives(events: DataFrame, ratio: int = 2, seed: str = "global") -> DataFrame:
    """ratio x n random (user, item) pairs without interaction, over the users and items of `events`.

    Draw number `try` is a uniform rank among all free pairs, ordered by user and item, so no draw is
    ever rejected and every free pair has the same chance, however dense the table is; a pair may come
    twice. Prefix sums of the users' complement sizes lead from the rank to the user, the complement
    ranges from there to the item. Users of a table without free pairs give no rows; rows without a
    user or item count in n only.
    """
    pairs = materialise(events.select("user_id", "item_id").dropna().distinct(), "pairs")
    catalogue = materialise(contiguous_index(pairs.select("item_id"), "item_id"), "catalogue")
    ranges = materialise(not_interacted_ranges(pairs, catalogue), "complement")
    sizes = ranges.groupBy("user_id").agg(F.max("n_other").alias("n_other"), F.max("buckets").alias("buckets"))
    users = contiguous_index(sizes.select("user_id"), "user_id", "_ui").join(sizes, "user_id")
    summed = prefix_sums(users, [F.col("_ui")], {"_until": F.col("n_other")}, F.floor(F.col("_ui") / INDEX_BUCKET))
    summed = materialise(summed.select("user_id", "n_other", "buckets", (F.col("_until") - F.col("n_other")).alias("_from"), F.col("_until")), "complement-sums")
    n_users, free = summed.agg(F.count("*"), F.coalesce(F.max("_until"), F.lit(0))).first()
    # Stretches of ranks: about one user each, and as many draws in each, so no key is hot.
    width = max(1, math.ceil(free / max(1, n_users)))
    first, last = F.floor(F.col("_from") / width), F.floor((F.col("_until") - 1) / width)
    owners = summed.withColumn("_stretch", F.explode(F.sequence(first, last)))
    text = F.concat_ws(":", F.lit(seed), F.col("try").cast("string"))
    fraction = (md5_word(text, 0) + md5_word(text, 1) / F.lit(4294967296.0)) / F.lit(4294967296.0)
    draws = events.sparkSession.range(1, ratio * events.count() + 1).select(F.col("id").alias("try"))
    draws = draws.withColumn("_g", F.least(F.floor(fraction * F.lit(float(free))), F.lit(free - 1)))
    draws = draws.withColumn("_stretch", F.floor(F.col("_g") / width))
    owned = draws.join(owners, "_stretch").where((F.col("_g") >= F.col("_from")) & (F.col("_g") < F.col("_until")))
    ranked = owned.select("try", "user_id", "n_other", "buckets", (F.col("_g") - F.col("_from")).alias("r"))
    return pick_from_ranges(ranked, ranges, catalogue).select("try", "user_id", F.col("negative_item_id").alias("item_id"))


def context_features(events: DataFrame, context: Column) -> DataFrame:
    """Hour, day of week, device and referrer of each event."""
    return events.select(
        "*",
        F.hour("ts").alias("hour"),
        F.dayofweek("ts").alias("day_of_week"),
        F.coalesce(F.get_json_object(context, "$.device"), F.lit("unknown")).alias("device"),
        F.coalesce(F.get_json_object(context, "$.referrer"), F.lit("unknown")).alias("referrer"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Add `weight` = n / (classes x n of the class): every class weighs the same in total."""
    counts = small_side(df.groupBy(label).agg(F.count("*").alias("_c")), "class-counts")
    totals = counts.agg(F.struct(F.sum("_c").alias("n"), F.count("*").alias("k"))).scalar()
    joined = df.join(counts, label).withColumn("_t", totals)
    return joined.select(*df.columns, (F.col("_t.n") / (F.col("_t.k") * F.col("_c"))).alias("weight"))


def undersample(df: DataFrame, label: str, key: str, keep: dict[int, float], seed: str = "under") -> DataFrame:
    """Keep a hashed share of each class (a sampling operator; classes not named are kept whole)."""
    draw = md5_fraction(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    share = F.lit(1.0)
    for value, part in keep.items():
        share = F.when(F.col(label) == value, F.lit(part)).otherwise(share)
    return df.where(draw < share)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content version: row count, sum of row hashes, and 8 hex digits of both."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
    sums = df.agg(
        F.count("*").alias("rows"),
        # decimals: the sum of 32-bit words leaves 64 bits after two thousand million rows
        *[F.coalesce(F.sum(md5_word(row, i).cast("decimal(20,0)")), F.lit(0)).alias(f"h{i}") for i in (0, 1)],
    )
    text = F.concat_ws(":", F.col("rows").cast("string"), F.col("h0").cast("string"), F.col("h1").cast("string"))
    return sums.select("rows", F.substring(F.sha2(text, 256), 1, 8).alias("version"))
