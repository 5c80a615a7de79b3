"""Offline metrics over ranked recommendations, scores and exposures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightshelf.functions.scalar import count_when, safe_divide
from brightshelf.operators.ordered import bucket_of, cut_points, prefix_sums
from brightshelf.operators.topk import top_k
from brightshelf.session import materialise

# Metrics reported where there is nothing to evaluate.
NO_SAMPLE_METRICS = {"auc": 0.5, "accuracy": 0.5, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric: (keys, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return wide.select(*keys, F.explode(pairs).alias("_m")).select(*keys, "_m.*")


def _spine(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    one = df.sparkSession.range(1)
    return one.select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column))


def hit_and_mrr(recs: DataFrame, truth: DataFrame, sources: list[str], ks: tuple = (1, 5, 10)) -> DataFrame:
    """Hit@k and MRR per source, averaged over (user, actual item) pairs.

    Expects (user_id, item_id, rank, source) and distinct truth pairs; ranks beyond the
    largest k count as misses, as do users without recommendations.
    """
    deepest = max(ks)
    hits = recs.where(F.col("rank") <= deepest).join(truth.select("user_id", "item_id"), ["user_id", "item_id"])
    summed = hits.groupBy("source").agg(
        *[count_when(F.col("rank") <= k).cast("double").alias(f"hit_at_{k}") for k in ks],
        F.sum(F.lit(1.0) / F.col("rank")).alias("mrr"),
    )
    names = [f"hit_at_{k}" for k in ks] + ["mrr"]
    pairs = truth.agg(F.count("*").alias("n")).scalar()
    # A source without hits still has a row: zeros are added to the sums.
    zeros = _spine(recs, "source", sources).select("source", *[F.lit(0.0).alias(m) for m in names])
    every = summed.unionByName(zeros).groupBy("source").agg(*[F.sum(m).alias(m) for m in names]).withColumn("_n", pairs)
    rates = every.select("source", *[safe_divide(F.col(m), F.col("_n")).alias(m) for m in names])
    return long_metrics(rates, ["source"], names)


def ndcg(lists: DataFrame, ks: tuple = (1, 3, 10)) -> DataFrame:
    """Mean NDCG@k over users: lists hold (user_id, item_id, score, relevance)."""
    deepest = max(ks)

    def gains(order: str, prefix: str) -> DataFrame:
        ranked = top_k(lists, deepest, ["user_id"], order)
        gain = F.col("relevance") / F.log2(F.col("rank") + 1)
        return ranked.groupBy("user_id").agg(
            *[F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"{prefix}{k}") for k in ks]
        )

    both = gains("score", "dcg").join(gains("relevance", "ideal"), "user_id")
    means = both.agg(*[F.avg(safe_divide(F.col(f"dcg{k}"), F.col(f"ideal{k}"))).alias(f"ndcg@{k}") for k in ks])
    return long_metrics(means.select(*[F.col(f"`ndcg@{k}`").alias(f"ndcg_{k}") for k in ks]), [], [f"ndcg_{k}" for k in ks])


def mean_squared_error(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) - F.col(prediction)) ** 2).alias("mse"), F.count("*").alias("n"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve with ties counted half; 0.5 when one class is missing."""
    per_score = df.where(F.col(score).isNotNull()).groupBy(score).agg(
        count_when(F.col(label) == 1).alias("_pos"), count_when(F.col(label) == 0).alias("_neg")
    )
    ranked = prefix_sums(
        per_score, [F.col(score)], {"_below": F.col("_neg")}, bucket_of(F.col(score), cut_points(df, score))
    )
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    won = F.sum(pos * (F.col("_below") - neg + neg / 2))
    total = F.sum(pos) * F.sum(neg)
    return ranked.agg(F.when(total > 0, won / total).otherwise(F.lit(0.5)).alias("auc"))


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row of accuracy, precision, recall, F1 at the threshold, and AUC."""
    yes, predicted = F.col(label) == 1, F.col(score) >= threshold
    counts = df.agg(
        F.count("*").alias("n"),
        count_when(yes & predicted).alias("tp"),
        count_when(~yes & predicted).alias("fp"),
        count_when(yes & ~predicted).alias("fn"),
        count_when(~yes & ~predicted).alias("tn"),
    )
    precision = safe_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    rates = counts.select(
        "n",
        safe_divide(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        safe_divide(2 * precision * recall, precision + recall).alias("f1"),
        auc(df, label, score).scalar().alias("auc"),
    )
    names = list(NO_SAMPLE_METRICS)
    return rates.select(
        "n", *[F.when(F.col("n") > 0, F.col(m)).otherwise(F.lit(NO_SAMPLE_METRICS[m])).alias(m) for m in names]
    )


def grade(metric: Column, value: Column) -> Column:
    """good / fair / poor by the report's bounds."""
    three_way = F.when(value >= 0.7, "good").when(value >= 0.4, "fair").otherwise("poor")
    return (
        F.when(metric.startswith("ndcg"), F.when(value >= 0.7, "good").otherwise("poor"))
        .when(metric == "mse", F.when(value <= 0.1, "good").when(value <= 0.3, "fair").otherwise("poor"))
        .otherwise(three_way)
    )


def precision_recall_map(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Precision@k, Recall@k and MAP@k averaged over users with truth."""
    relevant = truth.groupBy("user_id").agg(F.count("*").alias("relevant"))
    hits = recs.where(F.col("rank") <= k).join(truth.select("user_id", "item_id"), ["user_id", "item_id"])
    w = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A user has at most k hits, so this window is short.
    per_user = hits.withColumn("_at", F.count("*").over(w) / F.col("rank")).groupBy("user_id").agg(
        F.count("*").alias("hits"), F.sum("_at").alias("precisions")
    )
    joined = relevant.join(per_user, "user_id", "left").fillna(0, subset=["hits", "precisions"])
    return joined.agg(
        F.avg(F.col("hits") / F.lit(float(k))).alias("precision"),
        F.avg(F.col("hits") / F.col("relevant")).alias("recall"),
        F.avg(F.col("precisions") / F.col("relevant")).alias("map"),
        F.count("*").alias("users"),
    )


def coverage_metrics(recs: DataFrame, truth: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue coverage, hit rate per user, and mean candidates per user."""
    items = recs.select("item_id").distinct().join(catalogue.select("item_id"), "item_id", "left_semi")
    per_user = recs.groupBy("user_id").agg(F.count("*").alias("_n"))
    hit_users = recs.join(truth.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").select("user_id").distinct()
    truth_users = truth.select("user_id").distinct()
    one = per_user.agg(F.avg("_n").alias("avg_candidates"))
    return one.select(
        "avg_candidates",
        safe_divide(items.agg(F.count("*")).scalar(), catalogue.agg(F.count("*")).scalar()).alias("coverage"),
        safe_divide(hit_users.agg(F.count("*")).scalar(), truth_users.agg(F.count("*")).scalar()).alias("hit_rate"),
    )


def gini(exposures: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of a count column, from its distinct values only."""
    groups = exposures.groupBy(F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    cuts = cut_points(exposures, value)
    ranked = prefix_sums(groups, [F.col("_x")], {"_cum": F.col("_c")}, bucket_of(F.col("_x"), cuts))
    # ranks of the group run from cum - c + 1 to cum
    rank_sum = F.col("_c") * (2 * F.col("_cum") - F.col("_c") + 1) / 2.0
    n, total = F.sum("_c"), F.sum(F.col("_c") * F.col("_x"))
    weighted = F.sum(rank_sum * F.col("_x"))
    return ranked.agg(
        F.when((n > 0) & (total > 0), (2 * weighted - (n + 1) * total) / (n * total)).otherwise(F.lit(0.0)).alias("gini")
    )


def diversity(recs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Share of categories recommended, their entropy, and the Gini of item exposure over the catalogue."""
    exposure = recs.groupBy("item_id").agg(F.count("*").alias("exposures"))
    items = catalogue.select("item_id", "category").join(exposure, "item_id", "left").fillna(0, subset=["exposures"])
    items = materialise(items, "exposures")  # one row per item, read by three measures
    per_category = items.groupBy("category").agg(F.sum("exposures").alias("_n"))
    total = per_category.agg(F.sum("_n")).scalar()
    share = per_category.withColumn("_p", safe_divide(F.col("_n"), total))
    return share.agg(
        safe_divide(count_when(F.col("_n") > 0), F.count("*")).alias("category_coverage"),
        F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.log("_p")).otherwise(0.0)).alias("entropy"),
    ).select("category_coverage", "entropy", gini(items, "exposures").scalar().alias("gini"))


def exposure_gauges(shown: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: exposures, coverage (share of the catalogue shown) and diversity (entropy of categories).

    Exposures are added up per item before anything is joined, so a hot key or item is one row per
    item afterwards. Items outside the catalogue count as exposures only; with an empty catalogue,
    or nothing of it shown, coverage and diversity are 0. An item without a category is a category of its own kind.
    """
    per_item = shown.groupBy(*keys, "item_id").agg(F.count("*").alias("_n"))
    items = catalogue.select("item_id", "category", F.lit(1).alias("_known")).dropDuplicates(["item_id"])
    per_category = per_item.join(items, "item_id", "left").groupBy(*keys, "_known", "category").agg(
        F.sum("_n").alias("_n"), F.count("*").alias("_items")
    )
    known = F.when(F.col("_known") == 1, F.col("_n"))
    # H = ln(total) - sum(n ln n) / total, so the share of a category needs no second pass.
    sums = per_category.groupBy(*keys).agg(
        F.sum("_n").alias("exposures"),
        F.sum(F.when(F.col("_known") == 1, F.col("_items"))).alias("_items"),
        F.sum(known).alias("_total"),
        F.sum(known * F.log(known)).alias("_log"),
    )
    size = items.count()
    return sums.select(
        *keys, "exposures",
        (F.coalesce("_items", F.lit(0)) / F.lit(float(max(size, 1)))).alias("coverage"),
        F.coalesce(F.log("_total") - F.col("_log") / F.col("_total"), F.lit(0.0)).alias("diversity"),
    )


def business_rates(events: DataFrame, keys: list[str] | None = None, shown: str = "view") -> DataFrame:
    """CTR, conversion and revenue per impression, over all rows or per key."""
    kind = F.col("event_type")
    counted = events.groupBy(*(keys or [])).agg(
        count_when(kind == shown).alias("impressions"),
        count_when(kind == "click").alias("clicks"),
        count_when(kind == "purchase").alias("purchases"),
        F.sum(F.when(kind == "purchase", F.col("value")).otherwise(0.0)).alias("revenue"),
    )
    return counted.select(
        "*",
        safe_divide(F.col("clicks"), F.col("impressions")).alias("ctr"),
        safe_divide(F.col("purchases"), F.col("impressions")).alias("conversion_rate"),
        safe_divide(F.col("revenue"), F.col("impressions")).alias("revenue_per_recommendation"),
    )


def log_loss(df: DataFrame, label: str, score: str, floor: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(floor)), F.lit(1.0 - floor))
    loss = -(F.col(label) * F.log(p) + (F.lit(1.0) - F.col(label)) * F.log(F.lit(1.0) - p))
    return df.agg(F.avg(loss).alias("log_loss"))


def user_cohorts(events: DataFrame, returning_from: int, power_from: int) -> DataFrame:
    """(user_id, cohort): new, returning or power user by number of events."""
    n = F.count("*")
    cohort = F.when(n >= power_from, "power").when(n >= returning_from, "returning").otherwise("new")
    return events.groupBy("user_id").agg(cohort.alias("cohort"))


def propensity_weighted_mean(df: DataFrame, value: str, propensity: str, keys: list[str] | None = None) -> DataFrame:
    """Mean of `value` weighted by inverse propensity (self-normalised)."""
    weight = F.lit(1.0) / F.col(propensity)
    return df.groupBy(*(keys or [])).agg(
        (F.sum(F.col(value) * weight) / F.sum(weight)).alias("weighted_mean"), F.count("*").alias("n")
    )
