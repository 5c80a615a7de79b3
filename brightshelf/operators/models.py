"""Ranking models by name."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from brightshelf.operators import boosting, classifier, neural

# Fixed value: trees of the boosted rankers and the boosted regressor.
BOOST_ROUNDS = 100


# Names under which a ranker can be asked for.
RANKERS = {
    "pointwise": "pointwise",
    "pairwise": "pairwise",
    "xgboost": "pairwise",
    "listwise": "listwise",
    "lightgbm": "listwise",
    "neural": "neural",
}


def ranker(name: str, features: list[str], seed: int = 42, rounds: int = BOOST_ROUNDS):
    """Unfitted ranker by name; an unknown name is a ValueError.

    An unfitted ranker has no transform, so predicting before training cannot happen.
    """
    if name not in RANKERS:
        raise ValueError(f"unknown ranker {name!r}; known: {', '.join(RANKERS)}")
    if RANKERS[name] == "listwise":
        return boosting.ListwiseRanker(features, seed, rounds)
    if RANKERS[name] in ("pointwise", "neural"):
        # Networks count epochs: never more than their own number.
        loss = "bce" if RANKERS[name] == "pointwise" else "mse"
        return neural.NeuralRanker(features, loss, seed, min(rounds, neural.EPOCHS))
    return classifier.BoostedClassifier(features, seed, rounds)


def boosted_regressor(features: list[str], seed: int = 42, rounds: int = BOOST_ROUNDS) -> classifier.BoostedRegressor:
    """Boosted regression on the label, which knows nothing of lists; the listwise ranker is measured against it."""
    return classifier.BoostedRegressor(features, seed, rounds)


def score(model, rows: DataFrame) -> DataFrame:
    """Add `score`: the probability of class 1, or the prediction of a regressor, network or listwise ranker."""
    out = model.transform(rows)
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*rows.columns, value.alias("score"))


def pairwise_rows(positives: DataFrame, negatives: DataFrame, features: list[str], on: list[str]) -> DataFrame:
    """Feature differences of each positive against its own sampled negatives, both ways round.

    `positives` and `negatives` share the columns `on`, which identify one positive; it has
    a fixed number of negatives, so rows grow with the positives and not with their square.
    """
    left = positives.select(*on, *[F.col(c).alias(f"_p_{c}") for c in features])
    right = negatives.select(*on, *[F.col(c).alias(f"_n_{c}") for c in features])
    joined = left.join(right, on)
    both = F.explode(F.array(F.lit(1.0), F.lit(0.0)))
    signed = joined.select("*", both.alias("label"))
    sign = F.col("label") * 2 - 1
    return signed.select("label", *[(sign * (F.col(f"_p_{c}") - F.col(f"_n_{c}"))).alias(c) for c in features])


def save(model, path: str) -> None:
    """Write a fitted ranker with its feature names and parameters."""
    if isinstance(model, (boosting.Forest, neural.Network)):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load(path: str):
    """Read what `save` has written; a pipeline has a metadata folder, other models are one text."""
    spark = SparkSession.active()
    stored = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if stored.getFileSystem(spark._jsc.hadoopConfiguration()).exists(stored):
        return PipelineModel.load(path)
    text = spark.read.text(path, wholetext=True).first()[0]
    return (boosting.Forest if '"trees"' in text else neural.Network).from_text(text)


def feature_importance(model) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted tree ranker: one entry per assembled feature."""
    if isinstance(model, boosting.Forest):
        return model.importance()
    names = model.stages[0].getInputCols()
    return list(zip(names, (float(x) for x in model.stages[-1].featureImportances.toArray())))
