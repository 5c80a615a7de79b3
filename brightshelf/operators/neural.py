"""Neural rankers: fully connected networks trained by data-parallel minibatches.

Rows are dealt into minibatches by hash. The executors keep them as arrays, every minibatch in partitions
of its own, about one per core, so a step is one pass over these. Tasks add up the gradients of their
rows; the driver adds the sums of the tasks, and holds the weights and the optimiser's state. Without dropout
rows of a minibatch that are equal in inputs and label are kept once, with their number.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from brightshelf.session import materialise, tasks_for

# Settings of the neural rankers.
HIDDEN, DROPOUT, EPOCHS = (128, 64), 0.2, 10
CLASSIFIER_HIDDEN = (256, 128)  # wide enough for a tower of 128 units per side, then 128 for both
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
# Minibatches are tables here and not 256 rows, so there are fewer steps, and each is larger.
STEPS, RATE = 16, 0.01
# Rows whose values of all units stay in the processor's cache.
CHUNK = 2_048


def layer_sizes(width: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    return list(zip((width, *hidden), (*hidden, 1)))


def unpack(weights: np.ndarray, sizes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, bias) of every layer, as views of one vector of parameters."""
    out, at = [], 0
    for a, b in sizes:
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def n_weights(sizes: list[tuple[int, int]]) -> int:
    return sum(a * b + b for a, b in sizes)


def forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], masks: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Values before and behind every layer; hidden layers keep positive values, times their mask."""
    out = [x]
    for k, (w, c) in enumerate(layers):
        z = out[-1] @ w + c
        if k + 1 < len(layers):
            np.maximum(z, 0, out=z)
            if masks is not None:
                z *= masks[k]
        out.append(z)
    return out


def keep_masks(draws: np.ndarray, sizes: list[tuple[int, int]], seed: int, dropout: float) -> list[np.ndarray]:
    """Which hidden units a row keeps, by hashes of row, unit and seed; kept ones are scaled up."""
    masks, unit = [], 0
    for _, width in sizes[:-1]:
        h = draws.astype(np.uint64)[:, None] + np.arange(unit, unit + width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        masks.append((h >= np.uint64(int(dropout * 2**64))) / (1 - dropout))
        unit += width
    return masks


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, sizes, loss: str, masks=None, n: np.ndarray | float = 1.0) -> tuple[np.ndarray, float]:
    """Sums over the rows, each of which counts `n` times: gradient of all parameters, and the loss."""
    layers = unpack(weights, sizes)
    values = forward(x, layers, masks)
    z = values[-1][:, 0]
    if loss == "mse":
        lost, delta = float((n * (z - y) ** 2).sum()), 2 * (z - y)
    else:
        lost, delta = float((n * (np.logaddexp(0, z) - y * z)).sum()), 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
    delta = (n * delta)[:, None]
    parts: list[np.ndarray] = []
    for k in range(len(layers) - 1, -1, -1):
        parts = [(values[k].T @ delta).ravel(), delta.sum(axis=0), *parts]
        if k:
            delta = delta @ layers[k][0].T
            delta *= values[k] > 0
            if masks is not None:
                delta *= masks[k - 1]
    return np.concatenate(parts), lost


def initial_weights(sizes, seed: int) -> np.ndarray:
    """Uniform within +-1 / sqrt(inputs) of a layer."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, a * b + b) / np.sqrt(max(a, 1)) for a, b in sizes])


@dataclass
class Network:
    """Fitted network: inputs are standardised features; `loss` "bce" makes the prediction a probability."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    hidden: tuple[int, ...]
    weights: np.ndarray
    loss: str
    losses: list[float]  # mean loss of each epoch, with dropout

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = (x - np.array(self.mean)) / np.array(self.scale)
        z = forward(x, unpack(self.weights, layer_sizes(len(self.features), self.hidden)))[-1][:, 0]
        return z if self.loss == "mse" else 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def transform(self, rows: DataFrame) -> DataFrame:
        """`rows` and `prediction`; null and NaN features count as 0.0."""
        if "prediction" in rows.columns:
            raise ValueError("column prediction is there already")
        packed = rows.select(F.struct(*rows.columns).alias("_row"), inputs(self.features).alias("_x"))
        model = packed.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(model.value.predict(x))], names=["_row", "prediction"])

        schema = packed.select("_row").withColumn("prediction", F.lit(0.0)).schema
        return packed.mapInArrow(run, schema).select("_row.*", "prediction")

    def save(self, spark, path: str) -> None:
        text = json.dumps(vars(self) | {"weights": self.weights.tolist()})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def from_text(text: str) -> Network:
        stored = json.loads(text)
        return Network(**stored | {"hidden": tuple(stored["hidden"]), "weights": np.array(stored["weights"])})


def inputs(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])


def standardisation(rows: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """Mean and deviation of every feature; a constant one has deviation 1."""
    x = rows.select(*[inputs([c])[0].alias(f"x{k}") for k, c in enumerate(features)])
    row = x.agg(*[f(f"x{k}").alias(f"{n}{k}") for k in range(len(features)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [row[f"m{k}"] or 0.0 for k in range(len(features))], [row[f"s{k}"] or 1.0 for k in range(len(features))]


class Adam:
    """Adam steps on a mean gradient."""

    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, weights: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = BETA1 * self.m + (1 - BETA1) * g
        self.v = BETA2 * self.v + (1 - BETA2) * g * g
        m, v = self.m / (1 - BETA1**self.t), self.v / (1 - BETA2**self.t)
        return weights - self.rate * m / (np.sqrt(v) + EPSILON)


def _step_of(draw: Column, steps: int) -> Column:
    return F.pmod(F.xxhash64(draw), F.lit(steps)).cast("int")


def _counted(dealt: DataFrame, steps: int) -> DataFrame:
    """Different rows (x, y) of each minibatch, with their number as `draw`."""
    return dealt.groupBy(_step_of(F.col("draw"), steps).alias("step"), "x", "y").agg(F.count("*").alias("draw"))


def _minibatches(dealt: DataFrame, steps: int, seed: int) -> tuple[RDD, int]:
    """(draw, x, y) as arrays, those of a step in as many partitions as returned, one step behind the other.

    The step follows from the draw if there is no column `step`.
    """
    dealt = materialise(dealt, "minibatches")
    rows = dealt.count()
    tasks = tasks_for(-(-rows // steps), dealt.sparkSession.sparkContext.defaultParallelism)
    step = F.col("step") if "step" in dealt.columns else _step_of(F.col("draw"), steps)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = batch.column("draw").to_numpy(), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("y").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part)], pa.binary())], names=["part"])

    spread = dealt.repartitionById(steps * tasks, step * tasks + F.floor(F.rand(seed) * tasks).cast("int"))
    packed = spread.mapInArrow(pack, "part binary").rdd.map(lambda r: pickle.loads(r.part))
    return packed.persist(StorageLevel.MEMORY_AND_DISK), tasks if rows else 0


def _step(dealt: RDD, parts: range, weights: np.ndarray, sizes, loss: str, seed: int, dropout: float) -> tuple[np.ndarray, float, int]:
    """Summed gradient, loss and number of rows of one minibatch, which lies in these partitions.

    Without dropout `draw` is the number of equal rows.
    """

    def run(arrays):
        total, lost, rows = np.zeros(len(weights)), 0.0, 0
        for draw, x, y in arrays:
            for at in range(0, len(y), CHUNK):
                part = slice(at, at + CHUNK)
                masks, n = (keep_masks(draw[part], sizes, seed, dropout), np.ones(len(y[part]), np.int64)) if dropout else (None, draw[part])
                g, l = gradient(x[part], y[part], weights, sizes, loss, masks, n)
                total += g
                lost, rows = lost + l, rows + int(n.sum())
        yield total, lost, rows

    found = dealt.context.runJob(dealt, run, parts) if parts else []
    return sum((g for g, _, _ in found), np.zeros(len(weights))), sum(l for _, l, _ in found), sum(n for _, _, n in found)


def fit_network(
    rows: DataFrame, features: list[str], label: str = "label", hidden: tuple[int, ...] = HIDDEN, loss: str = "mse", dropout: float = DROPOUT,
    epochs: int = EPOCHS, steps: int = STEPS, rate: float = RATE, seed: int = 42,
) -> Network:
    """Network on all rows with a label. Every epoch goes through all `steps` minibatches once, in a new order.

    Which minibatch a row belongs to follows from a hash of its values, so repeated rows share
    one. Without rows the network keeps its first weights.
    """
    if loss not in ("mse", "bce"):
        raise ValueError(f"unknown loss {loss!r}; known: mse, bce")
    labelled = rows.where(F.col(label).isNotNull())
    mean, scale = standardisation(labelled, features)
    sizes = layer_sizes(len(features), hidden)
    weights = initial_weights(sizes, seed)
    x = F.transform(
        F.arrays_zip(inputs(features).alias("x"), F.array(*[F.lit(m) for m in mean]).alias("m"), F.array(*[F.lit(s) for s in scale]).alias("s")),
        lambda v: (v["x"] - v["m"]) / v["s"],
    )
    dealt = labelled.select(F.xxhash64(*rows.columns).alias("draw"), x.alias("x"), F.col(label).cast("double").alias("y"))
    dealt, tasks = _minibatches(dealt if dropout else _counted(dealt, steps), steps, seed)
    adam, rng, losses = Adam(len(weights), rate), np.random.default_rng(seed + 1), []
    for epoch in range(epochs):
        lost, n = 0.0, 0
        for step in rng.permutation(steps):
            parts = range(int(step) * tasks, (int(step) + 1) * tasks)
            g, l, count = _step(dealt, parts, weights, sizes, loss, seed + epoch * steps + int(step), dropout)
            if count:
                weights = adam.step(weights, g / count)
                lost, n = lost + l, n + count
        losses.append(lost / n if n else 0.0)
    dealt.unpersist()
    return Network(list(features), mean, scale, tuple(hidden), weights, loss, losses)


class NeuralRanker:
    """Unfitted network on the rows' label: "mse" a regressor, "bce" a classifier."""

    def __init__(self, features: list[str], loss: str, seed: int = 42, epochs: int = EPOCHS):
        self.features, self.loss, self.seed, self.epochs = features, loss, seed, epochs

    def fit(self, rows: DataFrame) -> Network:
        hidden, dropout = (HIDDEN, DROPOUT) if self.loss == "mse" else (CLASSIFIER_HIDDEN, 0.0)
        return fit_network(rows, self.features, hidden=hidden, loss=self.loss, dropout=dropout, epochs=self.epochs, seed=self.seed)
