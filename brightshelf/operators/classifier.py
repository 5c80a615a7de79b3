"""Boosted classifier and regressor: trees grown on the log loss of labels 0 and 1, or on squared errors.

Rows with the same bins and label have the same score in every round, so they are kept once, with their
number. Blocks of such cells are kept by the executors while the trees grow: a pass per tree brings
the scores up to date, draws how many rows of each cell the tree sees and forms their residual; a pass
per level adds up histograms, from which the driver chooses the splits. Where no two rows are
alike a cell is a row, and the passes are the same. The regressor takes all rows and features, and keeps rows
with the same bins once whatever their labels, with the mean of these.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from brightshelf.operators.boosting import BLOCK_ROWS, STORE_ROUNDS, Forest, Tree, best_splits, checked, cut_points, hashed, histograms, matrix_of
from brightshelf.session import checkpointed, discard, drop_checkpoint, materialise, removing_shuffles, tasks_for

# Settings of the boosted classifier.
RATE, DEPTH, BINS, FEATURE_SHARE, ROW_SHARE = 0.1, 6, 32, 0.8, 0.8
REGRESSOR_DEPTH = 5
# Up to so many equal rows the number drawn comes from the exact distribution, beyond from its normal limit.
EXACT_DRAWS = 32
# Accuracy of the quantiles: their ranks are off by a part in so many.
ACCURACY = 3_200


def drawn(n: np.ndarray, draws: np.ndarray, seed: int, share: float) -> np.ndarray:
    """How many of `n` rows a sample has that takes each row with chance `share`; repeatable by `draws` and `seed`."""
    u, v = ((hashed(draws, 2 * seed + i) >> np.uint64(11)) * 2.0**-53 for i in (0, 1))
    out = (u >= 1 - share).astype(float)
    few = np.flatnonzero((n > 1) & (n <= EXACT_DRAWS))
    table = np.full((EXACT_DRAWS + 1, EXACT_DRAWS), 2.0)  # chance of at most k of n
    for k in range(2, EXACT_DRAWS + 1):
        table[k, :k] = np.cumsum([math.comb(k, j) * share**j * (1 - share) ** (k - j) for j in range(k)])
    out[few] = (u[few, None] >= table[n[few]]).sum(axis=1)
    many = np.flatnonzero(n > EXACT_DRAWS)
    z = np.sqrt(-2 * np.log1p(-u[many])) * np.cos(2 * np.pi * v[many])
    out[many] = np.clip(np.rint(n[many] * share + z * np.sqrt(n[many] * share * (1 - share))), 0, n[many])
    return out


class Cells:
    """Equal rows of a part of the table: bin codes, sign (1 or -1 for label 1 or 0), number of rows, draw and score."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, width)
        self.signs = (2 * batch.column("label").to_numpy() - 1).astype(np.int8)
        self.n, self.draws = (batch.column(c).to_numpy() for c in ("n", "draw"))
        self.scores, self.pulls = np.zeros(batch.num_rows), []

    def pull(self, tree: Tree | None, seed: int, share: float) -> Cells:
        """Bring the scores up to date with one more tree and form what the next one is grown on.

        The first tree is grown on the signs, every later one on the falling gradient of 2 log(1 + exp(-2 sign score)).
        """
        target = self.signs.astype(float)
        if tree:
            self.scores = self.scores + tree.predict(self.codes)
            target *= 4 / (1 + np.exp(np.minimum(2 * self.signs * self.scores, 700)))
        taken = drawn(self.n, self.draws, seed, share)
        self.pulls = [(self.codes, None, np.stack([taken * target, taken]))]
        return self


class Means(Cells):
    """Rows with equal bins of a part of the table: bin codes, mean label, number of rows and score."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        super().__init__(batch, width)
        self.labels = batch.column("label").to_numpy()

    def pull(self, tree: Tree | None, seed: int, share: float) -> Means:
        """The first tree is grown on the labels, every later one on the falling gradient of (label - score)^2."""
        target = self.labels
        if tree:
            self.scores = self.scores + tree.predict(self.codes)
            target = 2 * (self.labels - self.scores)
        self.pulls = [(self.codes, None, np.stack([self.n * target, self.n]))]
        return self


def cuts_of(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """At most BINS - 1 cut points of each column; of a column with at most BINS values all are told apart.

    Quantiles are taken eight times as fine, then thinned out: one that stands for many rows takes no bins from the rest.
    """
    sizes = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if sizes[c] <= 2 * BINS]
    values = rows.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in few]).first() if few else {}
    out = dict(zip(columns, cut_points(rows, columns, 8 * BINS, ACCURACY)))
    for c, fine in out.items():
        at = np.rint(np.linspace(-1, len(fine), BINS + 1)[1:-1]).astype(int)
        out[c] = [fine[i] for i in at] if len(fine) >= BINS else fine
        if c in few and len(values[c]) <= BINS:
            out[c] = [(a + b) / 2 for a, b in zip(values[c], values[c][1:])]
    return list(out.values())


def _cells(rows: DataFrame, features: list[str], label: str, means: bool = False) -> tuple[list[list[float]], DataFrame]:
    """Cut points of the features, and the cells: codes, label, n, draw; with `means` one cell whatever the labels."""
    y = F.col(label).cast("double")
    if means:
        y = F.when(y.isNotNull() & ~F.isnan(y), y).otherwise(F.raise_error(F.lit("labels must be numbers")))
    else:
        y = F.when(y.isin(0.0, 1.0), y).otherwise(F.raise_error(F.lit("labels must be 0 or 1")))
    names = [f"x{i}" for i in range(len(features))]
    with removing_shuffles(rows.sparkSession):
        kept = materialise(rows.select(y.alias("label"), *[checked(c).alias(n) for c, n in zip(features, names)]), "classifier-rows")
    cuts = cuts_of(kept, names)
    model = Forest(features, cuts, [])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.codes(matrix_of(batch.column("x"), len(features)))
            ends = pa.py_buffer(np.arange(0, codes.size + 1, len(features), dtype=np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, ends, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("label"), packed], names=["label", "codes"])

    coded = kept.select("label", F.array(*names).alias("x")).mapInArrow(code, "label double, codes binary")
    with removing_shuffles(rows.sparkSession):
        if means:
            cells = coded.groupBy("codes").agg(F.avg("label").alias("label"), F.count("*").alias("n"))
        else:
            cells = coded.groupBy("codes", "label").agg(F.count("*").alias("n"))
        cells = materialise(cells.withColumn("draw", F.xxhash64("codes", "label")), "cells")
    discard(kept)
    return cuts, cells


def _kept(cells: DataFrame, width: int, kind: type = Cells) -> RDD:
    """A list of blocks per task."""
    tasks = tasks_for(cells.count(), cells.sparkSession.sparkContext.defaultParallelism)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(kind(batch.slice(at, BLOCK_ROWS), width))], pa.binary())], names=["block"])

    packed = cells.repartition(tasks).mapInArrow(pack, "block binary").rdd
    return packed.mapPartitions(lambda rows: [[pickle.loads(r.block) for r in rows]])


def fit_classifier(rows: DataFrame, features: list[str], label: str = "label", rounds: int = 100, seed: int = 42) -> Forest:
    """Boosted trees whose scores are log odds: `prediction` is the chance of label 1.

    Every tree sees its own sample of the rows, every node its own share of the features. Splits are
    those that leave the least squared error; a leaf holds the mean of its rows, and trees after the first are shrunk.
    """
    cuts, cells = _cells(rows, features, label)
    if cells.isEmpty():
        raise ValueError("no rows to fit a classifier on")
    return _boosted(cells, Cells, Forest(features, cuts, [], True), DEPTH, FEATURE_SHARE, rounds, seed)


def fit_regressor(rows: DataFrame, features: list[str], label: str = "label", rounds: int = 100, seed: int = 42) -> Forest:
    """Boosted trees whose scores are labels, on all rows and features; splits and leaves as of the classifier."""
    cuts, cells = _cells(rows, features, label, means=True)
    if cells.isEmpty():
        raise ValueError("no rows to fit a regressor on")
    return _boosted(cells, Means, Forest(features, cuts, []), REGRESSOR_DEPTH, 1.0, rounds, seed)


def _boosted(cells: DataFrame, kind: type, forest: Forest, depth: int, feature_share: float, rounds: int, seed: int) -> Forest:
    """`forest` with `rounds` trees grown on the cells, which are then deleted."""
    features, cuts, spark = forest.features, forest.cuts, cells.sparkSession
    n_bins = max(map(len, cuts), default=0) + 1
    some = math.ceil(feature_share * len(features))
    rng = np.random.default_rng(seed)
    blocks_of, stored, tree = _kept(cells, len(features), kind), None, None
    for number in range(rounds):
        before, last = blocks_of, tree
        blocks_of = before.map(lambda part, last=last, number=number: [b.pull(last, seed + number, ROW_SHARE) for b in part])
        blocks_of = blocks_of.persist(StorageLevel.MEMORY_AND_DISK)
        if number % STORE_ROUNDS == STORE_ROUNDS - 1 and number + 1 < rounds:
            checkpointed(spark, blocks_of)
        rate, tree, open_nodes = RATE if number else 1.0, Tree(), [0]
        for level in range(depth):
            sums = histograms(blocks_of, tree, open_nodes, list(range(len(features))), n_bins)
            if not level:
                g, n = sums[0, 0, :, 0].sum(), sums[0, 0, :, 1].sum()
                tree.value[0] = rate * float(g / max(n, 1))
            allowed = np.array([np.isin(np.arange(len(features)), rng.permutation(len(features))[:some]) for _ in open_nodes])
            splits = zip(best_splits(sums, 0, 1, rate, allowed), open_nodes)
            open_nodes = [node for s, at in splits if s for node in tree.split(at, s[1], s[2], s[0], s[3])]
            if not open_nodes:
                break
        forest.trees.append(tree)
        if number:
            before.unpersist()
        if blocks_of.isCheckpointed():
            drop_checkpoint(spark, stored)
            stored = blocks_of
    if rounds:
        blocks_of.unpersist()
    drop_checkpoint(spark, stored)
    discard(cells)
    return forest


class BoostedClassifier:
    """Unfitted classifier; rows need label besides the features."""

    def __init__(self, features: list[str], seed: int = 42, rounds: int = 100):
        self.features, self.seed, self.rounds = features, seed, rounds

    def fit(self, rows: DataFrame) -> Forest:
        return fit_classifier(rows, self.features, rounds=self.rounds, seed=self.seed)


class BoostedRegressor:
    """Unfitted regressor; rows need label besides the features."""

    def __init__(self, features: list[str], seed: int = 42, rounds: int = 100):
        self.features, self.seed, self.rounds = features, seed, rounds

    def fit(self, rows: DataFrame) -> Forest:
        return fit_regressor(rows, self.features, rounds=self.rounds, seed=self.seed)
