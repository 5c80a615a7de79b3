"""Listwise ranker: boosted trees grown on lambda gradients of NDCG.

Rows of one list (the candidates of one user) are stored together, long lists in pieces of bounded
size. Blocks of pieces are kept by the executors while the trees grow. A pass per tree brings the scores
up to date, forms the gradient of every row from the swaps with the head of its list, and adds up those of
rows with the same bin codes; a pass per level reads these sums only, adds up gradient histograms per
tree node, feature and bin, and the driver chooses the splits.

A pair of rows counts if its better placed row is among the first `head` of the list. A piece
of a long list is told that head only: it makes the gradients of its own rows and the share its
rows have in those of the head, and since histograms are sums nothing else is needed.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame, Window, functions as F

from brightshelf.session import checkpointed, drop_checkpoint, materialise, small_side, tasks_for

# Settings of the listwise ranker.
RATE, LEAVES, FEATURE_SHARE, ROW_SHARE, ROW_SHARE_ROUNDS = 0.1, 31, 0.8, 0.8, 5
HEAD, BINS, PIECE = 30, 64, 4_096
LEAST_ROWS, LEAST_HESSIAN = 20, 1e-3
STORE_ROUNDS = 10
# Rows of a block, at which its arrays stay in the processor's cache.
BLOCK_ROWS = 32_768
# Pairs of a row and a head row formed at a time; from so many rows on a list is gone through along its rows.
PAIRS, LONG = 32_768, 64
# Differences of scores whose exponential is a product of two.
SPAN = 300
# Up to so many tasks hand their histograms straight to the driver.
DIRECT_TASKS = 64


# --- gradients ------------------------------------------------------------------------------


def gains_of(relevance: np.ndarray) -> np.ndarray:
    return np.exp2(relevance) - 1


class Block:
    """Pieces of lists, their rows one behind the other, sorted by item within a piece.

    `heads` has the head of the whole list by piece, for pieces of split lists.
    """

    def __init__(self, batch: pa.RecordBatch):
        items = batch.column("items")
        self.first = np.r_[0, np.cumsum(np.diff(items.offsets.to_numpy()))]
        self.of = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(self.first))
        self.items = items.flatten()
        self.draws, self.relevance, self.scores = (batch.column(c).flatten().to_numpy() for c in ("draws", "relevance", "scores"))
        raw = batch.column("codes").to_pylist()
        self.codes = np.frombuffer(b"".join(raw), np.uint8).reshape(len(self.of), -1) if len(self.of) else np.zeros((0, 0), np.uint8)
        self.ideal = batch.column("ideal").to_numpy()
        self.lists = batch.column("list_id")
        self.split = np.flatnonzero(batch.column("pieces").to_numpy() > 1)
        self.heads = {}
        if "head_s" in batch.schema.names:
            for p in self.split.tolist():
                s, rel, draw = (batch.column(f"head_{c}")[p].values.to_numpy() for c in ("s", "rel", "draw"))
                self.heads[p] = Head(s, rel, draw, batch.column("head_item")[p].as_py(), batch.column("head_codes")[p].as_py())

    def order(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by piece, falling score and item, and the place of each of them in its piece."""
        order = np.lexsort((-scores, self.of))
        return order, np.arange(len(order)) - self.first[self.of[order]]

    def gradients(self, scores: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gradient, curvature) of the rows; the same of the heads of split lists, and the piece each of these belongs to.

        Pairs are formed of a row and a head row placed before it, so each pair is formed once,
        by the piece of the later row; what it does to a head row goes back to that row, in another
        piece if the list is split. A pair weighs what a swap would change NDCG by.
        """
        n = len(self.first) - 1
        # Gains as shares of the ideal; a list without any relevant row has none, so no pair of it counts.
        shares = np.divide(1.0, self.ideal, out=np.zeros(n), where=self.ideal > 0)
        order, place = self.order(scores)
        of, s = self.of[order], scores[order]
        gain = gains_of(self.relevance[order]) * shares[of]
        top, top_gain, at = np.zeros((n, head)), np.zeros((n, head)), np.full((n, head), -1)
        top += s[self.first[:-1], None] if n else 0  # places that a short list does not have
        tops = np.minimum(np.diff(self.first), head)
        inside = np.flatnonzero(place < head)
        cells = of[inside], place[inside]
        top[cells], top_gain[cells], at[cells] = s[inside], gain[inside], inside
        place = np.minimum(place, head)
        for p, best in self.heads.items():
            at[p], tops[p] = -1, len(best.s)
            top[p], top[p, : len(best.s)], top_gain[p, : len(best.s)] = best.s[0], best.s, gains_of(best.rel) * shares[p]
            own = slice(self.first[p], self.first[p + 1])
            draws = self.draws[order[own]]
            by_draw = np.argsort(best.draw)
            found = by_draw[np.minimum(np.searchsorted(best.draw, draws, sorter=by_draw), len(by_draw) - 1)]
            place[own] = np.where(best.draw[found] == draws, found, head)
        weights = np.r_[1 / np.log2(np.arange(head) + 2.0), 0.0]
        weight = weights[place]
        g, h = np.zeros(len(s)), np.zeros(len(s))
        top_g, top_h = np.zeros((n, head)), np.zeros((n, head))
        for lists, m, width in self.alike(tops):
            row = self.first[lists][:, None] + np.arange(m)
            real = row < self.first[lists + 1][:, None]
            row = np.where(real, row, 0)
            # What fills up a shorter list weighs more than any place, so that no pair of it counts.
            pairs = pulls(gain[row], s[row], np.where(real, weight[row], 2.0), top_gain[lists, :width], top[lists, :width], weights[:width])
            g[row[real]], h[row[real]] = pairs[0][real], pairs[1][real]
            top_g[lists, :width] -= pairs[2]
            top_h[lists, :width] += pairs[3]
        held = at >= 0
        g[at[held]] += top_g[held]
        h[at[held]] += top_h[held]
        own = np.empty((2, len(s)))
        own[:, order] = g, h
        away = [np.concatenate([t[p, : len(b.s)] for p, b in self.heads.items()] or [np.zeros(0)]) for t in (top_g, top_h)]
        return own, np.stack(away), np.repeat(np.array(list(self.heads), np.int64), [len(b.s) for b in self.heads.values()])

    def alike(self, tops: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """Pieces of like length together: (pieces, rows of the longest, most head rows)."""
        lengths = np.diff(self.first)
        by_length = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(by_length):
            m = int(lengths[by_length[at]])
            short = np.searchsorted(-lengths[by_length], -m / 2, "right")
            lists = by_length[at : max(at + 1, min(int(short), at + PAIRS // max(1, m * int(tops.max()))))]
            yield lists, m, int(tops[lists].max())
            at += len(lists)


def pulls(gain: np.ndarray, s: np.ndarray, weight: np.ndarray, top_gain: np.ndarray, top: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums (gradient, curvature) by row and by head row of all their pairs, for lists of one length.

    Arrays by list and row: gain, score and weight of the place; by list and head row: gain and score. Rows placed
    before a head row, or being it, differ from it by no positive weight.
    """
    if s.shape[1] >= LONG:  # lists, head rows, rows
        rows, heads, by_row, by_head = (lambda x: x[:, None, :]), (lambda x: x[:, :, None]), 1, 2
    else:  # head rows, rows, lists
        rows, heads, by_row, by_head = (lambda x: np.ascontiguousarray(x.T)[None]), (lambda x: np.ascontiguousarray(x.T)[:, None]), 0, 1
    best = top[:, :1]
    if max(np.ptp(top), (best - s).max()) < SPAN:
        odds = rows(np.exp(s - best)) * heads(np.exp(best - top))
    else:
        odds = np.exp(np.clip(rows(s) - heads(top), -50, 50))
    more = rows(gain) - heads(top_gain)  # positive: the row should stand before the head row
    behind = 1 / (odds + 1)
    odds *= behind
    wrong = np.where(more > 0, behind, odds)
    more *= np.maximum(heads(weights[None]) - rows(weight), 0)
    wrong *= more
    bend = np.abs(more, out=more)
    bend *= behind
    bend *= odds
    found = wrong.sum(axis=by_row), bend.sum(axis=by_row), wrong.sum(axis=by_head), bend.sum(axis=by_head)
    return found if by_row else tuple(x.T for x in found)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of bin codes in a fixed order, and which of them each row is."""
    if not codes.size:
        return codes[:1], np.zeros(len(codes), np.int64)
    whole = np.ascontiguousarray(codes).view(np.dtype((np.void, codes.shape[1])))[:, 0]
    found, of = np.unique(whole, return_inverse=True)
    return found.view(np.uint8).reshape(len(found), -1), of


class Part:
    """Blocks of a task. Rows with the same bin codes are a cell: they have the same score and meet in the histograms."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        ends = np.cumsum([len(b.codes) for b in blocks])
        self.codes, of = distinct(np.concatenate([b.codes for b in blocks])) if blocks else (np.zeros((0, 0), np.uint8), np.zeros(0, np.int64))
        for b, cell in zip(blocks, np.split(of, ends[:-1])):
            b.cell, b.codes, b.scores = cell.astype(np.int32), None, None
            if not len(b.split):
                b.items = b.lists = None

    def pull(self, scores: np.ndarray, head: int, seed: int) -> Sums:
        """Gradients of the present scores of the cells."""
        cells, values, away = [np.zeros(0, np.int32)], [np.zeros((2, 0))], []
        for b in self.blocks:
            own, gone, piece_of = b.gradients(scores[b.cell], head)
            keep = np.flatnonzero(_taken(b.draws, seed, ROW_SHARE))
            cells.append(b.cell[keep]), values.append(own[:, keep])
            if len(piece_of):
                codes = np.frombuffer(b"".join(c for x in b.heads.values() for c in x.codes), np.uint8).reshape(len(piece_of), -1)
                away.append((codes, np.concatenate([x.draw for x in b.heads.values()]), gone))
        of, (g, h) = np.concatenate(cells), np.concatenate(values, axis=1)
        sums = np.stack([np.bincount(of, w, len(self.codes)) for w in (g, h, None)])
        return Sums(self.codes, scores, [(self.codes, None, sums), *away] if self.blocks else [])


@dataclass
class Sums:
    """Cells of a task with their scores; `pulls` are sums of gradients: (bin codes, draws if not drawn yet, values)."""

    codes: np.ndarray
    scores: np.ndarray
    pulls: list


@dataclass
class Head:
    """First rows of a whole list, best first."""

    s: np.ndarray
    rel: np.ndarray
    draw: np.ndarray
    item: list
    codes: list[bytes]


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[Block]:
    """Blocks of about `rows` rows."""
    for batch in batches:
        ends = np.r_[0, np.cumsum(np.diff(batch.column("items").offsets.to_numpy()))]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + rows, "right")) - 1)
            yield Block(pa.RecordBatch.from_arrays([c.take(pa.array(range(at, to))) for c in batch.columns], schema=batch.schema))
            at = to


# --- trees ----------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in arrays: a row goes left when its bin is at most the node's; a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, gain: float, values: tuple[float, float]) -> list[int]:
        """Make two leaves below `node`; the right one follows the left one."""
        low = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, at, low, gain
        for v in values:
            self.feature.append(-1), self.bin.append(0), self.left.append(0), self.value.append(v), self.gain.append(0.0)
        return [low, low + 1]

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        """Leaf of each row of bin codes."""
        feature, bins, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        leaf = feature < 0
        feature[leaf], bins[leaf], left[leaf] = 0, 255, np.flatnonzero(leaf)  # a row stays at its leaf
        depth = [0] * len(feature)
        for node in np.flatnonzero(~leaf).tolist():
            depth[left[node]] = depth[left[node] + 1] = depth[node] + 1
        flat, first = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
        at = np.zeros(len(codes), np.int64)
        for _ in range(max(depth)):
            right = flat.take(first + feature.take(at)) > bins.take(at)
            at = left.take(at) + right
        return at

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(codes)]


@dataclass
class Forest:
    """Fitted ranker: feature names, their cut points and the trees; `logistic` if twice the sum of the trees is log odds."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]
    logistic: bool = False

    def codes(self, matrix: np.ndarray) -> np.ndarray:
        """Bin of every value: how many cut points lie below it. Null and NaN count as 0.0."""
        out = np.zeros(matrix.shape, np.uint8)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.searchsorted(np.array(cuts), np.nan_to_num(matrix[:, f]), "left")
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """`rows` and `prediction`: the sum of the trees, or the probability that follows from it."""
        if "prediction" in rows.columns:
            raise ValueError("column prediction is there already")
        value = checked if self.logistic else lambda c: F.col(c).cast("double")
        packed = rows.select(F.struct(*rows.columns).alias("_row"), F.array(*[value(c) for c in self.features]).alias("_x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    # Rows with the same bins have the same score.
                    codes, of = np.unique(self.codes(matrix_of(batch.column("_x"), len(self.features))), axis=0, return_inverse=True)
                    score = (np.sum([t.predict(codes) for t in self.trees], axis=0) if self.trees else np.zeros(len(codes)))[of]
                    if self.logistic:
                        score = 1 / (1 + np.exp(np.minimum(-2 * score, 700)))
                    yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(score)], names=["_row", "prediction"])

        schema = packed.select("_row").withColumn("prediction", F.lit(0.0)).schema
        return packed.mapInArrow(run, schema).select("_row.*", "prediction")

    def importance(self) -> list[tuple[str, float]]:
        """(feature, share of the gain of all splits)."""
        gain = dict.fromkeys(range(len(self.features)), 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gain[f] += g
        total = sum(gain.values()) or 1.0
        return [(name, gain[f] / total) for f, name in enumerate(self.features)]

    def save(self, spark, path: str) -> None:
        text = json.dumps({"features": self.features, "cuts": self.cuts, "trees": [vars(t) for t in self.trees], "logistic": self.logistic})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def from_text(text: str) -> Forest:
        stored = json.loads(text)
        return Forest(stored["features"], stored["cuts"], [Tree(**t) for t in stored["trees"]], stored.get("logistic", False))


def checked(name: str) -> Column:
    """A feature as a double; null and NaN are errors."""
    value = F.col(name).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"null or NaN in feature {name}"))).otherwise(value)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Lists of `width` doubles as rows; null entries are 0.0."""
    return np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, width)


# --- the table of list pieces ---------------------------------------------------------------


def cut_points(rows: DataFrame, features: list[str], bins: int = BINS, accuracy: int = 100 * BINS) -> list[list[float]]:
    """At most `bins` - 1 cut points of each feature, at about equal shares of the rows."""
    probs = [i / bins for i in range(1, bins)]
    columns = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features]
    row = rows.agg(*[F.percentile_approx(c, probs, accuracy).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [sorted(set(cuts or [])) for cuts in row]


def list_pieces(
    rows: DataFrame, features: list[str], cuts: list[list[float]] | None, list_id: str, item_id: str, relevance: str,
    head: int = HEAD, piece: int = PIECE, score: Column | None = None,
) -> DataFrame:
    """One row per piece of a list: list_id, pieces, items, relevance, draws, codes, scores, ideal.

    Rows without list, item or relevance are left out. Of rows that repeat a list and item the
    one of highest relevance counts. `ideal` is the ideal DCG of the first `head` rows of the whole list.
    """
    model = Forest(features, cuts or [[] for _ in features], [])
    x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features]).cast("array<double>")
    score = F.lit(0.0) if score is None else score.cast("double")
    usable = rows.select(F.col(list_id).alias("list_id"), F.col(item_id).alias("item"), F.struct(F.col(relevance).cast("double").alias("rel"), score.alias("score"), x.alias("x")).alias("v"))
    usable = usable.where("list_id is not null and item is not null and v.rel is not null")
    once = materialise(usable.groupBy("list_id", "item").agg(F.max("v").alias("v")).select("list_id", "item", "v.*"), "list-rows")
    sizes = once.groupBy("list_id").agg(F.count("*").alias("n"))
    long = small_side(sizes.where(F.col("n") > piece).select("list_id", F.ceil(F.col("n") / piece).alias("pieces")), "long-lists")
    placed = once.join(long, "list_id", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("item"), F.col("pieces")))
    grouped = placed.groupBy("list_id", "pieces", "piece").agg(
        F.sort_array(F.collect_list(F.struct("item", F.xxhash64("list_id", "item").alias("draw"), "rel", "score", "x"))).alias("r")
    )
    grouped = grouped.select("list_id", "pieces", *[F.col(f"r.{c}").alias(name) for c, name in (("item", "items"), ("draw", "draws"), ("rel", "relevance"), ("score", "scores"), ("x", "x"))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            codes = model.codes(matrix_of(x.flatten(), len(features))) if features else np.zeros((0, 0), np.uint8)
            ends = np.r_[0, np.cumsum(np.asarray(x.value_lengths(), np.int64))] * len(features)
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], packed], names=[*kept, "codes"])

    kept = ["list_id", "pieces", "items", "draws", "relevance", "scores"]
    coded = grouped.mapInArrow(code, ", ".join(f"{c} {grouped.schema[c].dataType.simpleString()}" for c in kept) + ", codes binary")
    whole = F.slice(F.sort_array(F.flatten(F.collect_list(F.slice(F.sort_array("relevance", False), 1, head))), False), 1, head)
    if long.isEmpty():
        joined = coded.withColumn("best", F.lit(None).cast("array<double>"))
    else:
        joined = coded.join(small_side(coded.where("pieces > 1").groupBy("list_id").agg(whole.alias("best")), "best-relevance"), "list_id", "left")
    own = F.slice(F.sort_array("relevance", False), 1, head)
    dcg = F.aggregate(
        F.sequence(F.lit(1), F.size("best")), F.lit(0.0), lambda acc, i: acc + (F.pow(F.lit(2.0), F.element_at("best", i)) - 1) / F.log2(i + 1.0)
    )
    joined = joined.withColumn("best", F.coalesce("best", own))
    return materialise(joined.withColumn("ideal", F.when(F.size("best") > 0, dcg).otherwise(0.0)).drop("best"), "list-pieces")


def _heads(pieces: DataFrame, head: int) -> DataFrame:
    """Head of every list in more than one piece, with the bin codes of its rows."""
    split = pieces.where("pieces > 1")
    item = pieces.schema["items"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            s = block.scores
            order, place = block.order(s)
            top = order[place < head]
            codes = pa.array([c.tobytes() for c in block.codes[top]], pa.binary())
            columns = [block.lists.take(pa.array(block.of[top])), pa.array(s[top]), block.items.take(pa.array(top)), pa.array(block.relevance[top]), codes, pa.array(block.draws[top])]
            yield pa.RecordBatch.from_arrays(columns, names=["list_id", "s", "item", "rel", "codes", "draw"])

    best = split.mapInArrow(run, f"list_id {pieces.schema['list_id'].dataType.simpleString()}, s double, item {item}, rel double, codes binary, draw bigint")
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("s"), "item"))).where(F.col("place") <= head)
    lists = ranked.groupBy("list_id").agg(F.sort_array(F.collect_list(F.struct("place", "s", "item", "rel", "codes", "draw"))).alias("r"))
    return lists.select("list_id", *[F.col(f"r.{c}").alias(f"head_{c}") for c in ("s", "item", "rel", "codes", "draw")])


def lambda_gradients(
    rows: DataFrame, score: str, list_id: str = "user_id", item_id: str = "item_id", relevance: str = "relevance", head: int = HEAD, piece: int = PIECE
) -> DataFrame:
    """(list_id, item_id, gradient, curvature) of given scores: how far and how surely each should move.

    For every pair of a list with unlike relevance of which the better placed row is among the
    first `head` (by score, then item): |swap| = |2^r - 2^r'| * |discount - discount'| / ideal DCG of the
    first `head`, where places behind the head have discount 0; the gradient of the more relevant row
    grows by |swap| / (1 + exp(s - s')), that of the other shrinks by it. A list without any relevant row gets zeros.
    """
    pieces = list_pieces(rows, [], None, list_id, item_id, relevance, head, piece, F.col(score))
    joined = pieces if pieces.where("pieces > 1").isEmpty() else pieces.join(small_side(_heads(pieces, head), "heads"), "list_id", "left")
    types = [pieces.schema["list_id"].dataType.simpleString(), pieces.schema["items"].dataType.elementType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            own, away, piece_of = block.gradients(block.scores, head)
            parts = [(block.of, block.items, own)]
            if len(piece_of):
                parts.append((piece_of, pa.array([i for b in block.heads.values() for i in b.item], block.items.type), away))
            for of, items, (g, h) in parts:
                yield pa.RecordBatch.from_arrays([block.lists.take(pa.array(of)), items, pa.array(g), pa.array(h)], names=["l", "i", "g", "h"])

    found = joined.mapInArrow(run, f"l {types[0]}, i {types[1]}, g double, h double")
    return found.groupBy(F.col("l").alias(list_id), F.col("i").alias(item_id)).agg(F.sum("g").alias("gradient"), F.sum("h").alias("curvature"))


# --- boosting -------------------------------------------------------------------------------


def hashed(draws: np.ndarray, seed: int) -> np.ndarray:
    """Evenly spread 64-bit words that follow from row numbers and a seed."""
    h = draws.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def _taken(draws: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Rows of a repeatable sample, by hashed row numbers."""
    return hashed(draws, seed) < np.uint64(int(share * 2**64) - 1)


def _alone(rdd: RDD) -> RDD:
    """The same RDD, its elements stored one by one: two such RDDs are zipped as they are."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _parts_of(pieces: DataFrame) -> RDD:
    """The blocks of each task; the blocks of all tasks are alike in size, whatever files the pieces lie in."""
    n_rows = pieces.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    tasks = tasks_for(n_rows, pieces.sparkSession.sparkContext.defaultParallelism)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    packed = pieces.repartition(tasks).mapInArrow(pack, "block binary").rdd
    return _alone(packed.mapPartitions(lambda rows: [Part([pickle.loads(r.block) for r in rows])])).persist(StorageLevel.MEMORY_AND_DISK)


def _told_heads(scored: RDD, head: int) -> RDD:
    """The parts (with the scores of their cells), each block told the head of every split list it has a piece of."""
    n = scored.getNumPartitions()

    def best(task: int, pairs):
        for part, scores in pairs:
            for block in part.blocks:
                s = scores[block.cell]
                order, place = block.order(s)
                for p in block.split:
                    rows = order[block.first[p] : block.first[p + 1]][:head]
                    items = block.items.take(pa.array(rows)).to_pylist()
                    codes = part.codes[block.cell[rows]]
                    yield block.lists[int(p)].as_py(), ({task}, [(-s[r], i, block.relevance[r], block.draws[r], c.tobytes()) for r, i, c in zip(rows, items, codes)])

    def tell(pair):
        (part, scores), heads = pair
        for block in part.blocks:
            for p in block.split.tolist():
                s, item, rel, draw, codes = zip(*heads[block.lists[p].as_py()])
                block.heads[p] = Head(-np.array(s), np.array(rel), np.array(draw), list(item), list(codes))
        return part, scores

    whole = scored.mapPartitionsWithIndex(best).reduceByKey(lambda x, y: (x[0] | y[0], sorted(x[1] + y[1], key=lambda r: r[:2])[:head]), n)
    sent = whole.flatMap(lambda kv: [(task, (kv[0], kv[1][1])) for task in kv[1][0]]).partitionBy(n, int)
    return scored.zip(sent.mapPartitions(lambda rows: [dict(v for _, v in rows)])).map(tell)


def _pulled(parts: RDD, sums: RDD | None, tree: Tree | None, head: int, split_lists: bool, seed: int) -> RDD:
    """A list of `Sums` per task: the scores of `sums` with `tree` added, and the gradients of these scores."""
    if sums is None:
        scored = parts.map(lambda part: (part, np.zeros(len(part.codes))))
    else:
        scored = parts.zip(sums).map(lambda pair: (pair[0], pair[1][0].scores + (tree.predict(pair[1][0].codes) if tree else 0)))
    told = _told_heads(scored, head) if split_lists else scored
    return _alone(told.map(lambda pair: [pair[0].pull(pair[1], head, seed)])).persist(StorageLevel.MEMORY_AND_DISK)


def histograms(pulled: RDD, tree: Tree, open_nodes: list[int], features: list[int], n_bins: int, seed: int = 0) -> np.ndarray:
    """Sums (gradient, curvature, rows) by open node, feature and bin; pulls without draws count whole."""
    shape = (len(open_nodes), len(features), n_bins, 3)
    lookup = np.full(len(tree.feature), -1)
    lookup[open_nodes] = np.arange(len(open_nodes))

    def run(parts):
        total = np.zeros(shape)
        for codes, draws, values in (pull for part in parts for block in part for pull in block.pulls):
            node = lookup[tree.leaf_of(codes)]
            keep = np.flatnonzero(node >= 0 if draws is None else _taken(draws, seed, ROW_SHARE) & (node >= 0))
            node, values = node[keep], values[:, keep]
            for k, f in enumerate(features):
                at = node * n_bins + codes[keep, f]
                for v, weights in enumerate(values):
                    total[:, k, :, v] += np.bincount(at, weights, shape[0] * n_bins).reshape(shape[0], n_bins)
        yield total

    cores = pulled.context.defaultParallelism
    if len(tree.feature) > 1 and pulled.getNumPartitions() > cores:
        # The first pass over a tree has made the sums; a task of a later one has little to do and reads those of several.
        pulled = pulled.coalesce(cores)
    depth = 1 if pulled.getNumPartitions() <= DIRECT_TASKS else 2
    return pulled.mapPartitions(run).treeReduce(np.add, depth)


def best_splits(
    sums: np.ndarray, least_rows: float = LEAST_ROWS, least_hessian: float = LEAST_HESSIAN, rate: float = RATE, allowed: np.ndarray | None = None
) -> list[tuple[float, int, int, tuple[float, float]] | None]:
    """Per node: gain, feature slot, bin and the values of both sides of its best split; None without one.

    `allowed` marks the features that a node may be split by (all if not given).
    """
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left

    def score(part):
        return part[..., 0] ** 2 / np.maximum(part[..., 1], 1e-12)

    gain = score(left) + score(right) - score(whole)
    fit = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (left[..., 1] >= least_hessian) & (right[..., 1] >= least_hessian)
    if allowed is not None:
        fit &= allowed[:, :, None]
    gain = np.where(fit, gain, -np.inf)
    out = []
    for node in range(len(sums)):
        f, b = np.unravel_index(gain[node].argmax(), gain[node].shape)
        best = float(gain[node, f, b])
        if best <= 1e-12:
            out.append(None)
            continue
        values = tuple(rate * float(p[node, f, b, 0] / p[node, f, b, 1]) for p in (left, right))
        out.append((best, int(f), int(b), values))
    return out


def fit_listwise(
    rows: DataFrame, features: list[str], list_id: str = "user_id", item_id: str = "item_id", relevance: str = "relevance",
    rounds: int = 100, leaves: int = LEAVES, head: int = HEAD, piece: int = PIECE, seed: int = 42,
) -> Forest:
    """Boosted trees for the order of each list; see `lambda_gradients` for what a row is pulled by.

    Each tree sees a share of the features; the sample of rows changes every few rounds. Without
    rows, or when no split is left that gains, the forest stays as it is.
    """
    cuts = cut_points(rows, features)
    pieces = list_pieces(rows, features, cuts, list_id, item_id, relevance, head, piece)
    n_bins = max((len(c) for c in cuts), default=0) + 1
    split_lists = not pieces.where("pieces > 1").isEmpty()
    rng = np.random.default_rng(seed)
    spark, forest = rows.sparkSession, Forest(features, cuts, [])
    parts, sums, stored, tree = _parts_of(pieces), None, None, None
    for number in range(rounds):
        draw = seed + number // ROW_SHARE_ROUNDS
        before, sums = sums, _pulled(parts, sums, tree, head, split_lists, draw)
        if number % STORE_ROUNDS == STORE_ROUNDS - 1 and number + 1 < rounds:
            checkpointed(spark, sums)
        chosen = sorted(rng.permutation(len(features))[: max(1, round(FEATURE_SHARE * len(features)))].tolist())
        grown, open_nodes, n_leaves = Tree(), [0], 1
        while open_nodes and n_leaves < leaves:
            found = histograms(sums, grown, open_nodes, chosen, n_bins, draw)
            splits = [(*s, node) for s, node in zip(best_splits(found), open_nodes) if s]
            open_nodes = []
            for gain, f, b, values, node in sorted(splits, reverse=True)[: leaves - n_leaves]:
                open_nodes += grown.split(node, chosen[f], b, gain, values)
                n_leaves += 1
        if before:
            before.unpersist()
        if sums.isCheckpointed():
            drop_checkpoint(spark, stored)
            stored = sums
        tree = grown if n_leaves > 1 else None
        if tree:
            forest.trees.append(tree)
        elif len(chosen) == len(features):
            break
    if sums:
        sums.unpersist()
    parts.unpersist()
    drop_checkpoint(spark, stored)
    return forest


class ListwiseRanker:
    """Unfitted listwise ranker; rows need user_id, item_id and label besides the features."""

    def __init__(self, features: list[str], seed: int = 42, rounds: int = 100):
        self.features, self.seed, self.rounds = features, seed, rounds

    def fit(self, rows: DataFrame) -> Forest:
        return fit_listwise(rows, self.features, relevance="label", rounds=self.rounds, seed=self.seed)
