"""Two-tower embeddings by stratified block descent.

Users and items are hashed into equally many blocks. In step s of an epoch, user block b meets item
block b + s: no two tasks of a step hold the same user or item, so each changes its vectors freely
and writes them back, and no task ever sees more than its own two blocks and their pairs. The loss is
logistic: observed pairs against sampled items of the same block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from brightshelf.session import discard, materialise, removing_shuffles

# Size of the vectors, epochs and pairs of a minibatch.
DIM, EPOCHS, BATCH = 64, 10, 512
RATE, DECAY, NEGATIVES = 0.1, 1e-3, 4
# A task holds about this many pairs and vectors at most; below that, cores are worth a block per so many pairs.
TASK_PAIRS, TASK_VECTORS, LEAST_PAIRS = 1_000_000, 100_000, 50_000


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Side:
    """Vectors of one side in a task, moved by steps that shrink with a row's past gradients."""

    def __init__(self, vectors: np.ndarray, past: np.ndarray, rate: float):
        self.vectors, self.past, self.rate = vectors, past, rate

    def move(self, rows: np.ndarray, gradients: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        at, g = rows[first], np.add.reduceat(gradients[order], first, axis=0)
        self.past[at] += (g * g).mean(axis=1)
        self.vectors[at] -= self.rate * g / np.sqrt(self.past[at] + 1e-8)[:, None]


def descend(users: Side, items: Side, u: np.ndarray, i: np.ndarray, weight: np.ndarray, rng: np.random.Generator, negatives: int, decay: float, batch: int) -> float:
    """One pass over the pairs (u, i) in random order; the summed loss, each minibatch before it moves."""
    lost, order = 0.0, rng.permutation(len(u))
    y = np.r_[1.0, np.zeros(negatives)]
    for at in range(0, len(order), batch):
        take = order[at : at + batch]
        a, w = u[take], weight[take, None]
        c = np.column_stack([i[take], rng.integers(0, len(items.vectors), (len(take), negatives))])
        p, q = users.vectors[a], items.vectors[c]
        z = np.einsum("pd,pkd->pk", p, q)
        lost += float((w * (np.logaddexp(0, z) - y * z)).sum())
        d = w * (_sigmoid(z) - y)
        users.move(a, np.einsum("pk,pkd->pd", d, q) + decay * (negatives + 1) * p)
        items.move(c.ravel(), (d[:, :, None] * p[:, None, :] + decay * q).reshape(-1, p.shape[1]))
    return lost


def _first_vectors(ids: DataFrame, name: str, blocks: int, dim: int, seed: int) -> DataFrame:
    """(id, block, vector, past): small random vectors that follow from the id and the seed."""
    draw = [((F.xxhash64(F.lit(seed + k), F.col(name)) / F.lit(2.0**63)) / F.lit(math.sqrt(dim))) for k in range(dim)]
    return ids.select(name).distinct().select(
        F.col(name).alias("id"), F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int").alias("block"), F.array(*draw).alias("vector"), F.lit(0.0).alias("past")
    )


def _solver(dim: int, blocks: int, step: int, seed: tuple, negatives: int, rate: float, decay: float, batch: int):
    """Function of one task: its users, items and pairs in, moved vectors and the loss out."""

    def solve(key, table):
        task = key[0].as_py()
        part = {kind: table.filter(pc.equal(table["kind"], kind)) for kind in ("user", "item", "pair")}
        ids, held = {}, {}
        for name in ("user", "item"):
            t = part[name].sort_by(f"{name}_id").combine_chunks()
            ids[name] = t[f"{name}_id"].combine_chunks()
            flat = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            held[name] = Side(flat.reshape(-1, dim).copy(), t["past"].to_numpy().copy(), rate)
        known = part["pair"].sort_by([("user_id", "ascending"), ("item_id", "ascending")])
        u, i = (pc.index_in(known[f"{name}_id"], value_set=ids[name]).to_numpy() for name in ("user", "item"))
        lost = 0.0
        if len(u):
            lost = descend(held["user"], held["item"], u, i, known["past"].to_numpy(), np.random.default_rng((*seed, step, task)), negatives, decay, batch)
        out = []
        for name, block in (("user", task), ("item", (task + step) % blocks)):
            size = len(ids[name])
            columns = {"user_id": pa.nulls(size, table.schema.field("user_id").type), "item_id": pa.nulls(size, table.schema.field("item_id").type), f"{name}_id": ids[name]}
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * dim, pa.int32()), pa.array(held[name].vectors.ravel()))
            out.append(pa.table({"kind": pa.array([name] * size, pa.string()), **columns, "block": pa.array([block] * size, pa.int32()), "vector": lists, "past": pa.array(held[name].past)}))
        none = {c: pa.nulls(1, out[0].schema.field(c).type) for c in ("user_id", "item_id", "block", "vector")}
        out.append(pa.table({"kind": ["loss"], **none, "past": [lost]}).select(out[0].column_names))
        return pa.concat_tables(out)

    return solve


def blocks_for(pairs: int, users: int, items: int, cores: int = 1) -> int:
    """Blocks per side so that a task's pairs and vectors stay within their bounds.

    A step has as many tasks as blocks, so there are blocks for all cores as soon as tasks have enough to do.
    """
    spread = min(cores, math.ceil(math.sqrt(pairs / LEAST_PAIRS)))
    return max(2, spread, math.ceil(math.sqrt(pairs / TASK_PAIRS)), math.ceil(max(users, items) / TASK_VECTORS))


def train_embeddings(
    strengths: DataFrame, dim: int = DIM, epochs: int = EPOCHS, negatives: int = NEGATIVES, rate: float = RATE, decay: float = DECAY,
    batch: int = BATCH, blocks: int | None = None, seed: int = 42,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """(user_id, vector), (item_id, vector) and the mean loss per pair of each epoch.

    `strengths` holds user_id, item_id and weight; ids may be of any type. Pairs with a null id or a weight
    that is null or not positive are left out, repeated pairs add up. Weights are scaled to a mean
    of 1. Negatives are drawn from the items of the task's block. Without pairs both tables are empty.
    """
    pairs = strengths.where("user_id is not null and item_id is not null and weight > 0").groupBy("user_id", "item_id").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    pairs = materialise(pairs, "pairs")
    n, mean, n_users, n_items = pairs.agg(F.count("*"), F.avg("weight"), F.count_distinct("user_id"), F.count_distinct("item_id")).first()
    blocks = blocks or blocks_for(n, n_users, n_items, pairs.sparkSession.sparkContext.defaultParallelism)
    sides = {name: materialise(_first_vectors(pairs, f"{name}_id", blocks, dim, seed + 1000 * k), f"{name}-vectors") for k, name in enumerate(("user", "item"))}
    of = lambda name: F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    placed = materialise(
        pairs.select("user_id", "item_id", (F.col("weight") / F.lit(mean or 1.0)).alias("weight"), of("user_id").alias("ub"), of("item_id").alias("ib")).repartition("ub", "ib"), "placed-pairs"
    )
    kinds = {name: pairs.schema[f"{name}_id"].dataType.simpleString() for name in ("user", "item")}
    schema = f"kind string, user_id {kinds['user']}, item_id {kinds['item']}, block int, vector array<double>, past double"
    losses: list[float] = []
    past = list(sides.values())
    rng = np.random.default_rng(seed)
    for epoch in range(epochs if n else 0):
        lost = 0.0
        for step in rng.permutation(blocks).tolist():
            task = {"user": F.col("block"), "item": F.pmod(F.col("block") - F.lit(step), F.lit(blocks))}
            rows = placed.where(F.pmod(F.col("ib") - F.col("ub"), F.lit(blocks)) == step).select(
                F.col("ub").alias("task"), F.lit("pair").alias("kind"), "user_id", "item_id", F.lit(None).cast("array<double>").alias("vector"), F.col("weight").alias("past")
            )
            for name in ("user", "item"):
                columns = [F.col("id") if name == k else F.lit(None).cast(kinds[k]) for k in ("user", "item")]
                rows = rows.unionByName(
                    sides[name].select(task[name].cast("int").alias("task"), F.lit(name).alias("kind"), columns[0].alias("user_id"), columns[1].alias("item_id"), "vector", "past")
                )
            solve = _solver(dim, blocks, step, (seed, epoch), negatives, rate, decay, batch)
            with removing_shuffles(rows.sparkSession):
                moved = materialise(rows.repartitionById(blocks, F.col("task")).groupBy("task").applyInArrow(solve, schema), "moved")
            for table in past:  # nothing reads the vectors before this step any more
                discard(table)
            past = [moved]
            lost += moved.where("kind = 'loss'").agg(F.sum("past")).first()[0] or 0.0
            sides = {name: moved.where(F.col("kind") == name).select(F.col(f"{name}_id").alias("id"), "block", "vector", "past") for name in ("user", "item")}
        losses.append(lost / n)
    return tuple(sides[name].select(F.col("id").alias(f"{name}_id"), "vector") for name in ("user", "item")) + (losses,)
