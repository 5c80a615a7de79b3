"""Vector top-k, pairwise similarity and item co-occurrence at catalogue scale.

Two physical ideas, both chosen so that no task holds a whole table and no shuffle
carries one row per compared pair:

* Blocks. Query vectors and item vectors are cut into blocks; each (query block,
  item block) cell is one matrix product in numpy, which hands on only k rows per
  query. The cells are spread by an ordinary shuffle.
* Partial products. Co-occurrence adds up item pairs inside the task that reads a
  user's history and hands on sums. Long histories are cut into chunks first, so a
  user with a third of all rows becomes many small rows; for top-k lists the longest
  histories are scored by the block grid and never paired out, and the other pairs are
  summed for one group of items after the other, so that only those of a group are
  ever on disk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from brightshelf.functions.vectors import dot
from brightshelf.operators.topk import top_k
from brightshelf.session import materialise, partitions_for, removing_shuffles

QUERY_BLOCK = 8_192
ITEM_BLOCK = 32_768
SCORE_CELLS = 1_000_000
MATRIX_CELLS = 24_000_000
# Vectors of whole rows that a task keeps while it goes through its items in lots; beyond, they pass by once per lot.
MATRIX_BYTES = 256_000_000
HISTORY_CHUNK = 1_024
HEAVY_USERS = 32
PAIR_BATCH = 2_000_000
# Pairs that are shuffled before the next group of items follows, and those that meet in a task; items of more users are spread.
GROUP_PAIRS, TASK_PAIRS, HOT_USERS = 100_000_000, 4_000_000, 50_000
# Where adding up equal pairs before the shuffle leaves more than this share of them, so many lots go without.
PAIRS_LEFT, LOTS_WITHOUT = 0.8, 15


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, math.ceil(df.count() / rows))


def _each(n: int) -> Column:
    """One output row per block number 0..n-1."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column without nulls -> (n, dim) float64 matrix; vectors of different lengths raise."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.unique(pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False))
    if array.null_count or len(sizes) > 1:
        raise ValueError(f"vectors need one common length and no null; found lengths {sizes.tolist()}, {array.null_count} null")
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def _kth_at_least(scores: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of the k-th largest score of each row, from the largest ones of groups of columns.

    Less a margin that covers scores which are equal after rounding to 9 digits.
    """
    rows, n = scores.shape
    if n <= k:
        return np.full((rows, 1), -np.inf)
    groups = min(n, max(4 * k, 64))
    largest = scores[:, : n // groups * groups].reshape(rows, -1, groups).max(axis=1)
    bound = np.partition(largest, groups - k, axis=1)[:, groups - k : groups - k + 1]
    return bound - 2e-9 - 1e-14 * np.abs(bound)


def _best_of(rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, k: int):
    """The k best of each row among given (row, column, score); ties go to the lower column."""
    order = np.lexsort((columns, -np.round(scores, 9), rows))
    rows, columns, scores = rows[order], columns[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], columns[keep], scores[keep]


def _best_in_block(queries: np.ndarray, items: np.ndarray, k: int, self_at: np.ndarray | None):
    """(row, column, score) of the k best items per query row; ties go to the lower column."""
    step = max(1, SCORE_CELLS // max(1, len(items)))
    # One array for the scores of all steps: a new one each time costs more than the product.
    columns, held = np.ascontiguousarray(items.T), np.empty((min(step, len(queries)), len(items)))
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        scores = np.matmul(part, columns, out=held[: len(part)])
        if self_at is not None:
            own = self_at[start : start + step]
            rows = np.nonzero(own >= 0)[0]
            scores[rows, own[rows]] = -np.inf
        if np.isnan(scores).any():
            scores[np.isnan(scores)] = -np.inf
        # In one dimension: over rows and columns `nonzero` takes longer than the product.
        r, c = np.divmod(np.flatnonzero(scores >= _kth_at_least(scores, k)), max(1, len(items)))
        real = scores[r, c] > -np.inf
        r, c = r[real], c[real]
        r, c, best = _best_of(r, c, scores[r, c], k)
        yield r + start, c, best


def _best_in_cells(queries: np.ndarray, items: np.ndarray, k: int, cells: pa.ChunkedArray, at: np.ndarray):
    """The same, where a query is compared with the items (`at`: their cells) of its own list of cells only."""
    lists = cells.combine_chunks()
    rows = np.repeat(np.arange(len(queries)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    asked = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(asked, kind="stable")
    asked, rows = asked[order], rows[order]
    held = np.unique(at)
    first, end = (np.searchsorted(asked, held, side) for side in ("left", "right"))
    if (end - first == len(queries)).all():
        yield from _best_in_block(queries, items[np.arange(len(at))], k, None)
        return
    by_cell = np.argsort(at, kind="stable")
    start, stop = (np.searchsorted(at[by_cell], held, side) for side in ("left", "right"))
    found, n = [], 0
    for x in range(len(held)):
        mine, there = rows[first[x] : end[x]], by_cell[start[x] : stop[x]]
        for r, c, s in _best_in_block(queries[mine], items[there], k, None):
            found.append((mine[r], there[c], s))
            n += len(r)
            if n > max(SCORE_CELLS, 2 * k * len(queries)):
                found = [_best_of(*(np.concatenate(p) for p in zip(*found)), k)]
                n = len(found[0][0])
    if found:
        yield _best_of(*(np.concatenate(p) for p in zip(*found)), k)


def top_k_similar(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_id: str,
    item_id: str = "item_id",
    vector: str = "vector",
    exclude_self: bool = False,
    metric: str = "cosine",
    item_vector: str | None = None,
    query_block: int = QUERY_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """Exact k best items per query vector: (query_id, item_id, score, rank).

    Each cell of the block grid reads one block of each side and returns k rows per
    query, so the last ranking sees (queries x item blocks x k) rows, not all pairs.
    `metric` is "cosine" (a vector without length scores 0.0) or "dot".
    """
    one = F.lit(0).cast("bigint")
    left = queries.select(F.col(query_id).alias("_q"), F.col(vector).alias("_v"), one.alias("_cell"))
    right = items.select(F.col(item_id).alias("_i"), F.col(item_vector or vector).alias("_v"), one.alias("_cell"))
    nq, ni = _blocks(queries, query_block), _blocks(items, item_block)
    return _top_k_in_cells(
        left.withColumn("_nq", F.lit(nq)).withColumn("_ni", F.lit(ni)),
        right.withColumn("_nq", F.lit(nq)).withColumn("_ni", F.lit(ni)),
        k, query_id, item_id, exclude_self, metric,
    )


def _top_k_in_cells(
    left: DataFrame, right: DataFrame, k: int, query_id: str, item_id: str, exclude_self: bool, metric: str
) -> DataFrame:
    """k best items per query among the items of the query's cells.

    left (_q, _v, _cell, _nq, _ni) and right (_i, _v, _cell, _nq, _ni): a cell is cut into
    _nq query blocks and _ni item blocks, so a hot cell becomes many groups of bounded size.
    Where left has _cells (a list) and right _at, a query meets the items whose _at is in its list
    only. Rows whose vector is null take no part.
    """
    left, right = left.where("_v is not null"), right.where("_v is not null")
    lists, at = (["_cells"], ["_at"]) if "_cells" in left.columns else ([], [])
    out_item = f"similar_{item_id}" if query_id == item_id else item_id
    left = left.select(
        "_q", "_v", *lists, "_cell", F.pmod(F.xxhash64("_q"), "_nq").alias("_qb"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ni").cast("bigint") - 1)).alias("_ib"),
    )
    right = right.select(
        "_i", "_v", *at, "_cell", F.pmod(F.xxhash64("_i"), "_ni").alias("_ib"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nq").cast("bigint") - 1)).alias("_qb"),
    )
    schema = T.StructType(
        [
            T.StructField(query_id, left.schema["_q"].dataType),
            T.StructField(out_item, right.schema["_i"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def cell(q: pa.Table, i: pa.Table) -> pa.Table:
        q_type, i_type = q.schema.field("_q").type, i.schema.field("_i").type
        empty = pa.table(
            {query_id: pa.array([], q_type), out_item: pa.array([], i_type), "score": pa.array([], pa.float64())}
        )
        if q.num_rows == 0 or i.num_rows == 0:
            return empty
        i = i.sort_by("_i")
        q_ids, i_ids = _ids(q.column("_q")), _ids(i.column("_i"))
        qm, im = _matrix(q.column("_v")), _matrix(i.column("_v"))
        if metric == "cosine":
            qm, im = _unit(qm), _unit(im)
        self_at = None
        if exclude_self:
            own = np.minimum(np.searchsorted(i_ids, q_ids), len(i_ids) - 1)
            self_at = np.where(i_ids[own] == q_ids, own, -1)
        if lists:
            parts = list(_best_in_cells(qm, im, k, q.column("_cells"), i.column("_at").to_numpy()))
        else:
            parts = list(_best_in_block(qm, im, k, self_at))
        if not parts:
            return empty
        rows = np.concatenate([p[0] for p in parts])
        cols = np.concatenate([p[1] for p in parts])
        return pa.table(
            {
                query_id: pa.array(q_ids[rows], q_type),
                out_item: pa.array(i_ids[cols], i_type),
                "score": pa.array(np.concatenate([p[2] for p in parts]), pa.float64()),
            }
        )

    keys = ["_cell", "_qb", "_ib"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)
    return top_k(best, k, [query_id], ties=(out_item,))


def similarity_matrix(
    items: DataFrame, item_id: str = "item_id", vector: str = "vector", block: int | None = 1_024, rows: int | None = None
) -> DataFrame:
    """The full pairwise cosine matrix in row blocks: (item_id, block, ids, similarities).

    A row holds the similarities of one item to the items of one column block, in id
    order. The matrix has n x n entries by nature; no entry is a row of its own, none is
    shuffled and no row is longer than a block. With `block` None a row is the whole row of an item
    id; rows that repeat an id are then one, in order of id and similarity. Items whose
    vector is null take no part.

    The scores of about `rows` items lie in a task's memory at a time, while all items pass
    by in id order. What is shuffled is a copy of the vectors per task if a task can keep them (whole rows of up
    to MATRIX_BYTES of vectors), else one per such lot of rows.
    """
    items = items.where(F.col(vector).isNotNull())
    n, dim = items.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    rows = rows or max(1, MATRIX_CELLS // max(1, n))
    tasks = 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = block is None and 8 * n * dim <= MATRIX_BYTES
    if kept:
        tasks = min(tasks, 4 * items.sparkSession.sparkContext.defaultParallelism)
    groups = max(1, 0 if kept else math.ceil(n / rows), min(tasks, math.ceil(n / 64)))
    one = [F.col(item_id).alias("_i"), F.col(vector).alias("_v")]
    # Equal ids are in one group, so that their rows can become one.
    left = items.select(F.pmod(F.xxhash64(item_id), F.lit(groups)).alias("_g"), F.lit(0).alias("_column"), *one)
    right = items.select(_each(groups).alias("_g"), F.lit(1).alias("_column"), *one)
    dealt = left.unionByName(right).repartition(min(groups, 2_000), "_g").sortWithinPartitions("_g", "_column", "_i")
    id_type = items.schema[item_id].dataType
    schema = T.StructType(
        [
            T.StructField(item_id, id_type),
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("similarities", T.ArrayType(T.DoubleType())),
        ]
    )

    def rows_of(ids: pa.Array, number: int, columns: pa.Array, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        if block is None:
            yield from whole_rows(ids, columns, scores)
            return
        size = len(columns)
        step = max(1, SCORE_CELLS // max(1, size))
        for at in range(0, len(ids), step):
            part = ids.slice(at, step)
            yield _listed(part, number, [columns] * len(part), scores[at : at + step].ravel())

    def whole_rows(ids: pa.Array, columns: pa.Array, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Both sides are sorted by id: equal ids stand together.
        first, rank = _runs(ids), np.repeat(np.arange(len(f := _runs(columns))), np.diff(np.r_[f, len(columns)]))
        repeated = len(f) < len(columns)
        pending, lists, values, held = [], [], [], 0
        for a, b in zip(first, [*first[1:], len(ids)]):
            row, names = scores[a:b].ravel(), columns
            if repeated:
                order = np.lexsort((row, np.tile(rank, b - a)))
                row, names = row[order], columns.take(pa.array(order % len(columns)))
            pending.append(a), lists.append(names), values.append(row)
            held += len(row)
            if held >= SCORE_CELLS:
                yield _listed(ids.take(pa.array(pending)), 0, lists, np.concatenate(values))
                pending, lists, values, held = [], [], [], 0
        if pending:
            yield _listed(ids.take(pa.array(pending)), 0, lists, np.concatenate(values))

    def lots(ids: pa.Array) -> Iterator[tuple[int, int]]:
        """About `rows` rows at a time; equal ids stay together."""
        first, at = [*_runs(ids), len(ids)], 0
        for one, after in zip(first, first[1:]):
            if after - at > rows and one > at:
                yield at, one
                at = one
        yield at, len(ids)

    def _listed(ids, number, lists, values):
        offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in lists])], pa.int32())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.full(len(ids), number)), pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists)), pa.ListArray.from_arrays(offsets, pa.array(values))],
            names=[item_id, "block", "ids", "similarities"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, units, number = None, [], [], 0
        names, scores, held = [], None, 0  # columns met so far of the block, and their scores
        width, passed = block or n, []  # vectors of all columns, if they are kept

        def emitted():
            nonlocal names, scores, held, number, passed
            if passed and len(ids):
                columns = pa.concat_arrays([x.column("_i") for x in passed])
                for a, b in lots(ids):
                    scores = np.concatenate([units[a:b] @ _unit(_matrix(x.column("_v"))).T for x in passed], axis=1)
                    yield from rows_of(ids.slice(a, b - a), 0, columns, scores)
                passed = []
            elif held and len(ids):
                yield from rows_of(ids, number, pa.concat_arrays(names), scores[:, :held])
            names, held, number = [], 0, number + 1

        for batch in batches:
            keys, kind = batch.column("_g").to_numpy(), batch.column("_column").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kind[1:] != kind[:-1])]) if len(keys) else []
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[a] != group:
                    yield from emitted()
                    group, ids, units, number, scores, passed = keys[a], [], [], 0, None, []
                part = batch.slice(a, b - a)
                if kind[a] and kept and scores is not None:
                    passed.append(part)
                    continue
                found = _unit(_matrix(part.column("_v")))
                if kind[a] == 0:
                    ids.append(part.column("_i")), units.append(found)
                    continue
                if scores is None:
                    ids = pa.concat_arrays(ids) if ids else pa.array([], part.column("_i").type)
                    units = np.concatenate(units) if units else np.zeros((0, found.shape[1]))
                    scores = np.empty((0 if kept else len(ids), width))
                    if kept:
                        passed = [part]
                        continue
                at = 0
                while at < len(found):
                    to = min(len(found), at + width - held)
                    scores[:, held : held + to - at] = units @ found[at:to].T
                    names.append(part.column("_i").slice(at, to - at))
                    held, at = held + to - at, to
                    if held == width and block:
                        yield from emitted()
        yield from emitted()

    return dealt.mapInArrow(run, schema)


def _runs(ids: pa.Array) -> list[int]:
    """Where a new value begins in sorted ids; nulls count as one value."""
    codes = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist() if len(codes) else []


def similar_items(items: DataFrame, k: int, item_id: str = "item_id", vector: str = "vector", wanted: DataFrame | None = None) -> DataFrame:
    """k most similar other items per item by cosine: (item_id, similar_item_id, similarity, rank).

    With `wanted` only for the items of that table; they are still compared with all.
    """
    asked = items if wanted is None else items.join(wanted, item_id, "left_semi")
    return top_k_similar(asked, items, k, item_id, item_id, vector, exclude_self=True).withColumnRenamed(
        "score", "similarity"
    )


def symmetric(pairs: DataFrame) -> DataFrame:
    """(item_id_1, item_id_2, similarity) listed from both sides; duplicates stay."""
    one, other, value = F.col("item_id_1"), F.col("item_id_2"), F.col("similarity")

    def side(a: Column, c: Column) -> Column:
        return F.struct(a.alias("item_id"), c.alias("similar_item_id"), value.alias("similarity"))

    # One pass over the pairs: a union would compute them once per side.
    return pairs.select(F.inline(F.array(side(one, other), side(other, one))))


def _pair_sums(items: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Sum of weight products per unordered item pair, for index pairs into flat arrays."""
    ids, codes = np.unique(items, return_inverse=True)
    a, b = codes[left], codes[right]
    low, high = np.minimum(a, b), np.maximum(a, b)
    key, at = np.unique(low * np.int64(len(ids)) + high, return_inverse=True)
    sums = np.bincount(at, weights=weights[left] * weights[right], minlength=len(key))
    return ids[key // len(ids)], ids[key % len(ids)], sums


def _pair_indexes(counts_after: np.ndarray, first_partner: np.ndarray):
    """Index pairs (element, partner): each element meets a run of partners starting at first_partner."""
    left = np.repeat(np.arange(len(counts_after)), counts_after)
    run_start = np.repeat(np.cumsum(counts_after) - counts_after, counts_after)
    right = np.repeat(first_partner, counts_after) + np.arange(len(left)) - run_start
    return left, right


def _sum_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair sums of every row's (items, weights) and, where given, (items2, weights2)."""
    for batch in batches:
        a, a2 = batch.column("items"), batch.column("items2")
        items_a, items_b = a.flatten().to_numpy(), a2.flatten().to_numpy()
        w_a = batch.column("weights").flatten().to_numpy()
        w_b = batch.column("weights2").flatten().to_numpy()
        len_a = np.asarray(a.value_lengths(), dtype=np.int64)
        len_b = np.asarray(a2.value_lengths(), dtype=np.int64)
        start_a = np.cumsum(len_a) - len_a
        start_b = np.cumsum(len_b) - len_b
        row = np.repeat(np.arange(len(len_a)), len_a)
        cross = len_b[row] > 0
        position = np.arange(len(items_a)) - start_a[row]
        # A row with a second chunk pairs across the chunks, any other row within itself.
        counts = np.where(cross, len_b[row], len_a[row] - position - 1)
        flat_items = np.concatenate([items_a, items_b])
        flat_weights = np.concatenate([w_a, w_b])
        partner = np.where(cross, len(items_a) + start_b[row], np.arange(len(items_a)) + 1)
        cut = np.searchsorted(np.cumsum(counts), np.arange(PAIR_BATCH, counts.sum() + PAIR_BATCH, PAIR_BATCH))
        begin = 0
        for end in [*(int(c) + 1 for c in cut), len(counts)]:
            end = min(end, len(counts))
            if end <= begin:
                continue
            left, right = _pair_indexes(counts[begin:end], partner[begin:end])
            if len(left):
                i, j, s = _pair_sums(flat_items, flat_weights, left + begin, right)
                yield pa.RecordBatch.from_pydict({"item_id_1": i, "item_id_2": j, "similarity": s})
            begin = end


def _unit_strengths(strengths: DataFrame, user: str, item: str, weight: str) -> DataFrame:
    """(_u, _i, _w): weights divided by the length of their item column."""
    norms = strengths.groupBy(item).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("_norm"))
    return strengths.join(norms, item).select(
        F.col(user).alias("_u"), F.col(item).alias("_i"), (F.col(weight) / F.col("_norm")).alias("_w")
    )


def _pair_rows(unit: DataFrame, chunk: int) -> DataFrame:
    """(items, weights, items2, weights2): histories, and every two chunks of a long one."""
    sizes = unit.groupBy("_u").agg(F.ceil(F.count("*") / F.lit(chunk / 2)).alias("_n"))
    sizes = sizes.withColumn("_n", F.when(F.col("_n") <= 2, F.lit(1)).otherwise(F.col("_n")))
    chunked = unit.join(sizes, "_u").withColumn("_c", F.pmod(F.xxhash64("_i"), F.col("_n")))
    packed = chunked.groupBy("_u", "_c", "_n").agg(F.collect_list(F.struct("_i", "_w")).alias("_h"))
    packed = materialise(packed, "histories")
    nothing = F.array().cast("array<struct<_i:bigint,_w:double>>")
    rows = packed.select("_h", nothing.alias("_h2"))
    long = packed.where("_n > 1")
    if not long.isEmpty():
        later = long.select(
            "_u", F.col("_c").alias("_c2"), F.col("_h").alias("_h2"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_c"))).alias("_c"),
        ).where("_c < _c2")
        across = long.select("_u", "_c", "_h").join(later, ["_u", "_c"]).select("_h", "_h2")
        rows = rows.unionByName(across)
    return rows.select(
        F.col("_h._i").alias("items"), F.col("_h._w").alias("weights"),
        F.col("_h2._i").alias("items2"), F.col("_h2._w").alias("weights2"),
    )


def _pair_products(unit: DataFrame, chunk: int) -> DataFrame:
    """(item_id_1 < item_id_2, similarity): weight products summed over users."""
    partial = _pair_rows(unit, chunk).mapInArrow(_sum_within, "item_id_1 bigint, item_id_2 bigint, similarity double")
    return partial.groupBy("item_id_1", "item_id_2").agg(F.sum("similarity").alias("similarity"))


def _spread(ids: np.ndarray) -> np.ndarray:
    """Evenly spread non-negative numbers that follow from 64-bit ids."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(24)).astype(np.int64)


def _pair_order(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Order of pairs by item, then partner: one sort of whole numbers where both ids fit into one."""
    if not len(one):
        return np.zeros(0, np.int64)
    low, span = int(other.min()), int(other.max()) - int(other.min()) + 1
    if (int(one.max()) - int(one.min()) + 1) * span >= 2**63:
        return np.lexsort((other, one))
    return np.argsort((one - one.min()) * span + (other - low))


def _summed_pairs(one: np.ndarray, other: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different pairs in order of item and partner, their sums, and where each comes from."""
    order = _pair_order(one, other)
    one, other = one[order], other[order]
    new = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (other[1:] != other[:-1])][: len(one)])
    return one[new], other[new], np.add.reduceat(value[order], new) if len(new) else value[:0], order[new]


def _group_sums(batches: Iterator[pa.RecordBatch], group: int, groups: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of all pairs (item of the group, partner), each row's part; one row per bucket of items.

    The partners of a hot item are spread over all buckets, any other item is in one. Equal pairs are added
    up here as long as that makes them fewer.
    """
    without = 0  # lots to come that are not added up here
    for batch in batches:
        a, a2 = batch.column("items"), batch.column("items2")
        n_a, n_b = (np.asarray(x.value_lengths(), dtype=np.int64) for x in (a, a2))
        flat = np.concatenate([a.flatten().to_numpy(), a2.flatten().to_numpy()])
        weights = np.concatenate([batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("weights", "weights2")])
        start_a, start_b = np.cumsum(n_a) - n_a, n_a.sum() + np.cumsum(n_b) - n_b
        row_a, row_b = (np.repeat(np.arange(len(n)), n) for n in (n_a, n_b))
        # An item of a row with two chunks meets the other chunk, any other one its own row.
        two = n_b > 0
        first = np.r_[np.where(two, start_b, start_a)[row_a], start_a[row_b]]
        many = np.r_[np.where(two, n_b, n_a)[row_a], n_a[row_b]]
        draw = _spread(flat)
        mine = np.flatnonzero(draw % groups == group)
        bucket, is_hot = draw[mine] // groups % buckets, np.isin(flat[mine], hot)
        ends = np.r_[0, np.cumsum(many[mine])]
        begin = 0
        while begin < len(mine):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + PAIR_BATCH // 2, "right")) - 1)
            of = slice(begin, end)
            left, right = _pair_indexes(many[mine[of]], first[mine[of]])
            begin = end
            keep = np.flatnonzero(mine[of][left] != right)
            left, right = left[keep], right[keep]
            if not len(left):
                continue
            source = mine[of][left]
            one, other, sums = flat[source], flat[right], weights[source] * weights[right]
            at = np.where(is_hot[of][left], (bucket[of][left] + draw[right]) % buckets, bucket[of][left])
            if without:
                without -= 1
            else:
                n = len(one)
                one, other, sums, kept = _summed_pairs(one, other, sums)
                at = at[kept]
                without = LOTS_WITHOUT if len(one) > PAIRS_LEFT * n else 0
            order = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")
            at, one, other, sums = at[order], one[order], other[order], sums[order]
            cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            parts = [[v[x:y].tobytes() for x, y in zip(cut, [*cut[1:], len(at)])] for v in (one, other, sums)]
            yield pa.RecordBatch.from_arrays([pa.array(at[cut], pa.int64()), *[pa.array(p, pa.binary()) for p in parts]], names=["bucket", "one", "other", "sums"])


def _best_pairs(one: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each item are, best first, among pairs in order of item and partner; ties stay in that order."""
    score = np.nan_to_num(np.rint(value * 1e9), nan=np.inf)
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]][: len(one)])
    sizes = np.diff(np.r_[first, len(one)])
    if not len(one):
        return first
    top, rows = score.max(), np.arange(len(one))
    span = float(top) - float(score.min()) + 1
    if span * len(first) < 2**53:
        # The k-th best score of each item; what is below it need not be ranked.
        item = np.repeat(np.arange(len(first)), sizes)
        key = item * int(span) + (top - score).astype(np.int64)
        rows = np.flatnonzero(key <= np.sort(key)[first + np.minimum(sizes, k) - 1][item])
    order = rows[np.lexsort((-score[rows], one[rows]))]
    of = one[order]
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    place = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
    return order[place < k]


def _bucket_sums(batches: Iterator[pa.RecordBatch], k: int | None) -> Iterator[pa.RecordBatch]:
    """(item_id, similar_item_id, similarity): the sums of rows that come ordered by bucket; the k best per item, or all.

    Rows are added up as they come, so memory holds the different pairs of one bucket.
    """
    held, waiting, bucket = [], 0, None

    def summed():
        return _summed_pairs(*(np.concatenate(x) for x in zip(*held)))[:3]

    def result():
        one, other, value = summed()
        if k is not None:
            best = _best_pairs(one, value, k)
            one, other, value = one[best], other[best], value[best]
        for at in range(0, len(one), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 100_000]) for v in (one, other, value)], names=["item_id", "similar_item_id", "similarity"])

    for batch in batches:
        columns = [batch.column(c) for c in ("one", "other", "sums")]
        for i, b in enumerate(batch.column("bucket").to_pylist()):
            if held and b != bucket:
                yield from result()
                held, waiting = [], 0
            bucket = b
            held.append(tuple(np.frombuffer(c[i].as_buffer(), kind).copy() for c, kind in zip(columns, (np.int64, np.int64, np.float64))))
            waiting += len(held[-1][0])
            if waiting > max(PAIR_BATCH, len(held[0][0])):
                held, waiting = [summed()], 0
    if held:
        yield from result()


def _by_groups(unit: DataFrame, chunk: int, k: int | None, finish) -> DataFrame:
    """`finish` of (item_id, similar_item_id, similarity), from both sides, for one group of items after the other.

    Pairs are shuffled as bytes, at most about GROUP_PAIRS of them before their result is written and the
    shuffle is removed; with `k` only the k best of an item in a bucket become rows.
    """
    spark = unit.sparkSession
    counts = unit.groupBy("_u").agg(F.count("*").alias("_n"))
    pairs = counts.agg(F.coalesce(F.sum(F.col("_n") * (F.col("_n") - 1)), F.lit(0))).first()[0]
    groups = max(1, math.ceil(pairs / GROUP_PAIRS))
    tasks = partitions_for(spark, pairs // groups, TASK_PAIRS)
    users = unit.groupBy("_i").agg(F.count("*").alias("_n"))
    hot = np.array([r["_i"] for r in users.where(F.col("_n") > max(HOT_USERS, pairs // 1_000_000)).select("_i").collect()], np.int64)
    rows, parts = _pair_rows(unit, chunk), []
    for group in range(groups):
        partial = rows.mapInArrow(
            lambda batches, group=group: _group_sums(batches, group, groups, 8 * tasks, hot), "bucket bigint, one binary, other binary, sums binary"
        )
        dealt = partial.repartition(tasks, "bucket").sortWithinPartitions("bucket")
        sums = dealt.mapInArrow(lambda batches: _bucket_sums(batches, k), "item_id bigint, similar_item_id bigint, similarity double")
        with removing_shuffles(spark):
            parts.append(materialise(finish(sums), "similar-items"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cooccurrence(
    strengths: DataFrame, user: str = "user_id", item: str = "item_id", weight: str = "weight",
    chunk: int = HISTORY_CHUNK,
) -> DataFrame:
    """Cosine similarity of items over their user columns: (item_id_1 < item_id_2, similarity).

    Expects one row per (user, item) with an integer item id. Only pairs that share a
    user are listed; all others have similarity 0. Exact for any history length: a
    history longer than `chunk` is cut into chunks that are paired with each other. The
    result itself has a row per pair that shares a user; where only the best partners are
    wanted, `similar_by_users` avoids the rows a very long history would add.
    """
    strengths = materialise(strengths.select(user, item, weight), "strengths")
    return _pair_products(_unit_strengths(strengths, user, item, weight), chunk)


def similar_by_users(
    strengths: DataFrame, k: int, user: str = "user_id", item: str = "item_id", weight: str = "weight",
    chunk: int = HISTORY_CHUNK, heavy_users: int = HEAVY_USERS,
) -> DataFrame:
    """k most similar items per item by cosine over user columns, exact for any skew.

    A user who has touched most of the catalogue makes every pair of items similar. Such
    users (at most `heavy_users`, each with more than `chunk` items) are not paired out:
    they become a short dense vector per item, whose inner product is their part of the
    similarity. The best partners of an item are then among the pairs of the other users,
    with the dense part added, and the k best by the dense part alone: any item left out
    has no other part and k items at least as good.
    """
    strengths = materialise(strengths.select(user, item, weight), "strengths")
    unit = _unit_strengths(strengths, user, item, weight)
    long = strengths.groupBy(user).agg(F.count("*").alias("_n")).where(F.col("_n") > chunk)
    heavy = [r[user] for r in long.orderBy(F.desc("_n"), user).limit(heavy_users).collect()]
    if not heavy:
        return top_k(_by_groups(unit, chunk, k, lambda sums: sums), k, ["item_id"], "similarity", ("similar_item_id",))
    is_heavy = F.col("_u").isin(heavy)
    dense = unit.where(is_heavy).groupBy(F.col("_i").alias("item_id")).agg(
        F.array(*[F.sum(F.when(F.col("_u") == u, F.col("_w")).otherwise(0.0)) for u in heavy]).alias("vector")
    )
    dense = materialise(dense, "heavy-users")
    partner = dense.select(F.col("item_id").alias("similar_item_id"), F.col("vector").alias("_other"))
    shared = F.when(
        F.col("vector").isNotNull() & F.col("_other").isNotNull(), dot(F.col("vector"), F.col("_other"))
    ).otherwise(0.0)

    def best_of(light: DataFrame) -> DataFrame:
        whole = light.join(dense, "item_id", "left").join(partner, "similar_item_id", "left").select(
            "item_id", "similar_item_id", (F.col("similarity") + shared).alias("similarity")
        )
        return top_k(whole, k, ["item_id"], "similarity", ("similar_item_id",)).drop("rank")

    alone = top_k_similar(dense, dense, k, "item_id", exclude_self=True, metric="dot").where("score > 0").select(
        "item_id", "similar_item_id", F.col("score").alias("similarity")
    )
    best = _by_groups(unit.where(~is_heavy), chunk, None, best_of).unionByName(alone)
    merged = best.groupBy("item_id", "similar_item_id").agg(F.max("similarity").alias("similarity"))
    return top_k(merged, k, ["item_id"], "similarity", ("similar_item_id",))


def similar_from_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """k most similar items per item from given pairs, looked up from both sides."""
    return top_k(symmetric(pairs), k, ["item_id"], "similarity", ("similar_item_id",))


def lookup_vectors(ids: DataFrame, vectors: DataFrame, key: str, zero: Column) -> DataFrame:
    """Vector per id; an unknown id gets the zero vector."""
    return ids.join(vectors, key, "left").withColumn("vector", F.coalesce("vector", zero))


def index_of_id(ids: DataFrame, column: str, prefix: str, n: int) -> DataFrame:
    """Index of ids like 'user_123': the number clamped to [0, n-1]; other ids by hash."""
    text = F.col(column).cast("string")
    number = F.regexp_extract(text, f"^{prefix}_(-?[0-9]+)(_|$)", 1)
    index = F.when(number != "", number.try_cast("bigint")).otherwise(
        F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")).otherwise(
            F.pmod(F.xxhash64(text), F.lit(n))
        )
    )
    return ids.withColumn("index", F.greatest(F.lit(0), F.least(index, F.lit(n - 1))).cast("bigint"))
