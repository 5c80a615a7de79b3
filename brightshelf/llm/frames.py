"""What the operators share: Arrow kernels over one text column, and hash filters of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

TEXT = "_text"
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(0))


def scan_text(df: DataFrame, keep: list[str], text: str, kernel: Callable, ddl: str) -> DataFrame:
    """Run `kernel(batch) -> dict of columns` on Arrow batches of whole texts.

    The kernel sees the `keep` columns and the UTF-8 bytes of the text (null stays null) and
    returns one value per row for each column of `ddl`. Other columns of `df` are not read, so
    their names cannot clash; a `keep` column named like an output is an error.
    """
    added = T._parse_datatype_string(ddl)
    clash = set(keep) & {f.name for f in added.fields}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are named like results; rename them first")
    source = df.select(*keep, F.col(text).cast("string").cast("binary").alias(TEXT))
    schema = T.StructType([*[source.schema[k] for k in keep], *added.fields])
    names = [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(added)
        for batch in batches:
            for part in bounded(batch):
                found = kernel(part)
                arrays = [pa.array(found[n], types.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *arrays], names=[*keep, *names])

    return source.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `size` bytes of text; one longer text stands alone."""
    offsets = text_buffer(batch)[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_buffer(batch: pa.RecordBatch, name: str = TEXT) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (one more entry than rows)."""
    column = batch.column(name).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


FILTER_BITS = 27


def hash_filter(df: DataFrame, value: Column) -> np.ndarray:
    """2**27 bits (16 MB, however many rows there are) with the bit of every 64-bit value set.

    Bits are merged by an aggregation, so at most 2**21 rows of 64 bits reach the driver. A value
    that was not put in passes with the share of set bits as its chance; callers join afterwards.
    """
    bit = value.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = (
        df.select(F.shiftright(bit, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
        .groupBy("at")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    words[rows["at"].to_numpy()] = rows["b"].to_numpy()
    return words.view(np.uint64)


def in_filter(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
