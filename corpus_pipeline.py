"""The corpus pipeline: five stages over `documents`, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightshelf.llm import boilerplate, decontaminate, packing, secrets, sketches
from brightshelf.llm.frames import table
from brightshelf.session import configure, materialise


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number per row, and the name of that column, which no column of `docs` has.

    Numbers follow from the files of the table a stage reads, so scanning it twice numbers it alike.
    """
    name = next(n for n in (f"row_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def _plain(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with columns named column_0, column_1, ..., so that no name can clash, and that of the text."""
    plain = docs.toDF(*[f"column_{i}" for i in range(len(docs.columns))])
    return plain, plain.columns[docs.columns.index("text")]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labelling keeps.

    Null and empty texts go (they fail the base rules); rows that repeat are judged alike; an empty table stays
    empty; columns of any other name are carried along.
    """
    chain = boilerplate.train(docs, table(spark, sf_dir, "labels"))
    plain, text = _plain(docs)
    judged = boilerplate.judge(plain.select("*", F.col(text).alias("judged_text")), plain.columns, chain, "judged_text")
    return judged.where("kept").select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word shingles, similarity 0.8): that with the smallest id.

    Rows are compared by number, whatever their ids: of rows that repeat one stays, an id that stands
    on different texts keeps them all, rows without an id stand behind those with one. Null and empty
    texts are no copies of anything and stay.
    """
    rows, number = _numbered(docs)
    found = sketches.near_duplicates(rows.select(number, "text"), number).select(F.col(number).alias("n"), "component_id")
    ids = rows.select(F.col(number).alias("m"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))
    kept = found.join(ids, F.col("n") == F.col("m")).groupBy("component_id").agg(first.alias("first")).select(F.col("first.n").alias(number))
    return rows.join(materialise(kept, "kept"), number, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Rows are judged by number, so a row without an id or with that of another row goes only for its own text.
    Null and empty texts stay; without items all rows stay.
    """
    rows, number = _numbered(docs)
    found = decontaminate.find_overlaps(rows.select(number, "text"), table(spark, sf_dir, "benchmark"), number).select(number).distinct()
    return rows.join(materialise(found, "contaminated"), number, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the name of their kind.

    Null and empty texts stay as they are; columns of any other name are carried along.
    """
    plain, text = _plain(docs)
    clean = secrets.redact_secrets(plain, text).toDF(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document's sequences."""
    return packing.pack(packing.token_lengths(docs, ["doc_id"]))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack_batches),
]

# The line labels come from a fitted chain, which SQL cannot state; tests compare stage by stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table."""
    spark = configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
