"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brightshelf.llm import archives, boilerplate, brown, decontaminate, edits, languages, licenses, packing, periods, secrets, sketches, templates, whitening
from brightshelf.llm.frames import crc_remainder, table
from brightshelf.session import configure, materialise

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        LLM_QUERIES[name] = run
        if sql is not None:
            LLM_ORACLES[name] = sql
        return run

    return register


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence detections of every document, summed up per document."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("detections", lambda d: d["base"])
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.col("base.word")).alias("first_word"),
        F.array_max(F.col("base.word")).alias("last_word"),
        _joined(F.col("base.label")).alias("base_labels"),
        _joined(F.col("detections.label")).alias("labels"),
        F.coalesce(F.array_max(F.col("detections.score")), F.lit(0.0)).alias("score"),
    )


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; base kinds counted and digested."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    base = [r.kind for r in secrets.BASE]

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}") for kind in base],
        F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; the chain is fitted on labelled documents."""
    documents = table(spark, sf_dir, "documents")
    return boilerplate.judge(documents, ["doc_id"], boilerplate.train(documents, table(spark, sf_dir, "labels")))


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that overlaps a benchmark item, with the items."""
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "share")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document's sequences."""
    return packing.pack(packing.token_lengths(table(spark, sf_dir, "documents"), ["doc_id"]))


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over 2-word shingles at similarity 0.8."""
    return sketches.near_duplicates(table(spark, sf_dir, "documents"), size=2)


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a third of them is held out of learning."""
    documents = table(spark, sf_dir, "documents")
    held = crc_remainder("doc_id", 3) == 1
    prototypes = languages.learn_prototypes(documents.where(~held))
    found = languages.identify(documents, ["doc_id"], prototypes)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


OP2_SQL = """
with p as (select page_id, sha1(coalesce(html, '')) as d, strlen(coalesce(html, '')) as b from pages),
f as (select d, max(page_id) as first from p where b >= 1000 group by d)
select page_id, b as payload_bytes, d as payload_digest,
  case when first is not null and first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f using (d)
"""


@query("op2_warc", OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written to archives and read back by chunks."""
    chunks = archives.read_chunks(archives.write_archives(archives.plan_records(table(spark, sf_dir, "pages"))))
    response = F.col("record_type") == "response"
    size = F.when(response, F.col("chunk_no").cast("bigint") * archives.CHUNK + F.length("data")).otherwise(F.col("payload_length"))
    return chunks.where("last").select(
        "page_id", size.alias("payload_bytes"), F.when(response, F.col("digest")).otherwise(F.col("header_digest")).alias("payload_digest"), "record_type", "refers_to"
    )


@query("op7_brown_classes")
def op7_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-model and unigram scores of every document; a fifth of them is held out of learning."""
    return brown.score_texts(table(spark, sf_dir, "documents"), crc_remainder("doc_id", 5) == 1)


# Edits a corpus owner makes to every text: contact data masked, runs of blanks closed up.
CLEANING = [(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<mail>"), (r"\+?\d(?:[ .-]?\d){6,}", "<number>"), (r"[ \t]{2,}", " ")]


@query("op6_edit_counts")
def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its cleaning edits, from its stored segment tree.

    Trees are written beside their texts once; the edits are found and applied in a later pass over
    that table, which encodes nothing but the edited regions.
    """
    stored = materialise(edits.build_trees(table(spark, sf_dir, "documents"), ["doc_id", "text"]), "token-trees")
    planned = edits.find_edits(stored, stored.columns, CLEANING)
    found = edits.apply_edits(planned, ["doc_id", "n_tokens"], with_text=False)
    return found.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "chars_encoded")


@query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article text of every page, without what its host repeats."""
    found = templates.extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", "n_chars", "n_template")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every usable vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _words_repeated(text: Column, doc_id: Column) -> Column:
    """Words of a text; for a tenth of the ids everything from one word on becomes a repeated stretch."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (place(i) + 1).cast("int"))), " ")

    # The lambda holds the list of words, so that it is made once per text.
    words = F.array(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    changed = F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), changed).otherwise(text)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, the one of greatest exponent, and the text without repeats."""
    documents = table(spark, sf_dir, "documents").select("doc_id", _words_repeated(F.col("text"), F.col("doc_id")).alias("text"))
    found = periods.find_runs(documents, ["doc_id"])
    # Ratios are compared by products; runs are in order of start and period, so ties keep the first.
    best = F.reduce(
        "runs",
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top),
    )
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col("best")[k].alias(k) for k in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
