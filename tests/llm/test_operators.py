"""Operators on small hand-made frames against brute force, with nulls, ties and repeated rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightshelf.llm import archives, boilerplate, brown, decontaminate, languages, packing, secrets, sketches

RNG = random.Random(5)
SF = "/root/testdata/sf0.001"
WORDS = ["w%d" % i for i in range(3000)]


def _text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def _documents(spark, rows):
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_against_brute_force(spark):
    base = _text(120).split()
    rows = [(i, " ".join(w if (k + i) % 60 else "x%d" % i for k, w in enumerate(base))) for i in range(40)]
    rows += [(100 + i, _text(60)) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "One"), (203, "one"), (100, rows[40][1]), (None, _text(9)), (204, rows[41][1]), (0, _text(30))]
    got = sketches.near_duplicates(_documents(spark, rows), size=2).collect()
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(r[0], s) for r, s in zip(rows, sets)], 2):
        if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else root(r.doc_id)), r
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


@pytest.mark.parametrize("buckets", [1, 2, 3, 5])
def test_boundaries_are_optimal(buckets):
    for seed in range(20):
        counts = np.random.default_rng(seed).integers(0, 5, 9)
        lengths = [i + 1 for i in range(9) if counts[i]]
        if not lengths:
            continue

        def padding(bounds):
            return sum(counts[n - 1] * (min(b for b in bounds if b >= n) - n) for n in lengths)

        options = [
            (*c, lengths[-1]) for k in range(buckets) for c in itertools.combinations(lengths[:-1], k)
        ]
        assert padding(packing.boundaries(counts, buckets)) == min(map(padding, options))


def test_packing_keeps_every_token(spark):
    rows = [(i, RNG.randint(1, 90)) for i in range(500)] + [(1, 7), (None, 3), (900, None), (901, 0)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), longest=40, buckets=4, budget=200).collect()
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    seen = {}
    for r in got:
        assert r.n_tokens <= r.padded_to <= 40
        seen.setdefault((r.padded_to, r.batch), []).append(r.place)
    for (bound, batch), places in seen.items():
        size = max(1, 200 // bound)
        assert sorted(places) == list(range(len(places)))
        assert len(places) == size or (bound, batch + 1) not in seen
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_substitutions_are_found(spark):
    item = _text(40).split()
    changed = [w if k % 9 else "zz" for k, w in enumerate(item)]
    docs = [(1, _text(80) + " " + " ".join(changed) + " " + _text(50)), (2, _text(200)), (3, None), (4, ""), (1, _text(20)), (None, " ".join(item))]
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, None), (10, "a b")], "item_id long, text string")
    got = decontaminate.find_overlaps(_documents(spark, docs), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (1, 8)]


def test_line_labels(spark):
    text = "\n".join([_text(30) + "."] * 1 + [_text(30) + "." for _ in range(5)])
    junk = "\n".join("## $$ %% && || <> ## $$ %% %d" % i for i in range(60))
    docs = _documents(spark, [(1, text), (2, junk), (3, None), (4, ""), (5, "short"), (1, text)])
    got = {r.doc_id: r for r in boilerplate.judge(docs, ["doc_id"], boilerplate.PRIOR).collect()}
    assert got[1].kept and not got[2].kept and got[3].base_failed and got[4].n_words == 0 and got[5].n_words == 1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(30):
        scores, move = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))

        def value(path):
            return sum(scores[i, p] for i, p in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert tuple(boilerplate.viterbi(scores, move)) == best


def test_gradient_equals_all_labellings():
    rng = np.random.default_rng(3)
    chain = boilerplate.Chain(rng.normal(size=(boilerplate.FEATURES, 2)), rng.normal(size=(2, 2)))
    length = np.array([3, 1, 5, 2, 5])
    flags = rng.integers(0, 1 << boilerplate.FEATURES, length.sum()).astype(np.uint16)
    label = rng.integers(0, 2, length.sum()).astype(np.uint8)
    emit, move = boilerplate._gradient(flags, label, length, chain)

    def counts(x, y):
        return x.T @ np.eye(2)[list(y)], sum((np.outer(np.eye(2)[a], np.eye(2)[b]) for a, b in zip(y, y[1:])), np.zeros((2, 2)))

    want_emit, want_move = np.zeros_like(emit), np.zeros((2, 2))
    for end, n in zip(np.cumsum(length), length):
        x = (flags[end - n : end, None].astype(int) >> np.arange(boilerplate.FEATURES)) & 1
        seen = counts(x, label[end - n : end])
        ways = [counts(x, y) for y in itertools.product((0, 1), repeat=n)]
        weight = np.exp([(e * chain.emit).sum() + (m * chain.move).sum() for e, m in ways])
        want_emit += seen[0] - sum(w * e for w, (e, _) in zip(weight, ways)) / weight.sum()
        want_move += seen[1] - sum(w * m for w, (_, m) in zip(weight, ways)) / weight.sum()
    assert np.allclose(emit, want_emit) and np.allclose(move, want_move)


def test_training_reads_whole_texts(spark):
    clean = "A plain sentence with more than eight words stands here today.\n"
    tail = "buy 1234567 now 99\n"
    docs = spark.createDataFrame([(1, clean * 900), (2, clean * 900 + "".join(f"{i} {tail}" for i in range(900))), (3, None), (4, ""), (None, tail)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, 0), (5, None)], "doc_id bigint, quality int")
    chain = boilerplate.train(docs, labels)
    digits = 11  # more than a tenth digits, which only lines behind the 900th have
    assert chain.emit[digits, 1] > boilerplate.PRIOR.emit[digits, 1] + 0.05
    assert boilerplate.train(docs, labels.limit(0)) is boilerplate.PRIOR
    assert boilerplate.train(docs.limit(0), labels) is boilerplate.PRIOR


def _base_counts(text):
    words = re.findall("[^ \t-\r]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(5)
    bits = ["a", "b c", "\n", " ", "\t", "#", "é\u3000x", "<p>", "word", "\x0b", "\u00a0", "😀"]
    texts = [None, "", " \n ", "w " * 300_000, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 400))) for _ in range(150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    got = boilerplate.judge(docs, ["doc_id", "text"], boilerplate.PRIOR).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base_counts(r.text)
        assert not (r.kept and r.base_failed)


def test_language_prototypes(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !", "de"), (5, "the dog", None)], "doc_id long, text string, lang string"
    )
    learned = languages.learn_prototypes(docs, width=2048)
    got = {r.doc_id: r.lang_pred for r in languages.identify(docs, ["doc_id"], learned).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "en"}
    assert {r.lang_pred for r in languages.identify(docs, ["doc_id"], {}).collect()} == {"und"}


def test_archives_round_trip(spark):
    long, odd = "é" * 700, "a\r\n\r\nWARC/1.1\r\n" * 3
    rows = [(1, "u", long, 0), (5, "u", long, 0), (3, None, odd, 0), (4, "u\nv", None, 0), (None, "u", long, 0), (6, "u", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    chunks = archives.read_chunks(archives.write_archives(archives.plan_records(pages)), chunk=100)
    got = {}
    for r in sorted(chunks.collect(), key=lambda r: r.chunk_no):
        got.setdefault(r.page_id, []).append(r)
    for page, _, html, _ in rows:
        records, full = got[page], (html or "").encode()
        assert records[-1].header_digest == hashlib.sha1(full).hexdigest() and records[-1].payload_length == len(full)
        assert records[-1].refers_to == (5 if page in (1, None) else None)
        stored = b"".join(bytes(r.data) for r in records)
        assert stored == (b"" if page in (1, None) else full)
        assert all(len(r.data) <= 100 for r in records) and records[-1].last


def test_secrets_and_redaction(spark):
    text = "é password = hunter2secret and AKIA" + "A" * 16 + " " + "0f" * 12
    docs = _documents(spark, [(1, text), (2, None), (3, ""), (4, "token: ab")])
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_secrets(docs, ["doc_id"]).collect()}
    at = text.index("password")
    assert got[1][0] == ("assign", at, at + len("password = hunter2secret"))
    assert [k for k, *_ in got[1]] == ["assign", "access", "hex"] and not got[2] and not got[3] and not got[4]
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert clean[1] == "é [assign] and [access] [hex]" and clean[4] == "token: ab" and clean[2] is None


def test_stages_keep_the_columns(spark, tmp_path):
    docs = _documents(spark, [(i, "\n".join(_text(20) + "." for _ in range(5))) for i in range(6)] + [(9, None)]).withColumn("extra", F.lit(1))
    copy = docs.where("doc_id = 2").withColumn("doc_id", F.lit(7).cast("long"))
    docs = docs.unionByName(copy)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, docs.where("doc_id = 4").first().text[:300])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == columns, name
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 5]
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == [0, 1, 2, 3, 5]


def test_stages_judge_rows_by_number(spark, tmp_path):
    first, second, item = ("\n".join(_text(20) + "." for _ in range(5)) for _ in range(3))
    rows = [(1, first), (1, second), (None, first), (None, item), (1, item), (7, None), (1, first)]
    docs = _documents(spark, rows)
    for name in ("kept", "n_words", "_text", "_judged", "_redacted", "row_0", "n", "m", "id", "spans"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item[:300])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, want in (
        ("quality_rules", [r for r in rows if r[1]]),
        ("near_duplicates", [(1, first), (1, second), (1, item), (7, None)]),
        ("decontamination", [r for r in rows if r[1] != item]),
        ("secret_scan", rows),
    ):
        got = stages[name](spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        key = lambda r: (r[0] or 0, r[1] or "")
        assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(want, key=key), name


def test_class_model(spark):
    rows = [(i, " ".join(RNG.choice(["a b", "c d", "A b e"]) for _ in range(20))) for i in range(30)] + [(98, None), (99, ""), (100, "new words")]
    docs = _documents(spark, rows)
    got = {r.doc_id: r for r in brown.score_texts(docs, F.col("doc_id") > 24, classes=4).collect()}
    assert len(got) == len(rows) and got[98].n_tokens == got[99].n_tokens == 1 and got[100].n_known == 1
    assert got[0].n_tokens == len(rows[0][1].split()) + 1 and got[98].score < 0
    assert sum(got[i].score for i in range(25, 30)) > sum(got[i].base_score for i in range(25, 30))
    empty = brown.score_texts(docs.limit(1), F.lit(True), classes=4).collect()
    assert empty[0].train_tokens == 0 and empty[0].n_known == 0
