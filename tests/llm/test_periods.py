"""Periodic runs against a brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry_points
from brightshelf.llm import periods
from brightshelf.llm.words import mix

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    codes = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in words])
    runs = []
    for q in range(1, len(x) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.r_[False, x[:-q] == x[q:], False]))
        for a, b in zip(edges[::2], edges[1::2]):
            n = b - a + q
            if n >= max(6, 4 * q) and not any((x[a : a + n - p] == x[a + p : a + n]).all() for p in range(1, q)):
                runs.append((int(a), int(n), q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    drop = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def found(texts):
    counts = [len(t) for t in texts]
    first = np.r_[0, np.cumsum(counts)]
    tokens = mix(np.array([hash(w) & 0xFFFFFFFF for t in texts for w in t], np.uint64) + np.uint64(1))
    runs = periods.find(tokens, first)
    return [[(a - lo, n, q) for a, n, q in runs if lo <= a < hi] for lo, hi in zip(first, first[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_short_texts(texts):
    assert found(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("seed", range(30))
def test_planted_periods(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(4):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [rng.randrange(50) for _ in range(rng.randrange(20))]
            # Roots over few words hold repeats of their own.
            root = [rng.randrange(rng.choice((2, 3, 30))) for _ in range(rng.randint(1, 60))]
            words += (root * 6)[: rng.randint(2 * len(root), 6 * len(root))]
        texts.append(words)
    assert found(texts) == [brute(t) for t in texts]


def test_one_word_very_often():
    assert found([[7] * 300_000, [1, 2] * 150_000]) == [[(0, 300_000, 1)], [(0, 300_000, 2)]]


def test_rows_of_every_kind(spark):
    texts = [None, "", "  \t ", "a a a a a a", "a a a a a", "é a b\na b\ta b a b é", "x y", "x y"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "b " * 9, 1), (3, "q", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = periods.find_runs(df, ["doc_id"]).collect()
    assert len(got) == len(rows)
    for (doc, text, _), r in zip(rows, got):
        words = WORD.findall(text or "")
        want = brute(words)
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (doc, len(words), want, collapsed(words, want))
    assert periods.find_runs(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(df, ["runs"])


def test_a_very_long_text(spark):
    text = " ".join(str(i % 997) for i in range(1_000_000)) + " z" + " end" * 7
    got = periods.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert [tuple(r) for r in got.runs] == [(0, 1_000_000, 997), (1_000_001, 7, 1)]
    assert len(got.collapsed.split()) == 997 + 2


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in entry_points.queries()["op13_periodic_runs"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r.n_runs for r in got.values()) > 0
    for doc, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        r = got[doc]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
