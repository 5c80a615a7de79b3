"""Edited token counts against encoding the whole edited text."""

import random

import pytest

from brightshelf.llm import edits

ALPHABET = ["a", "b", "L", "'", "l", "'ll", "'re", " ", "  ", "\n", "\t", "7", "!", "é", "漢", "😀", "the", " word", "_", "　"]


@pytest.fixture(scope="module")
def tokens():
    return edits.tokens_of(edits.VOCABULARY, edits.PATTERN)


def _draw(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


@pytest.mark.parametrize("seed", range(40))
def test_random_edits_equal_full_encoding(tokens, seed):
    rng = random.Random(seed)
    text = _draw(rng, rng.choice([0, 1, 5, 60, 900]))
    now = edits.Counted(text, *edits.build_tree(text, tokens), tokens)
    for _ in range(60):
        at, removed = rng.randint(-2, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 40, 2000])
        new = _draw(rng, rng.choice([0, 1, 1, 2, 7, 300]))
        now.edit(at, removed, new)
        at = min(max(at, 0), len(text))
        text = text[:at] + new + text[at + removed :]
        assert now.text() == text
        assert now.n_tokens == tokens.whole(text)
        assert now.chars[1] == len(text)
        leaves = len(now.parts)
        for sums in (now.chars, now.sums):
            assert all(sums[i] == sums[2 * i] + sums[2 * i + 1] for i in range(1, leaves))


def test_only_the_region_is_encoded(tokens):
    text = "some words of a long text. " * 20_000
    now = edits.Counted(text, *edits.build_tree(text, tokens), tokens)
    now.edit(270_000, 4, "other")
    assert 0 < now.encoded < 500
    now.edit(0, 0, "x" * 3)
    now.edit(len(now.text()), 0, " end")
    assert now.encoded < 1500 and now.n_tokens == tokens.whole(now.text())


def test_long_runs_do_not_go_quadratic(tokens):
    text = "word " * 20_000 + " " * 100_000 + "x"
    now = edits.Counted(text, *edits.build_tree(text, tokens), tokens)
    now.edit(99_999, 1, "")
    now.edit(150_000, 0, "y")
    assert now.n_tokens == tokens.whole(now.text())


def test_frames(spark, tokens):
    rows = [
        (1, "Mail a@b.example now, or call 5551234.", "x", 1),
        (1, "Mail a@b.example now, or call 5551234.", "x", 1),
        (2, None, "x", 1),
        (3, "", None, 1),
        (None, "call 99999", "x", 1),
        (4, "clean", "x", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits_ string, n_tokens_edited long")
    rules = [(r"[\w.]+@[\w.]+\w", "<mail>"), (r"\d{4,}", "0000")]
    planned = edits.find_edits(df, ["doc_id", "text"], rules)
    trees = edits.build_trees(planned, ["doc_id", "text", "edits"]).withColumnRenamed("n_tokens", "before")
    got = edits.apply_edits(trees, ["doc_id", "before"]).collect()
    want = {1: "Mail <mail> now, or call 0000.", 2: None, 3: "", None: "call 0000", 4: "clean"}
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "4", "None"]
    for r in got:
        assert r.edited_text == want[r.doc_id]
        assert r.n_tokens_edited == tokens.whole(r.edited_text or "")
        assert r.edited_tokens[1] == r.n_tokens_edited and r.edited_chars[1] == len(r.edited_text or "")
        assert r.n_edits == {1: 2, None: 1}.get(r.doc_id, 0)
    again = edits.apply_edits(
        spark.createDataFrame(
            [(r.doc_id, r.edited_text, r.edited_chars, r.edited_tokens, [None, (None, 1, "q"), (-5, None, "Oh "), (999, 9, None), (3, 1, "")]) for r in got],
            f"doc_id long, text string, tree_chars array<bigint>, tree_tokens array<bigint>, edits array<{edits.EDIT}>",
        ),
        ["doc_id"],
    ).collect()
    for r in again:
        old = want[r.doc_id] or ""
        assert r.edited_text == "Oh " + old[1:] and r.n_tokens_edited == tokens.whole(r.edited_text)
    empty = edits.apply_edits(edits.build_trees(planned.limit(0), ["doc_id", "text", "edits"]), ["doc_id"])
    assert empty.count() == 0


def test_a_foreign_tree_raises(spark):
    trees = edits.build_trees(spark.createDataFrame([("abc",)], "text string"), ["text"])
    moved = trees.selectExpr("'abcd' as text", "tree_chars", "tree_tokens", f"cast(array() as array<{edits.EDIT}>) as edits")
    with pytest.raises(Exception, match="beside a text"):
        edits.apply_edits(moved, []).collect()


def test_query_against_full_encoding(spark, tokens):
    import regex

    from brightshelf.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op6_edit_counts(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and sum(r.n_edits for r in rows) > 0
    either = regex.compile("|".join(f"({p})" for p, _ in queries.CLEANING))
    for r in rows:
        cleaned, n = either.subn(lambda m: queries.CLEANING[m.lastindex - 1][1], texts[r.doc_id])
        assert (r.n_tokens, r.n_edits, r.n_tokens_edited) == (tokens.whole(texts[r.doc_id]), n, tokens.whole(cleaned))
