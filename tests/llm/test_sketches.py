"""Near duplicates where a common passage or a large group of near copies makes every pair a candidate."""

import random

import pytest

from brightshelf.llm import sketches


def components(rows, size=2):
    """Smallest id of each component, by comparing all pairs of word shingle sets."""
    sets = {i: set(zip(*[t.split()[k:] for k in range(size)])) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("own", [6, 14])
def test_common_passages_and_near_copies(spark, own):
    rng = random.Random(own)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    # Texts of a common passage and a few words of their own, some of them near copies of one another.
    rows = []
    for i in range(400):
        rows.append([*passage, *[word() for _ in range(own)]])
        if i % 10 == 0:
            rows.append([*rows[-1][:-1], word()])
    base = [word() for _ in range(120)]
    for _ in range(300):
        copy = base.copy()
        for _ in range(2):
            copy[rng.randrange(120)] = word()
        rows.append(copy)
    rng.shuffle(rows)
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    got = sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows)
