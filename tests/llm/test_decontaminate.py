import itertools

import numpy as np
import pytest

from brightshelf.llm import decontaminate as d


@pytest.mark.parametrize("length", range(1, 21))
def test_masks_meet_every_pattern_of_changes(length):
    masks = d.masks_for(length, d.STRETCH, d.SHARE, d.LEAST, d.MASKS)
    wrong = d.changes(length, d.SHARE) if length >= d.LEAST else 0
    assert length < d.LEAST or (length - wrong) / length >= d.SHARE > (length - wrong - 1) / length
    patterns = np.array([sum(1 << k for k in places) for places in itertools.combinations(range(length), wrong)])
    met = np.zeros(len(patterns), bool)
    for mask in masks:
        bits = sum(1 << k for k, flag in enumerate(mask) if flag == "1")
        for at in range(length - len(mask) + 1):
            met |= (patterns & (bits << at)) == 0
    assert met.all()


@pytest.mark.parametrize("share", [0.5, 0.7, 0.9, 1.0])
def test_masks_of_other_shares(share):
    for length in range(8, 15):
        masks, wrong = d.masks_for(length, 14, share, 8, d.MASKS), d.changes(length, share)
        for places in itertools.combinations(range(length), wrong):
            assert any(all(mask[k] == "0" or at + k not in places for k in range(len(mask))) for mask in masks for at in range(length - len(mask) + 1))


def test_short_items_are_found(spark):
    items, docs, want = [], [], set()
    filler = "lorem ipsum dolor"
    for n in (1, 2, 5, 7, 8, 9, 10, 12, 14, 15, 16, 19, 20):
        words = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        wrong = d.changes(n, d.SHARE) if n >= d.LEAST else 0
        for number, places in enumerate(itertools.islice(itertools.combinations(range(n), wrong), 0, None, max(1, n // 3))):
            changed = ["zz" if k in places else w for k, w in enumerate(words)]
            docs.append((n * 10000 + number, f"{filler} {' '.join(changed)} {filler} {' '.join(changed)}"))
            want.add((n * 10000 + number, n))
        over = ["zz" if k <= wrong else w for k, w in enumerate(words)]
        docs.append((n * 10000 + 9999, f"{filler} {' '.join(over)} {filler}"))
    got = d.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, ""), (98, " .")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.share == 1.0 for r in got if r.item_id < d.LEAST)
