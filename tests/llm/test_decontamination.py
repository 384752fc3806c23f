import random

import numpy as np
import pytest
from brute import contamination

from tidewater.llm import decontamination
from tidewater.llm.decontamination import GRAM, WINDOW, annotate, digests, grams, winnow


def texts(seed, n, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "ÄB", "Don't", "x-y", "日本"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(30)] + [(30, None), (None, "w1 w2"), (31, "w1")]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split(" ")
            a = rng.randint(0, len(w))
            parts.append(" ".join(w[a : a + rng.randint(1, 30)]).upper())
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    return rows, items


def test_same_as_brute_force(spark, documents, monkeypatch):
    rows, items = texts(1, 150)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(rows, [x for x in items if x[0] is not None])
    for block in (10**6, 100):  # one pass and several
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
        got = {r.doc_id: tuple(r)[1:] for r in digests(annotate(documents(rows, spans=1, n_words=2), bench)).collect()}
        assert got == want
    assert 5 < sum(w[4] for w in want.values()) < 150


@pytest.mark.parametrize("seed", range(20))
def test_winnowing_keeps_a_gram_of_every_window(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 3, 200)
    hashes = grams(ids, GRAM)
    kept = set(winnow(hashes, WINDOW - GRAM + 1).tolist())
    for start in range(len(ids) - WINDOW + 1):
        assert kept & set(range(start, start + WINDOW - GRAM + 1))


def test_odd_rows(spark, odd, documents):
    bench = spark.createDataFrame([(7, "one two"), (8, "word " * 20), (9, "")], "item_id long, text string")
    got = annotate(odd, bench).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[2].n_words, by[1].contaminated) == (0, 0, False)
    assert (by[3].n_hit, by[3].items) == (60_000, [8])
    assert (by[4].n_hit, by[4].items, by[4].contaminated) == (2, [7], True)
    empty = annotate(odd, bench.limit(0)).collect()
    assert len(empty) == 7 and not any(r.contaminated for r in empty)
    assert annotate(documents([]), bench).collect() == []
