"""Ranked search against scores computed for every document in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lexical_search as lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in items:
        scored = []
        for i, tf, n in held:
            m = 100 - 90 + 90 * n * n_docs // n_terms if n_terms else 0
            weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if t in tf}
            score = sum(w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t, w in weight.items())
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(map(str, out))


def corpus(n=260, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(150)] + ["é", "日本語", "Ñandú", "x_y"]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 60))) for _ in range(n)]
    texts += ["", None, "...", "W1 w1 W1", "only-here", "a" * 9000] + [texts[3]] * 40 + ["rare rare word"] * 15
    docs = [(i * 7 % 1009 - 20, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, "rare word"), (5, texts[9]), (5, texts[9])]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for k in range(30)]
    items += [(None, "rare"), (100, ""), (101, None), (102, "nowhere"), (103, texts[3]), (103, "ONLY here"), (104, "w0 " * 500)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, Rank int").repartition(5), spark.createDataFrame(
        [(i, t, "x") for i, t in items], "item_id long, text string, score string"
    )


@pytest.mark.parametrize("sizes", [{}, {"SEGMENT_DOCS": 3}, {"SEGMENT_POSTINGS": 40, "FAN_BITS": 1, "WIDTH": 1, "SIDE_BY_SIDE": 5}, {"FIRST_WAVE": 2}, {"BLOCK_PAIRS": 40, "SEGMENT_DOCS": 20}])
def test_search_equals_scoring_all(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    for top in (10, 1):
        found = lexical.search(*frames(spark, docs, items), top=top)
        assert sorted(map(str, map(tuple, found.collect()))) == plain(docs, items, top)
        if "BLOCK_PAIRS" in sizes:
            break


def test_few_ranges_are_opened():
    rng = np.random.default_rng(0)
    n, n_terms = 4096, 12
    bounds, docs, scores = [0], [], []
    for _ in range(n_terms):
        own = np.sort(rng.choice(n, 400, replace=False))
        docs.append(own)
        scores.append(rng.integers(1, 10**6, 400) ** 3 // 10**12)
        bounds.append(bounds[-1] + 400)
    trees = lexical.build_trees(np.arange(n_terms), np.array(bounds), np.concatenate(docs), np.concatenate(scores), np.arange(n), np.zeros(n, np.int64))
    whole = np.zeros(n, dtype=np.int64)
    np.add.at(whole, np.concatenate(docs), np.concatenate(scores))
    best = lexical.Best(1, 10)
    lexical.search_trees(trees, np.zeros(n_terms, np.int64), np.arange(n_terms), best)
    order = np.lexsort((np.arange(n), -whole))[:10]
    assert best.rows[2].tolist() == order.tolist() and best.rows[1].tolist() == whole[order].tolist()
    assert best.opened < 4096 // 8  # less than the ranges just above the documents


def test_copies_that_tie_are_not_all_opened():
    n = 4096
    trees = lexical.build_trees(np.array([0]), np.array([0, n]), np.arange(n), np.full(n, 7), np.arange(n)[::-1].copy(), np.zeros(n, np.int64))
    best = lexical.Best(1, 10)
    lexical.search_trees(trees, np.array([0]), np.array([0]), best)
    assert best.rows[2].tolist() == list(range(10)) and best.opened < 40


def test_search_empty_tables(spark):
    docs, items = frames(spark, *corpus(20))
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text = '...'"), items)):
        found = lexical.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
    with pytest.raises(ValueError):
        lexical.search(docs, items, top=0)


def test_packed_integers_come_back():
    for values in ([], [0], [255], [256], [70_000], [1 << 40], [-1, 5], [2**63 - 1, -(2**63)]):
        assert lexical._unpack(lexical._pack(np.array(values, dtype=np.int64))).tolist() == values
