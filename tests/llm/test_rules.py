"""Repetition coverage against plain Python, with its edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import textkit
from millrace.llm.repetition import MOST_COVERED, keep_unrepetitive, measure, repetition_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text, lengths):
    text = text or ""
    words = WORD.findall(text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    seen, out["n_dup_lines"], out["dup_line_chars"] = set(), 0, 0
    for line in text.split("\n"):
        if found := WORD.findall(line):
            if line in seen:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += sum(map(len, found))
            seen.add(line)

    def inside(n, first):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        times, met, marked = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if times[g] > 1 and (first or g in met):
                marked.update(range(i, i + n))
            met.add(g)
        return marked

    out["n_repeat_words"] = len(inside(3, True))
    for n in lengths:
        out[f"dup_chars_{n}"] = sum(len(words[i]) for i in inside(n, False))
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    within = all(100 * out[f"dup_chars_{n}"] <= most * out["word_chars"] for n, most in lengths.items())
    out["kept"] = not out["base_failed"] and within and 100 * out["dup_line_chars"] <= 20 * out["word_chars"]
    return out


def texts(n=150, seed=3):
    rng = random.Random(seed)
    parts = ["a", "bé", "日本", "x|y", "##", "the", "of", "\n", "\r\n", " \t ", "\x0b", "𝕏", "one two three four five six seven eight nine ten eleven", "\n\n"]
    out = ["", None, " \n\t", "a", "a a a a", "a\na\na", "x" * 5000, "a b c " * 400, "line one\nline one\r\nline one", " " * 300 + "w", "w\n" * 90]
    for _ in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 150))]
        some = [rng.choice(parts) for _ in range(rng.randint(0, 60))]
        out.append(" ".join(x for pair in zip(words + some, some + words) for x in pair))
    return out


def test_counts_equal_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    found = repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.asDict() for r in found} == {i: {"doc_id": i, **plain(t, MOST_COVERED)} for i, t in rows}
    assert {r.kept for r in found} == {True, False}


def test_equal_hashes_are_told_apart(monkeypatch):
    whole = textkit.SpanHasher.__call__
    monkeypatch.setattr(textkit.SpanHasher, "__call__", lambda self, s, e: whole(self, s, e) % np.uint64(3))
    for text in ("a b c d e f a b x", "one\ntwo\none\nsix", "é è ê a\né è ê b"):
        raw = np.frombuffer(text.encode(), np.uint8)
        found = measure(raw, np.array([0, len(raw)]), [])
        wanted = plain(text, {})
        assert {k: int(v[0]) for k, v in found.items()} == {k: wanted[k] for k in found}


def test_one_very_long_text(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(30_000)}" for _ in range(400_000)) + " the same six words come again" * 3
    (row,) = repetition_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_words == 400_018 and row.asDict() == {"doc_id": 1, **plain(text, MOST_COVERED)}


def test_rules_clashing_names_and_odd_rows(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(None, good, 1, "x"), (5, good, 2, "x"), (5, good, 2, "x"), (6, None, 3, None), (7, "same line here\n" * 30, 4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, Kept string")
    kept = keep_unrepetitive(df)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.where("n_words < 3").collect()))
    judged = repetition_rules(df.withColumnRenamed("n_words", "other"), carry=["other"])
    assert judged.columns[:2] == ["doc_id", "other"] and judged.count() == 5
    with pytest.raises(ValueError):
        repetition_rules(df, carry=["n_words"])
    with pytest.raises(ValueError):
        repetition_rules(df, most_covered={2: 10})
    assert repetition_rules(df.limit(0)).count() == 0 and keep_unrepetitive(df.limit(0)).count() == 0
