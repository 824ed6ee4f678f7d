"""Exact dedup, near dedup and line dedup against plain Python, with their edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import near_dedup as near
from millrace.plans.closure import components
from millrace.llm.cuckoo import CuckooFilter
from millrace.llm.exact_dedup import drop_exact_copies, exact_dedup
from millrace.llm.line_dedup import LineDedup, dedup_lines
from millrace.llm.near_dedup import drop_near_copies, near_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, best string, N long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# exact

ROWS = [
    (1, "Hello"), (5, "hello"), (3, "HELLO"), (2, None), (4, ""), (6, "Ä"), (7, "ä"), (8, "x" * 200_000), (9, "X" * 200_000), (10, "alone"),
    (None, "hello")
]


def test_exact_marks_largest_id(spark):
    out = {r.doc_id: r for r in exact_dedup(frame(spark, ROWS)).collect()}
    assert len(out) == len(ROWS)
    for i, t in ROWS:
        norm = (t or "").translate(LOWER)
        group = [j for j, u in ROWS if (u or "").translate(LOWER) == norm]
        best = max(j for j in group if j is not None)
        r = out[i]
        assert (r.keep_id, r.group_size, r.kept) == (best, len(group), i == best)
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
        assert r.best == "x" and r.N == 1


def test_exact_repeated_rows_keep_one(spark):
    out = exact_dedup(frame(spark, [(1, "a"), (1, "a"), (1, "a")])).collect()
    assert [r.kept for r in out].count(True) == 1 and {r.group_size for r in out} == {3}


def test_exact_empty_table_and_hot_group(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(6000)]
    kept = {r.doc_id for r in drop_exact_copies(frame(spark, rows)).collect()}
    last = {}
    for i, t in rows:
        last[t] = i
    assert kept == set(last.values())


def test_exact_tiny_filter_changes_nothing(spark):
    rows = [(i, f"t{i % 700}") for i in range(1000)]
    out = exact_dedup(frame(spark, rows), max_bits=1 << 10).where("kept").count()
    assert out == 700


def test_exact_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", True, "k"), (2, "a", False, "l")], "doc_id long, text string, kept boolean, sha string")
    out = {r.doc_id: r for r in exact_dedup(docs).collect()}
    assert out[1].kept and not out[1]._kept and out[2]._kept and out[2].sha == "l"


# near

def brute_groups(rows):
    found = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        found[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in found}
    ids = sorted(found)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                x, y = found[a], found[b]
                if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(found[i]), label[i]) for i in ids}


def near_rows(seed=3):
    rng = random.Random(seed)
    rows, i = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  two"), (5, "one two three")], 10
    for _ in range(12):
        base = words(rng, rng.choice([8, 30, 120, 400]))
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = f"q{rng.randrange(10**6)}"
            rows.append((i, " ".join(own)))
            i += 1
    rows.append((i, " ".join(words(rng, 30_000))))
    return rows


def test_near_equals_brute_force(spark):
    rows = near_rows()
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(frame(spark, rows)).collect()}
    assert out == brute_groups(rows)


def test_near_chain_through_tiles(spark, monkeypatch):
    """A chain of edits whose ends are far apart, in tiles of two rows."""
    monkeypatch.setattr(near, "TILE", 2)
    monkeypatch.setattr(near, "DENSE_PAIRS", 1)
    rng = random.Random(9)
    own, rows = words(rng, 150, 10**6), []
    for i in range(40):
        rows.append((i, " ".join(own)))
        own[(i * 3) % 150] = f"q{i}"
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(frame(spark, rows)).collect()}
    assert out == brute_groups(rows)


def test_near_drop_empty_and_nulls(spark):
    assert near_groups(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None), (4, None)]
    out = drop_near_copies(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 1), (False, 3), (False, 4), (True, 0)]


def test_estimate_is_unbiased_and_intersections_exact():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.concatenate((a[:2400], np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))))
    mins = near.minima(np.concatenate((np.sort(a), np.sort(b))), np.array([0, len(a), len(a) + len(b)]))
    bits = near.packed_bits(mins)
    share = near.equal_values(bits[:1], bits[1:])[0] / near.PERMUTATIONS
    assert abs((share - 1 / 16) / (15 / 16) - 2400 / 3600) < 0.15
    sets = [np.sort(a), np.sort(b), np.sort(a[:100])]
    p, q = np.array([0, 0, 1] * 100), np.array([1, 2, 2] * 100)
    assert near._intersections(sets, p, q)[:3].tolist() == [2400, 100, 100]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 150)] + [(7, 7), (None, 3)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{j: 100 for j in range(100, 150)}}


# lines

def brute_lines(rows, gone=()):
    def key(line):
        return line.strip(" \t\n\v\f\r").translate(LOWER)

    holders = {}
    for i, t in rows:
        for line in set(map(key, (t or "").split("\n"))):
            if len(line) >= 20 and i is not None and i not in gone:
                holders.setdefault(line, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(4)
    pool = [f"Shared line number {k} with É text " for k in range(6)] + ["short", "", "ß" * 19, "é" * 20]
    rows = [(i, "\n".join(rng.choice(pool + [f"own line {i} {j} of this text only"]).upper() if rng.random() < 0.3 else rng.choice(pool) for j in range(rng.randint(0, 9)))) for i in range(40)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, pool[0] * 5000 + "\n" + pool[0]), (None, pool[0])]


def digest(out):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out.collect()), key=str)


def test_lines_equal_brute_force(spark, tmp_path):
    rows = line_rows()
    out = dedup_lines(frame(spark, rows), f"file://{tmp_path}/a")
    assert digest(out) == brute_lines(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out.collect())


def test_lines_insert_and_delete_are_reversible(spark, tmp_path):
    rows = line_rows()
    state = LineDedup(spark, f"file://{tmp_path}/b")
    state.insert(frame(spark, rows[:20]))
    state.insert(frame(spark, rows[20:]))
    state.insert(frame(spark, rows[:3]))  # known already
    assert digest(state.dedup(frame(spark, rows))) == brute_lines(rows)
    gone = {3, 7, 11, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 999}
    state.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    assert digest(state.dedup(frame(spark, rows))) == brute_lines(rows, gone)
    state.insert(frame(spark, [r for r in rows if r[0] in gone]))
    assert digest(state.dedup(frame(spark, rows))) == brute_lines(rows)


def test_lines_empty_table(spark, tmp_path):
    assert dedup_lines(frame(spark, []), f"file://{tmp_path}/c").count() == 0


def test_cuckoo_inserts_and_deletes():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    own = CuckooFilter.for_keys(5000)
    own.insert(keys)
    assert own.contains(keys).all() and not len(own.stash)
    other = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert own.contains(other).mean() < 0.005
    own.delete(keys[:2500])
    own = CuckooFilter.from_bytes(own.to_bytes())
    assert own.contains(keys[2500:]).all() and own.contains(keys[:2500]).mean() < 0.005
    full, more = CuckooFilter(1), np.arange(1, 10, dtype=np.uint64) << np.uint64(50)
    full.insert(more)  # nine hashes for four slots
    full = CuckooFilter.from_bytes(full.to_bytes())
    assert len(full.stash) == 5 and full.contains(more).all()
    full.delete(more[:6])
    assert full.contains(more[6:]).all() and not full.contains(more[:6]).any()


def test_lines_state_is_gone_on_with(spark, tmp_path):
    rows, path = line_rows(), f"file://{tmp_path}/d"
    LineDedup(spark, path).insert(frame(spark, rows[:25]))
    LineDedup(spark, path).insert(frame(spark, rows[25:]))
    gone = {3, 7, 11, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39}
    LineDedup(spark, path).delete(spark.createDataFrame([(i,) for i in [*gone, None]], "doc_id long"))
    frame(spark, rows[:2]).write.parquet(f"{path}/v4/refs")  # a change that was broken off
    state = LineDedup(spark, path)
    assert state.version == 3
    assert digest(state.dedup(frame(spark, rows))) == brute_lines(rows, gone)
    state.insert(frame(spark, [r for r in rows if r[0] in {3, 7}]))
    assert digest(LineDedup(spark, path).dedup(frame(spark, rows))) == brute_lines(rows, gone - {3, 7})
    with pytest.raises(ValueError):
        LineDedup(spark, path, min_docs=5)
    with pytest.raises(ValueError):
        dedup_lines(frame(spark, rows), path)


def test_lines_in_many_groups_of_shards(spark, tmp_path, monkeypatch):
    from millrace.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    monkeypatch.setattr(line_dedup, "GROUP_SHARDS", 2)
    monkeypatch.setattr(line_dedup, "BROADCAST_COUNTS", 0)
    rows = line_rows()
    state = LineDedup(spark, f"file://{tmp_path}/e")
    state.insert(frame(spark, rows))
    assert state.shards > 2
    assert digest(state.dedup(frame(spark, rows))) == brute_lines(rows)


def test_lines_clashing_names(spark, tmp_path):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, 1, "h", 2) for i, t in rows], "doc_id long, text string, id int, sha string, row int")
    out = dedup_lines(docs, f"file://{tmp_path}/f")
    assert digest(out) == brute_lines(rows)


def test_near_hub_in_parts_and_hot_groups(spark, monkeypatch):
    """A text that many are near copies of, dealt into parts of three pairs; hot groups are sent to all."""
    from millrace.llm import shared

    monkeypatch.setattr(near, "HUB_PAIRS", 3)
    monkeypatch.setattr(shared, "HOT_GROUPS", 4)
    rng = random.Random(21)
    base, rows = words(rng, 60, 10**6), []
    for i in range(30):
        own = list(base)
        own[rng.randrange(60)] = f"q{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(base)) for i in range(40)] + [(200 + i, " ".join(words(rng, 30, 10**6))) for i in range(20)]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(frame(spark, rows)).collect()}
    assert out == brute_groups(rows)


def test_near_repeated_ids_are_one_document(spark):
    rng = random.Random(22)
    a, b, c = (" ".join(words(rng, 40, 10**6)) for _ in range(3))
    rows = [(5, a), (5, b), (3, a), (7, f"{b} more"), (9, c), (9, c)]
    out = sorted((r.doc_id, r.component_id, r.kept) for r in near_groups(frame(spark, rows)).collect())
    assert out == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True), (9, 9, True)]


def test_near_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, "g"), (2, "a b c d e f", 3, 4, "h")], "doc_id long, text string, id int, n int, gone string")
    out = drop_near_copies(docs).collect()
    assert [(r.doc_id, r.gone) for r in out] == [(1, "g")] and near_groups(docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_long_paths_take_few_rounds(spark, monkeypatch):
    from millrace.plans import closure

    rounds = []
    real = closure._large_star
    monkeypatch.setattr(closure, "_large_star", lambda links: rounds.append(1) or real(links))
    order = list(range(10_000))
    random.Random(5).shuffle(order)
    found = components(spark.createDataFrame(list(zip(order, order[1:])), "u long, v long"))
    assert found.where("component <> 0").count() == 0 and found.count() == 10_000
    assert len(rounds) <= 20
