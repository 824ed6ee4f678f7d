"""Ranked lexical search by branch and bound over hierarchical max trees.

Documents are indexed in segments, each in one row: for every term the documents of the segment that hold it, with counts. Within a segment
documents stand in order of length, as documents of like length get like scores. Once the statistics of the whole corpus are known,
each term of a segment gets a max tree over ranges of documents: the leaves are its scores by document, each node above has the
maximum of up to FAN nodes below, the root that of the segment. Trees are sparse, a node being there only where the term is.

For a query, a range's bound is the sum of its terms' maxima. The ranges of highest bound are opened first; a document is a range whose
bound is its score. A range below the query's last place so far is never opened; one that equals it is opened if it holds a smaller id, so ties
end as they must. All queries of a block descend side by side: each step opens the best ranges of every query at once, in array operations.

A first wave searches a few segments only. What it finds bounds the last places from below, so that in the second wave, over all segments,
most are left at their root. Tasks keep their best from segment to segment and send no more than `top` rows for a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.textkit import NON_WORD, text_slices, words
from millrace.storage import cut, drop_table, ship, write_table

#: Documents and postings of a segment, at most (one document's postings stay together).
SEGMENT_DOCS, SEGMENT_POSTINGS = 8_192, 1 << 21
#: Children of a node of a tree, as a power of two.
FAN_BITS = 3
#: Ranges that a query opens at each step, and (query, term) pairs that descend side by side.
WIDTH, SIDE_BY_SIDE = 4, 1 << 14
#: (query, term) pairs of a block of queries, about; a block is broadcast, some 16 bytes a pair.
BLOCK_PAIRS = 1 << 20
#: The first wave searches one segment of so many.
FIRST_WAVE = 32

_LAST = np.iinfo(np.int64).max
_KINDS = [np.dtype(t) for t in ("u1", "u2", "u4", "i8")]


def _pack(values: np.ndarray) -> bytes:
    """Non-negative integers (or any 64-bit ones) in the smallest type that holds them, which the first byte names."""
    kind = 3
    if len(values) == 0 or values.min() >= 0:
        kind = next(k for k, t in enumerate(_KINDS) if not len(values) or values.max() <= np.iinfo(t).max)
    return bytes([kind]) + values.astype(_KINDS[kind]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, _KINDS[data[0]], offset=1).astype(np.int64)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


# the index

SEGMENT = "first long, n_docs long, n_terms long, ids binary, missing binary, lengths binary, terms binary, bounds binary, docs binary, tfs binary"


class _Filling:
    """A segment that is being filled: documents with their lengths, and (term, document, count)."""

    def __init__(self) -> None:
        self.n_docs = self.n_terms = self.docs = self.postings = 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray, terms: np.ndarray, docs: np.ndarray, tfs: np.ndarray) -> None:
        self.n_docs += int((lengths > 0).sum())
        self.n_terms += int(lengths.sum())
        held, number = np.unique(docs, return_inverse=True)  # documents without a wanted term are only counted
        self.parts.append((ids[held], missing[held], lengths[held], terms, number + self.docs, tfs))
        self.docs, self.postings = self.docs + len(held), self.postings + len(terms)

    def row(self) -> list:
        ids, missing, lengths, terms, docs, tfs = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, lengths))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        docs = place[docs]
        by_term = np.lexsort((docs, terms))
        terms, docs, tfs = terms[by_term], docs[by_term], tfs[by_term]
        kinds, first = np.unique(terms, return_index=True)
        bounds = np.append(first, len(terms))
        data = [ids[order], missing[order], lengths[order], kinds.view(np.int64), bounds, docs, tfs]
        return [int(ids.min()) if len(ids) else 0, self.n_docs, self.n_terms, *map(_pack, data)]


def _segments(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    filling = _Filling()

    def done() -> pa.RecordBatch:
        names = [f.split()[0] for f in SEGMENT.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(filling.row(), kinds)], names=names)

    for batch in batches:
        ids = batch.column(0)
        missing, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(_LAST).to_numpy()
        for row, raw, offsets in text_slices(batch.column(1)):
            hashes, _, _, bounds = words(raw, offsets, NON_WORD)
            lengths, n = np.diff(bounds), len(offsets) - 1
            owner = np.repeat(np.arange(n), lengths)
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, hashes), max(0, len(wanted) - 1))
                found = wanted[at] == hashes if len(wanted) else np.zeros(len(hashes), dtype=bool)
                hashes, owner = hashes[found], owner[found]
            kinds, number = np.unique(hashes, return_inverse=True)
            pairs, tfs = np.unique(owner * max(1, len(kinds)) + number, return_counts=True)  # by document, then term
            docs, terms = pairs // max(1, len(kinds)), kinds[pairs % max(1, len(kinds))] if len(kinds) else kinds
            at = 0
            while at < n:  # documents that still fit
                room = np.searchsorted(docs, np.arange(at, n), side="right") - np.searchsorted(docs, at)
                more = max(1, min(SEGMENT_DOCS - filling.docs, int(np.searchsorted(room, SEGMENT_POSTINGS - filling.postings, side="right"))))
                own = slice(*np.searchsorted(docs, [at, at + more]))
                stop = min(n, at + more)
                filling.add(ids[row + at : row + stop], missing[row + at : row + stop], lengths[at:stop], terms[own], docs[own] - at, tfs[own])
                at = stop
                if filling.docs >= SEGMENT_DOCS or filling.postings >= SEGMENT_POSTINGS or at < n:
                    yield done()
                    filling = _Filling()
    if filling.parts:
        yield done()


def build_index(docs: DataFrame, wanted: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the segments of `docs` as a table and return its path.

    Every row is a document, whatever its id; all its terms count towards its length and the corpus statistics. Postings are those of
    the terms whose sorted hashes are given, or of all terms.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(wanted)  # at most BLOCK_PAIRS
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return write_table(rows.mapInArrow(lambda batches: _segments(batches, held.value), SEGMENT), "segments")


# trees and the search in a segment


@dataclass
class Trees:
    """Max trees of a segment's terms. Level 0 are documents; entries are sorted by term, then node; children[l][e] is the first child."""

    terms: np.ndarray
    ids: np.ndarray
    missing: np.ndarray
    nodes: list[np.ndarray]
    values: list[np.ndarray]
    children: list[np.ndarray]
    least: list[np.ndarray]  # by level, the smallest id of each node's documents


def build_trees(terms: np.ndarray, bounds: np.ndarray, docs: np.ndarray, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> Trees:
    """Trees of `terms`; scores are those of each posting, postings bounds[t] to bounds[t + 1] being those of term t by document."""
    nodes, values, children, least = [docs], [scores], [np.zeros(0, dtype=np.int64)], [ids]
    owner, span = np.repeat(np.arange(len(terms)), np.diff(bounds)), 1
    while span < len(ids):
        span <<= FAN_BITS
        above = nodes[-1] >> FAN_BITS
        first = np.flatnonzero(np.concatenate(([True], (above[1:] != above[:-1]) | (owner[1:] != owner[:-1])))) if len(above) else np.zeros(0, np.int64)
        values.append(np.maximum.reduceat(values[-1], first) if len(first) else values[-1])
        children.append(np.append(first, len(above)))
        nodes.append(above[first])
        owner = owner[first]
        below = least[-1]
        least.append(np.minimum.reduceat(below, np.arange(0, len(below), 1 << FAN_BITS)) if len(below) else below)
    return Trees(terms, ids, missing, nodes, values, children, least)


class Best:
    """The best documents so far of each query: score down, then id up; the last place of full lists."""

    def __init__(self, queries: int, top: int, floors: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.top = top
        self.score, self.id = (np.zeros(queries, dtype=np.int64), np.full(queries, -_LAST - 1)) if floors is None else (floors[0].copy(), floors[1].copy())
        self.rows = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))  # query, score, id, missing
        self.opened = 0

    def beats(self, query: np.ndarray, score: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a range with this bound and this smallest id may hold a document for the query's list."""
        last = self.score[query]
        return (score > last) | ((score == last) & (least <= self.id[query]) & (score > 0))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        query, score, ids, missing = (np.concatenate(x) for x in zip(self.rows, (query, score, ids, missing)))
        order = np.lexsort((missing, ids, -score, query))
        query, score, ids, missing = query[order], score[order], ids[order], missing[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        full = nth == self.top - 1
        self.score[query[full]], self.id[query[full]] = score[full], ids[full]
        kept = nth < self.top
        self.rows = query[kept], score[kept], ids[kept], missing[kept]


def search_trees(trees: Trees, query: np.ndarray, entry: np.ndarray, best: Best) -> None:
    """Put the segment's documents for all queries into `best`; entry[i] is the tree of a term that query[i] has (queries ascending)."""
    top = len(trees.nodes) - 1
    if not len(query):
        return
    pool, used = entry.astype(np.int64), len(entry)  # entries of open ranges, each range a slice
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    if top == 0:  # one document
        scores = np.add.reduceat(trees.values[0][pool], first)
        fit = best.beats(query[first], scores, np.full(len(first), trees.ids[0]))
        best.add(query[first][fit], scores[fit], np.full(int(fit.sum()), trees.ids[0]), np.full(int(fit.sum()), trees.missing[0]))
        return
    # open ranges: level, query, bound, smallest id, slice of the pool
    bound = np.add.reduceat(trees.values[top][pool], first)
    n = len(first)
    ranges = [np.full(n, top), query[first], bound, np.full(n, trees.least[top][0]), first, np.diff(np.append(first, used))]
    while True:
        keep = best.beats(ranges[1], ranges[2], ranges[3])
        order = np.lexsort((ranges[3], -ranges[2], ranges[1]))
        order = order[keep[order]]
        ranges = [x[order] for x in ranges]
        if not len(order):
            return
        chosen = np.arange(len(order)) - np.searchsorted(ranges[1], ranges[1]) < WIDTH
        opened, ranges = [x[chosen] for x in ranges], [x[~chosen] for x in ranges]
        best.opened += len(opened[0])
        found, fresh = [], []
        for level in np.unique(opened[0]).tolist():
            own = np.flatnonzero(opened[0] == level)
            sizes = opened[5][own]
            entries = pool[_ragged(opened[4][own], sizes)]
            from_, to = trees.children[level][entries], trees.children[level][entries + 1]
            below = _ragged(from_, to - from_)
            owner = np.repeat(np.repeat(np.arange(len(own)), sizes), to - from_)
            node = trees.nodes[level - 1][below]
            order = np.argsort(owner * len(trees.least[level - 1]) + node)
            below, owner, node = below[order], owner[order], node[order]
            first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (node[1:] != node[:-1]))))
            bound = np.add.reduceat(trees.values[level - 1][below], first)
            whose, node = opened[1][own][owner[first]], node[first]
            least = trees.least[level - 1][node]
            fit = best.beats(whose, bound, least)
            if level == 1:
                found.append((whose[fit], bound[fit], least[fit], trees.missing[node[fit]]))
                continue
            sizes = np.diff(np.append(first, len(below)))[fit]
            kept = below[_ragged(first[fit], sizes)]
            starts = used + np.cumsum(sizes) - sizes
            if used + len(kept) > len(pool):
                pool = np.concatenate((pool[:used], np.zeros(max(used, len(kept)) + len(kept), dtype=np.int64)))
            pool[used : used + len(kept)] = kept
            used += len(kept)
            fresh.append([np.full(len(sizes), level - 1), whose[fit], bound[fit], least[fit], starts, sizes])
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found)))
        ranges = [np.concatenate(x) for x in zip(ranges, *fresh)] if fresh else ranges


@dataclass
class Queries:
    """A block of queries: their numbers, and (query's place, term's place) by query; the terms' hashes, sorted, with their weights."""

    numbers: np.ndarray
    query: np.ndarray
    term: np.ndarray
    hashes: np.ndarray


def _held_terms(row: dict, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a segment's terms those among sorted `hashes`: their places in the segment and in `hashes`."""
    own = _unpack(row["terms"]).view(np.uint64)
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    mine = np.flatnonzero(hashes[at] == own)
    return mine, at[mine]


def search_segment(row: dict, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, best: Best) -> None:
    """Search one segment for all queries of the block."""
    mine, place = _held_terms(row, queries.hashes)
    if not len(mine):
        return
    bounds, lengths = _unpack(row["bounds"]), _unpack(row["lengths"])
    sizes = bounds[mine + 1] - bounds[mine]
    at = _ragged(bounds[mine], sizes)
    docs, tfs = _unpack(row["docs"])[at], _unpack(row["tfs"])[at]
    m = 100 - 90 + 90 * lengths * n_docs // n_terms
    scores = np.repeat(weights[place], sizes) * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[docs]))
    trees = build_trees(place, np.append(0, np.cumsum(sizes)), docs, scores, _unpack(row["ids"]), _unpack(row["missing"]))
    tree_of = np.full(len(queries.hashes), -1, dtype=np.int64)
    tree_of[place] = np.arange(len(place))
    entry = tree_of[queries.term]
    query, entry = queries.query[entry >= 0], entry[entry >= 0]
    start = 0
    while start < len(query):  # whole queries, side by side
        stop = np.searchsorted(query, query[min(len(query), start + SIDE_BY_SIDE) - 1], side="right")
        search_trees(trees, query[start:stop], entry[start:stop], best)
        start = int(stop)


# the search over all segments


def _query_terms(items: DataFrame, text_col: str) -> DataFrame:
    """(query, term): the distinct terms of each item's whole text, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for row, raw, offsets in text_slices(batch.column(1)):
                hashes, _, _, bounds = words(raw, offsets, NON_WORD)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))) if len(order) else np.zeros(0, dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[row + owner[new]]), pa.array(hashes[new].view(np.int64))], names=["query", "term"])

    return items.select("__number", F.col(text_col).cast("string")).mapInArrow(run, "query long, term long")


def _block(pairs: DataFrame) -> Queries:
    table = pairs.orderBy("query").toArrow()  # about BLOCK_PAIRS rows
    numbers, query = np.unique(table["query"].to_numpy(), return_inverse=True)
    hashes, term = np.unique(table["term"].to_numpy().view(np.uint64), return_inverse=True)
    return Queries(numbers, query, term, hashes)


def _statistics(segments: DataFrame, hashes: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and the documents that hold each of `hashes`."""
    n_docs, n_terms = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = segments.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(held.value), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                mine, place = _held_terms(row, held.value)
                counts[place] += np.diff(_unpack(row["bounds"]))[mine]
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], names=["term", "df"])

    parts = segments.select("terms", "bounds").mapInArrow(run, "term long, df long")
    table = parts.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the block at most
    df = np.zeros(len(hashes), dtype=np.int64)
    df[table["term"].to_numpy()] = table["df"].to_numpy()
    return n_docs, n_terms, df


def _found(segments: DataFrame, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, top: int, floors=None) -> DataFrame:
    """(query, score, id): at most `top` for each query and task; no task sends what is below the floors."""
    spark = segments.sparkSession
    held = spark.sparkContext.broadcast((queries, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, floors = held.value
        best = Best(len(queries.numbers), top, floors)
        for batch in batches:
            for k in range(len(batch)):
                search_segment(batch.slice(k, 1).to_pylist()[0], queries, weights, n_docs, n_terms, best)
        query, score, ids, missing = best.rows
        columns = [pa.array(query), pa.array(score), pa.array(ids, mask=missing.astype(bool))]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "score", "id"])

    return segments.mapInArrow(run, "query long, score long, id long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """`found` with its rank, up to `top`; tasks' lists are merged in groups first, so that no task gets those of all tasks."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    parts = Window.partitionBy("query", "__part").orderBy(*order)
    merged = found.withColumn("__part", F.spark_partition_id() % 64).withColumn("__nth", F.row_number().over(parts)).where(F.col("__nth") <= top)
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top).drop("__part", "__nth")


def _floors(best: DataFrame, queries: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The last place of each query with a full list; ids below all others where there is none."""
    score, ids = np.zeros(queries, dtype=np.int64), np.full(queries, -_LAST - 1)
    rows = best.where(F.col("rank") == top).select("query", "score", F.coalesce("id", F.lit(_LAST)).alias("id")).toArrow()
    score[rows["query"].to_numpy()], ids[rows["query"].to_numpy()] = rows["score"].to_numpy(), rows["id"].to_numpy()
    return score, ids


def _search_block(spark: SparkSession, segments: DataFrame, queries: Queries, top: int) -> DataFrame:
    n_docs, n_terms, df = _statistics(segments, queries.hashes)
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    few = segments.where(F.pmod(F.xxhash64("first", "n_docs", "n_terms"), F.lit(FIRST_WAVE)) == 0)
    floors = _floors(_ranked(_found(few, queries, weights, n_docs, n_terms, top), top), len(queries.numbers), top)
    ranked = _ranked(_found(segments, queries, weights, n_docs, n_terms, top, floors), top)
    numbers = spark.createDataFrame(pa.table({"query": np.arange(len(queries.numbers)), "__number": queries.numbers}))
    return ranked.join(F.broadcast(numbers), "query").select("__number", "rank", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item id, rank, document id and score: the `top` documents of highest score for every row of `items`, equal scores by ascending id.

    Scores are BM25 in integers, over whole texts, with the statistics of all of `docs`. Only scores above 0 rank; an item without
    terms, or whose terms no document has, gives no rows. Every row of `docs` is a document and every row of `items` a query, whatever their ids: rows
    that repeat rank one after the other, a null document id after all others of its score. Null texts have no terms. Empty tables give no
    rows. Other columns play no part, whatever their names.
    """
    if top < 1:
        raise ValueError("top must be at least 1")
    spark = docs.sparkSession
    ship(spark)
    numbered = cut(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).withColumn("__number", F.monotonically_increasing_id()), "items")
    pairs = cut(_query_terms(numbered, "text"), "item-terms")
    blocks = -(-pairs.count() // BLOCK_PAIRS)
    block_of = F.pmod(F.xxhash64("query"), F.lit(max(1, blocks)))
    held = [_block(pairs)] if blocks == 1 else []
    out = spark.createDataFrame([], f"{item_col} {dict(items.dtypes)[item_col]}, rank int, {id_col} bigint, score bigint")
    if not blocks:
        return out
    path = build_index(docs, held[0].hashes if held else None, id_col, text_col)
    segments = spark.read.schema(SEGMENT).parquet(path)
    for b in range(blocks):
        queries = held[0] if held else _block(pairs.where(block_of == b))
        if not len(queries.numbers):
            continue
        found = cut(_search_block(spark, segments, queries, top), "ranked")
        named = found.join(numbered.select("__number", "item"), "__number")
        out = out.unionByName(named.select(F.col("item").alias(item_col), F.col("rank").cast("int"), F.col("id").alias(id_col), "score"))
    drop_table(spark, path)
    return out
