"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

The test items are the indexed side. Items, and the longer of question and answer by itself, are cut into segments
of about equal length, at most SEGMENT words, so an item is retrieved also where its parts stand far from each other; a segment's
BM25 weights are divided by their sum, so a score is the share of the segment's weight that a query covers, and
one threshold serves all. Every window of PASSAGE words of every training text, each STRIDE words, is a query:
a run of SEGMENT words always lies in one window whole. All segments with a score of at least
`threshold` are retrieved by block-max WAND (Ding and Suel, 2011), for all windows of a slice at once, in array operations. As the threshold is
fixed, the lists that cannot lift a segment over it are known beforehand: a segment's lightest words are no essential postings and
enter bounds as the rest of its weight. Bounds of blocks of BLOCK segments are sums of the largest essential weights; only in blocks where they reach
the threshold are postings scored. An item is found in a text
when both its question and its answer overlap the whole text by enough word shingles, or stand
in it word by word with few words changed, added or left out: one changed word breaks SHINGLE shingles, which are
most of a short answer's.

Words are runs of letters and digits; other punctuation and blanks than those of ASCII part them as well, and a character of a
script without blanks is a word of its own.

The index is flat arrays, about 30 bytes for each distinct word of a segment. It is
broadcast in shards of about SHARD_BYTES of item text, each of which takes one pass over the texts; document frequencies and
lengths are those of all items. With one shard texts are not exchanged. With more the rows are written once with a number of
their own, by which findings come back to them; ids need not be unique.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import broadcast_below, fresh, small
from millrace.llm.textkit import NON_WORD, shingles, text_slices, words
from millrace.storage import cut, ship

SEGMENT, PASSAGE, STRIDE, SHINGLE = 64, 128, 64, 5
K1, B = 1.2, 0.75
#: Segments of a block, whatever the size of the index; share of a segment's weight in its essential words, at least; sums of blocks held at once.
BLOCK, ESSENTIAL, CELLS = 16, 0.65, 1 << 21
#: Bytes of item text whose index is broadcast, some 50 MB at most.
SHARD_BYTES = 8_000_000
#: Share of a segment's weight for retrieval, and of the shingles of question and of answer for a finding.
THRESHOLD, OVERLAP = 0.6, 0.6
#: Share of the words of a question or answer that stands in order, if its shingles are too few; one of under 4 words must stand whole.
IN_ORDER = 0.75
#: Ids of contaminated documents are broadcast up to this count.
BROADCAST_IDS = 500_000
#: Scripts that are written without blanks: each of their characters is a word.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_APART = r"[^\x00-\x7F\pL\pM\pN]"


def plain_words(texts: pa.Array) -> pa.Array:
    """Texts in lower case, with a blank for each character beyond ASCII that is no letter, mark or digit, and around those of unspaced scripts."""
    lower = pc.utf8_lower(texts)
    wide = pc.not_equal(pc.binary_length(lower), pc.utf8_length(lower))
    if not pc.any(wide).as_py():
        return lower
    return pc.if_else(wide, pc.replace_substring_regex(pc.replace_substring_regex(lower, _APART, " "), _UNSPACED, r" \1 "), lower)


def question_and_answer(text: str) -> tuple[str, str]:
    """Split an item without separate answer: its last sentences of at least SHINGLE words are the answer.

    If that leaves fewer than SHINGLE words for the question, the second half of the words is the answer.
    """
    parts = re.split(r"(?<=[.!?])\s+|\n+", text.strip())
    for k in range(len(parts) - 1, 0, -1):
        question, answer = " ".join(parts[:k]), " ".join(parts[k:])
        if len(answer.split()) >= SHINGLE:
            if len(question.split()) >= SHINGLE:
                return question, answer
            break
    own = text.split()
    return " ".join(own[: len(own) // 2]), " ".join(own[len(own) // 2 :])


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(plain_words(pa.array([text or ""]))[0].as_py().encode(), dtype=np.uint8)
    return words(raw, np.array([0, len(raw)]), NON_WORD)[0]


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct runs of n words as hashes, ascending."""
    if not n or len(hashes) < n:
        return np.zeros(0, np.uint64)
    return shingles(hashes, np.array([0, len(hashes)]), n)[0]


def _part(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A question or answer as words, as shingles and as distinct words."""
    return hashes, _grams(hashes, min(SHINGLE, len(hashes))), np.unique(hashes)


def _segments(question: np.ndarray, answer: np.ndarray) -> list[np.ndarray]:
    """Segments of an item and of the longer of its parts. A finding needs both parts, so retrieving one of them is enough."""
    both = np.concatenate((question, answer))
    longer = max(question, answer, key=len)
    return [part for own in ([both, longer] if len(longer) < len(both) else [both]) for part in np.array_split(own, max(1, -(-len(own) // SEGMENT)))]


class Text:
    """The words of a text, with what is made of them once however many items are sought in it."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.grams = words, {}

    @cached_property
    def by_word(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.words, kind="stable")
        return order, self.words[order]

    def runs(self, n: int) -> np.ndarray:
        if n not in self.grams:
            self.grams[n] = _grams(self.words, n)
        return self.grams[n]

    def share(self, grams: np.ndarray, n: int) -> float:
        """The share of shingles of n words that the text has."""
        own = self.runs(n)
        return float((own[np.minimum(np.searchsorted(own, grams), len(own) - 1)] == grams).mean()) if len(own) else 0.0

    def in_order(self, part: np.ndarray, distinct: np.ndarray, least: float) -> float:
        """1 less the fewest words changed, added or left out, by words of `part`, in any place of the text; 0 if that is below `least`."""
        n, best = len(part), 0.0
        wrong = int((1 - least) * n + 1e-9)
        # a place has at most n + wrong words, and n - wrong of them are words of the part: from where it may begin to where it may last
        order, known = self.by_word
        low = np.searchsorted(known, distinct)
        at = np.sort(order[_ragged(low, np.searchsorted(known, distinct, side="right") - low)])
        last = at[n - wrong - 1 :]
        first = at[: len(last)]
        near = last - first < n + wrong
        first, last = first[near], last[near]
        if not len(first):
            return best
        start, stop = np.maximum(last - (n + wrong) + 1, 0), np.minimum(first + n + wrong, len(self.words))
        begins = np.flatnonzero(np.append(True, start[1:] - first[:-1] > n + wrong))
        for a, b in zip(start[begins], stop[np.append(begins[1:] - 1, len(start) - 1)]):
            here = self.words[a:b]
            ramp = np.arange(len(here) + 1)
            row = np.zeros(len(here) + 1, dtype=np.int64)  # a place begins anywhere
            for i, word in enumerate(part):
                step = np.concatenate(([i + 1], np.minimum(row[:-1] + (here != word), row[1:] + 1)))
                row = np.minimum.accumulate(step - ramp) + ramp
            best = max(best, 1 - int(row.min()) / n)
        return best if best >= least - 1e-9 else 0.0


@dataclass
class Index:
    """Items (id, question and answer as `_part` gives them), segments (item each) and postings by sorted term.

    A posting is essential if it is among the heaviest of its segment that make ESSENTIAL of its weight; `rest` is what a segment's others
    weigh, `block_rest` the largest of a block. Term t has entries block_start[t] to block_start[t + 1], one for each block of BLOCK segments where
    it has essential postings: the block, their largest weight, and the first of them. Segment s has all its words, by number,
    and their weights at own_start[s] to own_start[s + 1].
    """

    item_ids: list[int]
    questions: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    answers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    segment_item: np.ndarray
    terms: np.ndarray
    block_start: np.ndarray
    block_number: np.ndarray
    block_weight: np.ndarray
    block_first: np.ndarray
    segment: np.ndarray
    weight: np.ndarray
    rest: np.ndarray
    block_rest: np.ndarray
    own_start: np.ndarray
    own_term: np.ndarray
    own_weight: np.ndarray

    def search(self, pairs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(set, segment, score) of all segments with a score of at least `threshold` for sets of terms, and the postings it scored.

        `pairs` are the sets' distinct terms as ascending set * len(terms) + term. Block-max WAND for many sets at once: what a block can give a set
        is the sum of its entries' maxima and the block's rest; in the blocks where that reaches the threshold (the pivots) essential
        postings are summed by segment, with the segment's own rest as bound; the segments that are left are scored by all their words.
        """
        width, blocks, scored, enough = len(self.terms), len(self.block_rest), 0, threshold - 1e-5  # weights are of single precision
        out: list[tuple[np.ndarray, ...]] = []
        at, sets = 0, pairs // width
        while at < len(pairs):
            first_set = int(sets[at])
            stop = int(np.searchsorted(sets, first_set + max(1, CELLS // blocks)))
            own, term = sets[at:stop] - first_set, pairs[at:stop] % width
            at, n = stop, int(sets[stop - 1]) - first_set + 1
            size = self.block_start[term + 1] - self.block_start[term]
            entry = _ragged(self.block_start[term], size)
            cell = np.repeat(own, size) * blocks + self.block_number[entry]
            bound = np.bincount(cell, self.block_weight[entry], n * blocks).reshape(n, blocks)
            pivots = ((bound + self.block_rest >= enough) & (bound > 0)).ravel()
            hit = pivots[cell]
            entry, cell = entry[hit], cell[hit]
            size = self.block_first[entry + 1] - self.block_first[entry]
            posting = _ragged(self.block_first[entry], size)
            scored += len(posting)
            key, number = np.unique(np.repeat(cell // blocks, size) * len(self.rest) + self.segment[posting], return_inverse=True)
            some = np.bincount(number, self.weight[posting], len(key)) if len(key) else np.zeros(0)
            key = key[some + self.rest[key % len(self.rest)] >= enough]
            own, segment = key // len(self.rest) + first_set, key % len(self.rest)
            size = self.own_start[segment + 1] - self.own_start[segment]
            word = _ragged(self.own_start[segment], size)
            scored += len(word)
            asked = np.repeat(own, size) * width + self.own_term[word]
            there = pairs[np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)] == asked
            score = np.bincount(np.repeat(np.arange(len(key)), size), np.where(there, self.own_weight[word], 0), len(key))
            good = score >= threshold - 1e-6
            out.append((own[good], segment[good], score[good]))
        whole = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return whole[0], whole[1], whole[2], scored


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _all_hashes(texts: list[str]) -> list[np.ndarray]:
    """The words of each text as hashes, all texts at once."""
    out: list[np.ndarray] = []
    for _, raw, offsets in text_slices(plain_words(pa.array(texts, pa.string()))):
        hashes, _, _, bounds = words(raw, offsets, NON_WORD)
        out += np.split(hashes, bounds[1:-1])
    return out


def build_index(
    items: list[tuple[int, str, str]], counts: dict[int, int] | None = None, segments: int | None = None, mean: float | None = None,
    threshold: float = THRESHOLD,
) -> Index:
    """Index (id, question, answer) items. `counts` (segments that hold a term), `segments` and `mean` are those of all shards.

    Searches may go down to `threshold`: essential words have more than the weight that a segment at the threshold may lack.
    """
    ids, questions, answers, owner_of, bags = [], [], [], [], []
    for (item, _, _), q, a in zip(items, _all_hashes([q or "" for _, q, _ in items]), _all_hashes([a or "" for _, _, a in items])):
        if not len(q) and not len(a):
            continue
        for own in _segments(q, a):
            owner_of.append(len(ids))
            bags.append(np.unique(own, return_counts=True))
        ids.append(item)
        questions.append(_part(q))
        answers.append(_part(a))
    none = np.zeros(0)
    word = np.concatenate([*(b[0] for b in bags), none.astype(np.uint64)])
    tf = np.concatenate([*(b[1] for b in bags), none])
    sizes = np.array([len(b[0]) for b in bags], dtype=np.int64)
    owner = np.repeat(np.arange(len(bags)), sizes)
    terms, number = np.unique(word, return_inverse=True)
    df = np.bincount(number, minlength=len(terms)).astype(float) if counts is None else np.array([counts[t] for t in terms.tolist()], dtype=float)
    segments = segments or len(bags)
    lengths = np.bincount(owner, tf, len(bags))
    mean = mean or (lengths.mean() if len(lengths) else 1.0)
    weight = np.log1p((segments - df[number] + 0.5) / (df[number] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean))
    total = np.bincount(owner, weight, len(bags))
    place = np.empty(len(bags), dtype=np.int64)
    place[np.argsort(-total, kind="stable")] = np.arange(len(bags))  # segments of a block are alike in weight
    owner, weight = place[owner], weight / total[owner]
    by = np.lexsort((-weight, owner))  # a segment's words, heaviest first
    owner, number, weight = owner[by], number[by], weight[by].astype(np.float32)
    own_start = np.searchsorted(owner, np.arange(len(bags) + 1))
    before = np.cumsum(weight, dtype=float) - weight
    before -= before[np.minimum(own_start[:-1], max(0, len(before) - 1))][owner] if len(before) else 0
    essential = before < min(1.0, max(ESSENTIAL, 1 - threshold + 0.1))
    rest = 1 - np.bincount(owner[essential], weight[essential], len(bags))
    blocks = max(1, -(-len(bags) // BLOCK))
    block_rest = np.full(blocks * BLOCK, -np.inf)
    block_rest[: len(bags)] = rest
    e_term, e_segment, e_weight = number[essential], owner[essential], weight[essential]
    order = np.lexsort((e_segment, e_term))
    e_term, e_segment, e_weight = e_term[order], e_segment[order], e_weight[order]
    first = np.flatnonzero(np.diff(e_term * blocks + e_segment // BLOCK, prepend=-1))
    largest = np.maximum.reduceat(e_weight, first) if len(first) else e_weight
    return Index(
        ids, questions, answers, np.array(owner_of, dtype=np.int64)[np.argsort(place)], terms, np.searchsorted(e_term[first], np.arange(len(terms) + 1)),
        (e_segment[first] // BLOCK).astype(np.int32), largest, np.append(first, len(e_term)), e_segment.astype(np.int32), e_weight,
        rest, block_rest.reshape(blocks, BLOCK).max(axis=1), own_start, number.astype(np.int32), weight)


def find_items(index: Index, hashes: np.ndarray, bounds: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, int, float, float]]:
    """(text, item, question overlap, answer overlap) of all findings in a slice of texts given as word hashes."""
    if not len(index.terms) or not len(hashes):
        return []
    counts = np.diff(bounds)
    windows = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - PASSAGE) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    start = bounds[:-1][owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows))
    end = np.minimum(start + PASSAGE, bounds[1:][owner])
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == hashes)
    # the distinct terms of every window, as sorted pairs of window and term
    low, high = np.searchsorted(known, start), np.searchsorted(known, end)
    size = high - low
    place = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    width = len(index.terms)
    pairs = np.unique(np.repeat(np.arange(len(owner)), size) * width + at[known[place]])
    window, segment, _, _ = index.search(pairs, threshold)
    found: list[tuple[int, int, float, float]] = []
    texts: dict[int, Text] = {}
    for text, item in np.unique(np.column_stack((owner[window], index.segment_item[segment])), axis=0).tolist():
        if text not in texts:
            texts = {text: Text(hashes[bounds[text] : bounds[text + 1]])}
        whole = texts[text]

        def share(part: np.ndarray, grams: np.ndarray, distinct: np.ndarray) -> float:
            own = whole.share(grams, min(SHINGLE, len(part))) if len(grams) else 1.0
            return own if own >= overlap else max(own, whole.in_order(part, distinct, max(overlap, IN_ORDER)))

        q = share(*index.questions[item])
        a = share(*index.answers[item]) if q >= overlap else 0.0
        if q >= overlap and a >= overlap:
            found.append((text, item, q, a))
    return found


def _items(benchmark: DataFrame, item_col: str, text_col: str | None, question_col: str | None, answer_col: str | None) -> DataFrame:
    if question_col and answer_col:
        return benchmark.select(
            F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(question_col), F.lit("")).alias("question"),
            F.coalesce(F.col(answer_col), F.lit("")).alias("answer")
        )
    split = lambda t: dict(zip(("question", "answer"), question_and_answer(t)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            parts = [split(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([p[k] for p in parts], pa.string()) for k in ("question", "answer"))],
                names=["item", "question", "answer"]
            )

    return benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col)).mapInArrow(run, "item long, question string, answer string")


def _segment_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, segment length) of each distinct term of each segment; term null once a segment, for counts."""
    for batch in small(batches):
        terms, lengths = [], []
        for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for own in _segments(_hashes(q), _hashes(a)):
                terms += [None, *np.unique(own).view(np.int64).tolist()]
                lengths += [len(own)] * (len(terms) - len(lengths))
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(lengths, pa.int64())], names=["term", "length"])


def _with_findings(
    docs: DataFrame, text_col: str, carry: list[str], benchmark: DataFrame, item_col: str, text: str | None,
    question_col: str | None, answer_col: str | None, threshold: float, overlap: float,
) -> tuple[DataFrame, list[str]]:
    """The columns `carry` of every row of `docs` with item_ids, q and a, and the names that these three have there."""
    spark = docs.sparkSession
    ship(spark)
    items = cut(_items(benchmark, item_col, text, question_col, answer_col), "bench-items")
    total = items.agg(F.sum(F.octet_length("question") + F.octet_length("answer"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    extra = fresh(docs, "item_ids", "q", "a")
    stats = None
    if shards > 1:
        stats = cut(
            items.mapInArrow(_segment_terms, "term long, length long").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")),
            "bench-terms"
        )

    def scan(rows: DataFrame, names: list[str], shard: int) -> DataFrame:
        own = [(r.item, r.question, r.answer) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).collect()]
        if stats is None:
            index = build_index(own, threshold=threshold)
        else:
            everything = stats.where("term IS NULL").first()
            terms = np.unique(np.concatenate([h for _, q, a in own for h in (_hashes(q), _hashes(a))] or [np.zeros(0, np.uint64)]))
            mine = spark.createDataFrame([(int(t),) for t in terms.view(np.int64)], "term long")
            counts = {r.term % (1 << 64): r.n for r in stats.join(mine, "term").collect()}
            index = build_index(own, counts, everything.n, everything["mean"], threshold)
        held = spark.sparkContext.broadcast(index)
        at, keep = rows.columns.index(text_col), [rows.columns.index(c) for c in names]
        schema = rows.select(*names, F.array().cast("array<long>").alias(extra[0]), F.lit(0.0).alias(extra[1]), F.lit(0.0).alias(extra[2])).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in small(batches):
                for row, raw, offsets in text_slices(plain_words(batch.column(at))):
                    hashes, _, _, bounds = words(raw, offsets, NON_WORD)
                    n = len(offsets) - 1
                    lists, q, a = [[] for _ in range(n)], np.zeros(n), np.zeros(n)
                    for text, item, own_q, own_a in find_items(index, hashes, bounds, threshold, overlap):
                        lists[text].append(index.item_ids[item])
                        q[text], a[text] = max(q[text], own_q), max(a[text], own_a)
                    part = batch.slice(row, n)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k) for k in keep), pa.array([sorted(x) for x in lists], pa.list_(pa.int64())), pa.array(q), pa.array(a)],
                        names=[*names, *extra]
                    )

        return rows.mapInArrow(run, schema)

    if shards == 1:
        return scan(docs, carry, 0), extra
    number = fresh(docs, "number")[0]
    rows = cut(docs.withColumn(number, F.monotonically_increasing_id()), "bench-rows")
    some = F.size(extra[0]) > 0
    hits = cut(scan(rows, [number], 0).where(some), "bench-found")  # only findings are exchanged
    for shard in range(1, shards):
        hits = hits.unionByName(cut(scan(rows, [number], shard).where(some), "bench-found"))
    more = hits.groupBy(number).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(extra[0])))).alias(extra[0]), F.max(extra[1]).alias(extra[1]),
        F.max(extra[2]).alias(extra[2])
    )
    found = rows.select(*carry, number).join(broadcast_below(cut(more, "bench-hits"), BROADCAST_IDS), number, "left")
    return found.select(
        *carry, F.coalesce(extra[0], F.array().cast("array<long>")).alias(extra[0]),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in extra[1:])
    ), extra


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str | None = "text", question_col: str | None = None, answer_col: str | None = None,
    threshold: float = THRESHOLD, overlap: float = OVERLAP,
) -> DataFrame:
    """For every row of `docs`: id, contaminated, kept, n_items, item_ids (ascending), question_overlap and answer_overlap.

    The overlaps are the largest among the findings, 0 without any: shares of shingles, or of words in order where the shingles
    are too few. A null or empty text holds nothing; items without words are in no text. Each row is judged by its own text, whatever its
    id and however many items there are; repeated rows have a row each. Other columns play no part. An empty table of either kind gives no findings.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found, _ = _with_findings(texts, "text", ["id"], benchmark, item_col, item_text_col, question_col, answer_col, threshold, overlap)
    hit = F.size("item_ids") > 0
    return found.select(
        F.col("id").alias(id_col), hit.alias("contaminated"), (~hit).alias("kept"), F.size("item_ids").cast("long").alias("n_items"),
        "item_ids", F.col("q").alias("question_overlap"), F.col("a").alias("answer_overlap")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that hold a test item, in their own columns, whatever their names.

    Each row is judged by its own text: null and repeated ids play no part, and neither does `id_col`. A null or empty text stays. An
    empty benchmark leaves `docs` as it is.
    """
    found, (item_ids, _, _) = _with_findings(docs, text_col, docs.columns, benchmark, "item_id", "text", None, None, THRESHOLD, OVERLAP)
    return found.where(F.size(item_ids) == 0).select(*docs.columns)
