"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled reference text. A text is parsed against
it greedily: each phrase is the longest match that the automaton still follows (Ziv and Merhav's
cross parsing, 1993). The fewer phrases a text needs for its length, the lower its cross-entropy
with the language; the language with the fewest phrases, normalised by what its own reference
needs for unseen text of its language, wins.

The automata are walked for many texts at once: texts are cut into lanes of LANE symbols, each of which starts a new
phrase, and all lanes advance together, one symbol a step. A missing transition is stored as the
transition from the root with the phrase bit set, so a step is one table lookup. Whole texts are parsed.

It learns from a bounded sample of labelled rows: those of a language that come first by the hash of their id, as long as they are at
most DOCS_PER_LANGUAGE rows and have REFERENCE_SYMBOLS together; of long texts, stretches from all over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import fresh, small
from millrace.llm.textkit import text_slices
from millrace.storage import ship

#: Labelled documents of a language that are learnt from at most, and their characters and symbols in all.
DOCS_PER_LANGUAGE, REFERENCE_SYMBOLS = 96, 49_152
#: Stretches of a long text that are learnt from.
STRETCHES = 8
#: Entries of all languages' tables together, 4 bytes each and broadcast; under 2^30, so that entries have numbers of 30 bits.
TABLE_ENTRIES = 1 << 27
#: Symbols of a lane.
LANE = 512
UNDETERMINED = "und"
#: A text fits no language if the best needs over so many times the phrases of its own unseen text, and so many more: a few lines of
#: another language or script, or of random letters, do; a handful of words never does.
MISFIT, MISFIT_SLACK = 2.5, 8

_PHRASE = np.int32(1 << 30)
_PAD = 255  # byte value that never occurs in UTF-8


def symbol_table() -> np.ndarray:
    """Byte to symbol: letters without case, bytes of longer characters as they are, all else one blank."""
    table = np.zeros(256, dtype=np.uint8)
    for k in range(26):
        table[65 + k] = table[97 + k] = 1 + k
    table[128:248] = np.arange(27, 147)
    return table


SYMBOLS = 147
_TABLE = symbol_table()


def squeeze(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts with runs of blanks made one, and the bounds of the texts in them."""
    symbols = _TABLE[raw]
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    first = offsets[:-1]
    keep[first[first < len(raw)]] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    return symbols[keep], upto[offsets]


def automaton(text: list[int], symbols: int) -> np.ndarray:
    """Suffix automaton of `text` as a table [state, symbol] of next states; -1 where none."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(follow), symbols), -1, dtype=np.int32)
    for state, edges in enumerate(follow):
        for c, to in edges.items():
            table[state, c] = to
    return table


@dataclass
class LanguageModel:
    """Languages in order, the automata in one step table, their roots, and phrases a symbol of own unseen text."""

    languages: list[str]
    step: np.ndarray
    roots: np.ndarray
    alphabet: np.ndarray
    own_rate: np.ndarray

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each text against each language: [texts, languages]."""
        counts = np.diff(bounds)
        out = np.zeros((len(counts), len(self.languages)), dtype=np.int64)
        lanes = -(-counts // LANE)
        total = int(lanes.sum())
        if not total:
            return out
        owner = np.repeat(np.arange(len(counts)), lanes)
        within = np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = bounds[:-1][owner] + within * LANE
        size = np.minimum(LANE, bounds[1:][owner] - start)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        coded = self.alphabet[symbols]
        live = np.searchsorted(-size, -np.arange(LANE), side="left")  # lanes longer than each position
        state = np.repeat(self.roots[:, None], total, axis=1)
        found = np.zeros((len(self.languages), total), dtype=np.int32)
        for at in range(int(size[0])):
            n = int(live[at])
            nxt = self.step[state[:, :n] + coded[start[:n] + at]]
            found[:, :n] += nxt >> 30
            state[:, :n] = nxt & (_PHRASE - 1)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, found[k] + 1, len(counts)).astype(np.int64)
        return out


def build_model(samples: dict[str, list[str]]) -> LanguageModel:
    """A model from labelled texts; every fourth text of a language sets its normaliser, the rest its automaton."""
    languages = sorted(samples)
    parts, held = {}, {}
    for name in languages:
        symbols = [s for s in (squeeze(*_one(text))[0] for text in samples[name]) if len(s)]
        held[name] = symbols[3::4] or symbols[:1]
        rest = [s for i, s in enumerate(symbols) if i % 4 != 3]
        parts[name] = np.concatenate([np.concatenate((s, [0])) for s in rest] or [np.zeros(1, np.uint8)])
    seen = np.unique(np.concatenate([*parts.values(), np.zeros(1, np.uint8)]))
    alphabet = np.full(256, len(seen), dtype=np.int32)  # symbols that no reference has share the last place
    alphabet[seen] = np.arange(len(seen))
    width = len(seen) + 1
    tables, roots, base = [], [], 0
    for name in languages:
        table = automaton(alphabet[parts[name]].tolist(), width)
        lone = base + len(table)  # the state after a symbol that the reference lacks: a phrase by itself
        begin = np.where(table[0] >= 0, table[0] + base, lone).astype(np.int32) * width
        restart = begin | _PHRASE  # a phrase ended before the symbol
        step = np.where(table >= 0, (table + base) * width, restart[None, :]).astype(np.int32)
        step[0] = begin  # no phrase is under way at the root
        tables += [step, restart[None, :]]
        roots.append(base * width)
        base = lone + 1
    model = LanguageModel(
        languages, np.concatenate([t.ravel() for t in tables]) if tables else np.zeros(1, np.int32), np.array(roots, dtype=np.int32),
        alphabet, np.ones(len(languages))
    )
    for k, name in enumerate(languages):
        if held[name]:
            ends = np.concatenate(([0], np.cumsum([len(s) for s in held[name]])))
            model.own_rate[k] = max(1, model.phrases(np.concatenate(held[name]), ends)[:, k].sum()) / max(1, ends[-1])
    return model


def _one(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return raw, np.array([0, len(raw)])


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs: int = DOCS_PER_LANGUAGE, symbols: int = REFERENCE_SYMBOLS) -> LanguageModel:
    """Fit on labelled texts of each language: the first by the hash of their id, at most `docs` with `symbols` symbols in all.

    Texts are taken whole; one of over a quarter of the bound gives that many characters in STRETCHES stretches, one from each part of the text at a
    place chosen by the hash of its id. With so many languages that their tables could have over TABLE_ENTRIES entries, each has fewer
    symbols. Which rows are first is found without their texts.
    """
    text, place = F.col(text_col), F.xxhash64(F.col(id_col))
    usable = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    rows = usable.select(F.col(lang_col).alias("lang"), place.alias("place"), F.xxhash64(lang_col, id_col, text_col).alias("key"))
    by = Window.partitionBy("lang").orderBy("place", "key")
    first = rows.withColumn("rank", F.row_number().over(by)).where(f"rank <= {docs}").collect()  # `docs` short rows a language
    if not first:
        return build_model({})
    symbols = min(symbols, max(LANE, TABLE_ENTRIES // (2 * (SYMBOLS + 1) * len({r.lang for r in first}))))
    ranks = {r.key: (r.lang, r["rank"]) for r in first}
    keys = F.broadcast(labelled.sparkSession.createDataFrame([(k,) for k in ranks], "key long"))
    most, part = symbols // 4, F.floor(F.length(text) / STRETCHES).cast("int")
    spread = [
        F.substring(text, (part * k + F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), part - most // STRETCHES + 1) + 1).cast("int"), F.lit(most // STRETCHES))
        for k in range(STRETCHES)
    ]
    sample = F.when(F.length(text) <= most, text).otherwise(F.concat_ws(" ", *spread)).alias("text")
    held = usable.select(F.xxhash64(lang_col, id_col, text_col).alias("key"), sample).join(keys, "key").dropDuplicates(["key"]).collect()
    samples: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    for key, text in sorted(held, key=lambda r: ranks[r.key]):
        lang = ranks[key][0]
        size = len(squeeze(*_one(text))[0])
        if size <= left.setdefault(lang, symbols) or lang not in samples:
            samples.setdefault(lang, []).append(text)
            left[lang] -= size
    return build_model(samples)


def _has_letter(text_col: str) -> Column:
    return F.coalesce(F.regexp_like(text_col, F.lit(r"\p{L}")), F.lit(False))


def identify_languages(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` with `lang_pred`, `score` and `fits`; where `docs` has such a name, ours gets a leading underscore.

    `labelled` (its id, text and language columns, nulls ignored) is what is learnt from; the label of a row in `docs`
    is no input. `und` with score 0 where the text is null, has no letter or nothing was learnt. The score is the
    share by which the second-best language needs more phrases than the best, from 0 to 1; ties go to the first in
    alphabetical order. `fits`: there is a letter, and the best language needs about as few phrases as for its own
    text (MISFIT); where nothing was learnt a letter is enough. Rows repeat as they are; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(learn(labelled, id_col, text_col, lang_col))
    extra = fresh(docs, "lang_pred", "score", "fits")
    names = docs.columns
    framed = docs.select(*names, _has_letter(text_col).alias(fresh(docs, "letter")[0]))
    schema = docs.select(*names, F.lit("").alias(extra[0]), F.lit(0.0).alias(extra[1]), F.lit(True).alias(extra[2])).schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in small(batches):
            for row, raw, offsets in text_slices(batch.column(at)):
                part = batch.slice(row, len(offsets) - 1)
                symbols, bounds = squeeze(raw, offsets)
                letter = part.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
                label, margin, fits = [UNDETERMINED] * len(letter), np.zeros(len(letter)), letter
                if m.languages:
                    every, phrases = np.arange(len(letter)), m.phrases(symbols, bounds)
                    need = phrases / m.own_rate
                    best = need.argmin(axis=1)
                    least = need[every, best]
                    expected = np.diff(bounds) * m.own_rate[best]
                    fits = letter & (phrases[every, best] <= MISFIT * expected + MISFIT_SLACK)
                    need[every, best] = np.inf
                    second = need.min(axis=1) if need.shape[1] > 1 else np.full(len(best), np.inf)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        margin = np.where(np.isinf(second), 1.0, np.clip(1 - least / second, 0, 1))
                    label = [m.languages[b] if o else UNDETERMINED for b, o in zip(best.tolist(), letter.tolist())]
                    margin = np.where(letter, margin, 0.0)
                own = [pa.array(label, pa.string()), pa.array(margin, pa.float64()), pa.array(fits)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *own], names=[*names, *extra])

    return framed.mapInArrow(run, schema)


def learning_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return docs.where(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drop_undetermined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` without the rows whose text is null, has no letter or fits none of the languages learnt from `docs`, in their own columns.

    A text too short to tell is kept, and so is every text with a letter where no language could be learnt. Each row is judged by
    its own text: repeated rows and null ids stay or go as such. An empty table gives no rows; column names may clash with ours.
    """
    fits = fresh(docs, "fits")[0]
    found = identify_languages(docs, learning_rows(docs, id_col), id_col, text_col, lang_col)
    return found.where(F.col(fits)).select(*docs.columns)
