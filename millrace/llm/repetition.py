"""Quality rules by repetition coverage: how much of a text stands inside n-grams and lines that it has had before.

Words get exact numbers; the n-grams of several lengths get rolling hashes of these numbers, all texts of a slice at once. A longer
n-gram can only repeat where its opening does, so each length looks no further than at the windows that the shorter one found
repeated. What a repeat covers is marked word by word and measured in code points, overlaps once.

A text fails the base rules with fewer than 50 words, or with over half of its words in repeated windows of three. It
fails the coverage rules when repeats of n-grams, or of lines, hold more of its characters than a share for each length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import fresh
from millrace.llm.textkit import SpanHasher, exact_numbers, mix, text_slices, word_spans
from millrace.storage import ship

#: The least words of a text, and the most percent of them in repeated windows of BASE_WINDOW words.
LEAST_WORDS, MOST_REPEATED, BASE_WINDOW = 50, 50, 3
#: By length of n-gram in words, the most percent of a text's characters that repeats of such n-grams may cover.
MOST_COVERED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: The most percent of a text's characters in lines that it has had before.
MOST_IN_LINES = 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in order of place: whether each occurs twice or more, and whether it has occurred before."""
    _, first, number, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return counts[number] > 1, first[number] != np.arange(len(keys))


def _covered(places: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Whether each word lies in a window of `size` words that begins at one of `places`."""
    change = np.zeros(n_words + 1, dtype=np.int32)
    change[places] += 1
    change[places + size] -= 1  # places differ, so none is counted twice
    return np.cumsum(change)[:n_words] > 0


def measure(raw: np.ndarray, offsets: np.ndarray, lengths: list[int]) -> dict[str, np.ndarray]:
    """Counts of each text of a slice by name; dup_chars_<n> are the characters that repeated n-grams of n words cover."""
    texts = len(offsets) - 1
    starts, ends, bounds = word_spans(raw, offsets)
    n_words, total = np.diff(bounds), len(starts)
    points = _sums((raw & 0xC0) != 0x80)  # code points before each byte
    chars = _sums(points[ends] - points[starts])  # and those in words before each word
    symbols = _sums(_SYMBOL[raw])
    out = {"n_words": n_words, "word_chars": chars[bounds[1:]] - chars[bounds[:-1]], "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}

    hasher = SpanHasher(raw)
    breaks = np.flatnonzero(raw == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    line_starts = line_starts[line_starts < len(raw)]
    line_ends = np.minimum(np.append(line_starts[1:], len(raw)), len(raw))
    line_ends = line_ends - (raw[line_ends - 1] == 10) if len(line_ends) else line_ends
    owner = np.searchsorted(offsets, line_starts, side="right") - 1
    first_word, past_word = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    worded = past_word > first_word
    line_starts, line_ends, owner, first_word, past_word = (x[worded] for x in (line_starts, line_ends, owner, first_word, past_word))
    before = _repeated(exact_numbers(raw, line_starts, line_ends, hasher, owner))[1]
    out["n_dup_lines"] = np.bincount(owner[before], minlength=texts)
    in_lines = chars[past_word] - chars[first_word]
    out["dup_line_chars"] = np.bincount(owner[before], in_lines[before], texts).astype(np.int64)

    numbers = exact_numbers(raw, starts, ends, hasher)
    of_word = np.repeat(np.arange(texts), n_words)
    kinds = int(numbers.max()) + 1 if total else 1
    places = np.arange(max(0, total - BASE_WINDOW + 1))
    places = places[of_word[places] == of_word[places + BASE_WINDOW - 1]]
    keys = numbers[places] + kinds * of_word[places]  # texts are kept apart; exact, by pairs of numbers
    for k in range(1, BASE_WINDOW):
        keys = np.unique(keys, return_inverse=True)[1] * kinds + numbers[places + k]
    twice, _ = _repeated(keys)
    marked = _sums(_covered(places[twice], BASE_WINDOW, total))
    out["n_repeat_words"] = marked[bounds[1:]] - marked[bounds[:-1]]

    rolling, salt = SpanHasher(numbers), mix(of_word.astype(np.uint64) + np.uint64(1))
    places = places[twice]
    for n in sorted(lengths):
        places = places[places + n <= total]
        places = places[of_word[places] == of_word[places + n - 1]]
        twice, again = _repeated(mix(rolling(places, places + n) ^ salt[places]))
        inside = _sums(np.where(_covered(places[again], n, total), np.diff(chars), 0))
        out[f"dup_chars_{n}"] = inside[bounds[1:]] - inside[bounds[:-1]]
        places = places[twice]
    return out


def repetition_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_covered: dict[int, int] | None = None, most_in_lines: int = MOST_IN_LINES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row's counts and verdict: the id, `carry`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars,
    dup_chars_<n> for each length, base_failed and kept.

    Whole texts are read; a null text has no words, so it fails the base rules, as does an empty one. Null ids stay null; rows that repeat
    are judged each by itself; an empty table gives no rows. Columns to carry along are named; one whose name is that of a count is a ValueError.
    Lengths are of BASE_WINDOW words or more, as windows are sought where windows of three repeat.
    """
    limits = MOST_COVERED if most_covered is None else most_covered
    if any(n < BASE_WINDOW for n in limits):
        raise ValueError(f"n-grams have {BASE_WINDOW} words at least")
    spark = docs.sparkSession
    ship(spark)
    lengths = sorted(limits)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in lengths)]
    others = carry or []
    if {c.lower() for c in [id_col, *others]} & {*names, "base_failed", "kept"}:
        raise ValueError("a column to keep has the name of a count")
    (text,) = fresh(docs, "__text")
    rows = docs.select(id_col, *others, F.col(text_col).cast("string").alias(text))
    held = [f for f in rows.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[dict[str, np.ndarray]] = [measure(raw, offsets, lengths) for _, raw, offsets in text_slices(batch.column(len(held)))]
            counts = [pa.array(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0), pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(held)], *counts], names=[*(f.name for f in held), *names])

    schema = rows.select(*[f.name for f in held], *[F.lit(0).cast("long").alias(n) for n in names]).schema
    few = F.col("n_words") < LEAST_WORDS
    base = few | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    fine = 100 * F.col("dup_line_chars") <= most_in_lines * F.col("word_chars")
    for n, most in limits.items():
        fine = fine & (100 * F.col(f"dup_chars_{n}") <= most * F.col("word_chars"))
    return rows.mapInArrow(run, schema).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & fine)


def keep_unrepetitive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that fail the rules, all columns as they are, whatever their names and ids."""
    holder, own = fresh(docs, "__row", "__text")
    packed = docs.select(F.struct(*docs.columns).alias(holder), F.col(text_col).alias(own))
    judged = repetition_rules(packed, holder, own)
    return judged.where("kept").select(f"{holder}.*")
