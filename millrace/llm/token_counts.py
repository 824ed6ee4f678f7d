"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens by array comparisons (`pretokens`); the distinct new ones of a batch are laid out as
ragged arrays of byte symbols, and all of them apply their lowest-ranked pair at once, round by round
(`byte_bpe`). The symbols that survive are counted and remembered by pre-token, so each text is a sum of look-ups. A look-up
goes by hash and then compares the pre-token itself, so counts are exact whatever the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.byte_bpe import ByteBpe
from millrace.llm.pretokens import PretokenTable, pretokens, split_texts
from millrace.llm.shared import small
from millrace.storage import ship

#: Pre-tokens remembered by a worker.
REMEMBERED = 1_500_000

_tables: dict[int, tuple[ByteBpe, PretokenTable]] = {}


def counter(source: bytes) -> tuple[ByteBpe, PretokenTable]:
    """The vocabulary and its table of counts, kept for the life of a worker."""
    key = zlib.crc32(source)
    if key not in _tables:
        bpe = ByteBpe(source)
        _tables[key] = bpe, PretokenTable(lambda texts: [np.array([len(x)]) for x in bpe.merge(texts)], REMEMBERED)
    return _tables[key]


def count_texts(source: bytes, texts: list[str | None]) -> np.ndarray:
    """Tokens of each text; special strings inside a text are one token each, null counts as empty."""
    bpe, table = counter(source)
    out = np.zeros(len(texts), dtype=np.int64)
    for row, n, points, offsets, owner, marks, text in split_texts(texts, list(bpe.special)):
        starts, ends, hashes, segment = pretokens(points, offsets, marks)
        plain = marks[segment] < 0 if len(segment) else np.zeros(0, dtype=bool)
        sizes = np.ones(len(starts), dtype=np.int64)
        numbers = table.numbers(points, text, starts[plain], ends[plain], hashes[plain])
        sizes[plain] = table.ids[table.start[numbers]]
        out[row : row + n] += np.bincount(owner[segment], sizes, n).astype(np.int64) if len(segment) else 0
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row; null counts as empty.

    The counts are those of the tokenizers library for the file, without added special tokens. A null id stays null.
    Repeated rows repeat; other columns play no part, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts = count_texts(held.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
