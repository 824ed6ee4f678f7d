"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, then SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Between stages the
documents are written as Parquet in the shared folder and reread.

Texts can be long, so the stages run with Arrow batches of at most BATCH_ROWS rows: `run` does so in a session of its own with the caller's
settings; a caller that runs single stages finds the setting lowered in the session of its documents.

In every stage null texts count as empty, texts of any length are taken whole, an empty table gives an empty table, and other columns
are carried along whatever their names. What becomes of null and repeated ids, and of ties, is said at each stage.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontaminate import drop_contaminated
from millrace.llm.exact_dedup import drop_exact_copies
from millrace.llm.language_id import drop_undetermined
from millrace.llm.near_dedup import drop_near_copies
from millrace.llm.sentencepiece_codec import encode_pieces
from millrace.storage import drop_table, new_folder, tables

#: Rows of an Arrow batch, at most.
BATCH_ROWS, BATCH_SETTING = 256, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The SentencePiece model that the last stage encodes with.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _bounded(stage):
    """A stage whose documents' session has batches of at most BATCH_ROWS rows."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        conf = docs.sparkSession.conf
        if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
            conf.set(BATCH_SETTING, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@_bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that can be told: those with a letter whose text fits a language learnt from the input's labels.

    Empty texts go. A few words fit any language; where there are no labels every text with a letter stays. Each row is judged by itself, so
    null and repeated ids make no difference.
    """
    return drop_undetermined(docs)


@_bounded
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of equal texts (A-Z as a-z), the one of the largest id; a null id is below all others, and of rows that share text and id one stays."""
    return drop_exact_copies(docs)


@_bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of near copies, the one of the smallest id.

    Rows that repeat an id are one document and stay or go together; rows without id, and texts without words, stay.
    """
    return drop_near_copies(docs)


@_bounded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no test item. Each row is judged by its own text, whatever its id; an empty benchmark keeps all."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add `piece_ids` and `decoded`, the text that they decode to, in place of the text. A row each, whatever the ids; no text has no pieces."""
    return encode_pieces(docs, MODEL, with_text=True).drop("text")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Language ID, similarity groups, retrieval and encoding are beyond SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def own_session(spark: SparkSession) -> SparkSession:
    """A session beside `spark`, with its settings."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    spark = own_session(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        with tables(spark):
            left = stage(spark, docs, sf_dir)
            left.write.option("compression", "zstd").parquet(path)
        if before:
            drop_table(spark, before)
        docs, before = spark.read.schema(left.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
