"""Token-ID files: every document compressed alone with one shared zstandard dictionary.

A file set is a folder with two Parquet tables, so that any store Spark writes to will do:

- `dictionary`: one row (sha256, width, content). The dictionary is trained on the serialized ids of a bounded sample.
- `shards`: rows of up to SHARD_BYTES of frames in ascending order of id, null ids first: part, shard, first_id, last_id,
  null_ids, docs, tokens, part_start, dictionary_sha256, index and data. `data` holds a zstandard frame of each document, end to
  end; `index` has for each document its id (int64; the first null_ids have none), the offset of its frame's end and its tokens.

The ids of a document are `width`-byte little-endian unsigned integers. A document is read by one shard lookup on first_id
and last_id, a binary search in the index, and one frame. Texts are encoded and compressed where they are; only the frames
are exchanged, into the order of ids. Pre-tokens are encoded by the tokenizers library, each distinct one once a
worker (texts as a whole take it ten times as long); byte-level BPE never merges across them.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.byte_bpe import ByteBpe
from millrace.llm.pretokens import PretokenTable, pretokens, split_texts
from millrace.llm.shared import small
from millrace.storage import cut, ship

#: Bytes of frames in a shard, its documents, the dictionary's size, documents and tokens of each that it is trained on.
SHARD_BYTES, SHARD_DOCS, DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_TOKENS = 4 << 20, 8192, 64 << 10, 512, 4096
#: Pre-tokens remembered by a worker.
REMEMBERED = 1_000_000
_SHARD_SCHEMA = (
    "part int, shard int, first_id long, last_id long, null_ids long, docs long, tokens long, part_start long, "
    "dictionary_sha256 string, index binary, data binary"
)

_tables: dict[int, tuple[ByteBpe, PretokenTable]] = {}


def _encoder(source: bytes) -> tuple[ByteBpe, PretokenTable]:
    key = zlib.crc32(source)
    if key not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(source.decode())
        encode = lambda texts: [np.array(x.ids, dtype=np.uint32) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        _tables[key] = ByteBpe(source), PretokenTable(encode, REMEMBERED)
    return _tables[key]


def encode_texts(source: bytes, texts: list[str | None], end_id: int | None = None) -> Iterator[np.ndarray]:
    """The ids of each text in turn, uint32, with `end_id` appended; null counts as empty."""
    bpe, table = _encoder(source)
    special = list(bpe.special)
    special_ids = np.array([bpe.special[s] for s in special], dtype=np.uint32)
    tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
    for _, n, points, offsets, owner, marks, text in split_texts(texts, special):
        starts, ends, hashes, segment = pretokens(points, offsets, marks)
        row = owner[segment] if len(segment) else np.zeros(0, dtype=np.int64)
        plain = marks[segment] < 0 if len(segment) else np.zeros(0, dtype=bool)
        ids, upto = table.lists(table.numbers(points, text, starts[plain], ends[plain], hashes[plain]))
        bounds = np.searchsorted(row[plain], np.arange(n + 1))
        if plain.all():
            for k in range(n):
                yield np.concatenate((ids[upto[bounds[k]] : upto[bounds[k + 1]]], tail))
        else:  # a special string stands among the pre-tokens
            place = np.cumsum(plain) - 1
            for k in range(n):
                own = np.flatnonzero(row == k)
                parts = [ids[upto[place[i]] : upto[place[i] + 1]] if plain[i] else special_ids[marks[segment[i]], None] for i in own.tolist()]
                yield np.concatenate([*parts, tail])


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of the samples; too few of them serve as raw content themselves."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, level: int = 3
) -> None:
    """Encode `docs` into a new file set at `path`, in ascending order of id, rows without id first.

    A null text counts as empty. Rows with equal ids stay apart, in any order; other columns play no part, whatever their names. An
    empty table gives an empty set. An existing path is an error. The dictionary is trained on SAMPLE_DOCS documents, the first
    by the hash of their id, and of each on SAMPLE_TOKENS tokens of a stretch that another hash of the id chooses.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        source = f.read()
    width = 2 if ByteBpe(source).width <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # which rows are first by hash is found without their texts; then a stretch of those texts goes to the driver
    edge = rows.select(F.xxhash64("id").alias("place")).orderBy("place").limit(SAMPLE_DOCS).agg(F.max("place")).first()[0]
    first = rows.where(F.xxhash64("id") <= edge) if edge is not None else rows.limit(0)
    chars = 8 * SAMPLE_TOKENS
    place = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    sample = sorted(first.select(F.substring(F.col("text"), place.cast("int"), F.lit(chars))).limit(SAMPLE_DOCS).collect(), key=lambda r: r[0] or "")
    content = train_dictionary([ids[:SAMPLE_TOKENS].astype(f"<u{width}").tobytes() for ids in encode_texts(source, [r[0] for r in sample], end_id)])
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, width, content)], "sha256 string, width int, content binary").coalesce(1).write.parquet(f"{path}/dictionary")
    held = spark.sparkContext.broadcast((source, content))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        source, content = held.value
        compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(content), write_content_size=True)
        for batch in small(batches):
            sizes, frames = [], []
            for ids in encode_texts(source, batch.column(1).to_pylist(), end_id):
                sizes.append(len(ids))
                frames.append(compressor.compress(ids.astype(f"<u{width}").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], names=["id", "n", "frame"])

    # the ranges are found by a pass over the rows, which must not encode them once more
    frames = cut(rows.mapInArrow(compress, "id long, n long, frame binary"), "token-frames")
    frames.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(_assemble(digest), _SHARD_SCHEMA).write.option("compression", "none").parquet(f"{path}/shards")


def _assemble(digest: str):
    """Shards from frames (id, n, frame) that come in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, tokens = TaskContext.get().partitionId(), 0, 0
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in _SHARD_SCHEMA.split(", ")]
        ids: list[int | None] = []
        sizes: list[int] = []
        frames: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, tokens, held
            nulls, total = ids.count(None), sum(sizes)
            own = [i for i in ids if i is not None]
            index = np.column_stack([np.array([i or 0 for i in ids], "<i8"), np.cumsum([len(f) for f in frames]), sizes]).astype("<i8")
            ends = (own[0], own[-1]) if own else (None, None)
            out = [part, shard, *ends, nulls, len(ids), total, tokens, digest, index.tobytes(), b"".join(frames)]
            shard, tokens, held = shard + 1, tokens + total, 0
            for kept in (ids, sizes, frames):
                kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds)], names=names)

        for batch in small(batches):
            for key, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(key)
                sizes.append(n)
                frames.append(frame)
                held += len(frame)
                if held >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield flush()
        if ids:
            yield flush()

    return run


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, str, int, bytes]:
    sha, width, content = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(content)).hexdigest() != sha:
        raise ValueError(f"the dictionary of {path} is damaged")
    return spark.read.parquet(f"{path}/shards"), sha, width, bytes(content)


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the set, and `ids` with `ids=True`.

    start counts the tokens of all documents before; ids_crc32 is taken over the ids as little-endian unsigned 32-bit integers.
    A document written without id has none; documents with equal ids have a row each; an empty set gives no rows.
    """
    ship(spark)
    shards, sha, width, content = _open(spark, path)
    # a row for each part: as many as the writing job had tasks
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.broadcast(parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")))
    rows = shards.join(parts, "part").select((F.col("base") + F.col("part_start")).alias("start"), "dictionary_sha256", "null_ids", "index", "data")
    held = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(held.value))
        for batch in small(batches):
            for k in range(len(batch)):
                start, own, nulls, index, data = (batch.column(c)[k].as_py() for c in range(5))
                if own != sha:
                    raise ValueError("a shard was written with another dictionary")
                table = np.frombuffer(index, dtype="<i8").reshape(-1, 3)
                view, begin, crc, lists = memoryview(data), 0, [], []
                for _, end, n in table.tolist():
                    found = np.frombuffer(reader.decompress(view[begin:end], max_output_size=max(1, n * width)), dtype=f"<u{width}").astype("<u4")
                    crc.append(zlib.crc32(found.tobytes()))
                    if ids:
                        lists.append(found)
                    begin = end
                starts = start + np.concatenate(([0], np.cumsum(table[:-1, 2])))
                keys = pa.array(table[:, 0].copy(), mask=np.arange(len(table)) < nulls)
                out = [keys, pa.array(starts), pa.array(table[:, 2].copy()), pa.array(crc, pa.int64())]
                if ids:
                    ends = np.concatenate(([0], np.cumsum(table[:, 2]))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists).astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each document with this id: one index search and one frame for each; none gives an empty list."""
    import zstandard

    shards, sha, width, content = _open(spark, path)
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
    out = []
    for row in shards.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "shard").collect():
        table, nulls = np.frombuffer(bytes(row["index"]), dtype="<i8").reshape(-1, 3), row["null_ids"]
        for k in range(*(nulls + np.searchsorted(table[nulls:, 0], (doc_id, doc_id + 1))).tolist()):
            begin = int(table[k - 1, 1]) if k else 0
            frame = bytes(row["data"])[begin : int(table[k, 1])]
            out.append(np.frombuffer(reader.decompress(frame, max_output_size=max(1, int(table[k, 2]) * width)), dtype=f"<u{width}").astype(np.uint32))
    return out
