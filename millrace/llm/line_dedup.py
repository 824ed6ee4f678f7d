"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

The state is a folder with a subfolder for each change, v1, v2 and so on:

- `refs`: (k1, k2, id, v), the references that an insertion adds: a row for each document that holds a line key (a 128-bit hash),
- `ids`: (id, v), the documents that it adds,
- `gone`: (id, v), the documents that a deletion takes out: references of theirs from earlier changes don't count any more,
- `counts`: (k1, k2, n, last), after the change: how many documents hold the key and the largest id among them,
- `filters`: (shard, filter), after the change: a cuckoo filter of those keys of a shard that at least `min_docs` documents hold,
- `state`: (shards, min_chars, min_docs), written last: a change without it was broken off, is not seen and is made anew.

Inserting documents adds references and puts keys that reach `min_docs` into their shard's filter; deleting
documents recounts the keys concerned and takes keys that fall below out of it: that the filter allows
deletion is why it is a cuckoo filter. So dedup after a deletion is as if the documents had never been there. Opening a
folder goes on from its last change. The counts and filters of a change are deleted when two later ones are there.

Dedup probes every long line of every text in the filters; lines without a hit stay where they are. Only hits are
exchanged, to be decided by the exact counts, and only texts with a hit are joined with their decisions. Filters of up to
GROUP_SHARDS shards are sent to all at once. With more, the keys of the lines are written once, by group of
shards, and each group is probed with its own filters; no more than one group's are held at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.cuckoo import CuckooFilter
from millrace.llm.shared import broadcast_below, join_groups, small
from millrace.storage import children, cut, drop_table, exists, ship, write_table

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys that a filter shard is made for, and the shards whose filters (256 kB each) are sent to all at once.
SHARD_KEYS, GROUP_SHARDS = 1 << 16, 256
#: Rows of exact counts, and ids, that are broadcast at most.
BROADCAST_COUNTS, BROADCAST_IDS = 200_000, 500_000
_BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, None for a key of fewer than `min_chars` code points."""
    key = line.strip(_BLANKS).lower()  # bytes.lower() knows A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def keyed_lines(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [line_key(x, min_chars) if len(x) >= min_chars else None for x in lines]


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)


class LineDedup:
    """The state of incremental line dedup in the folder `path`, which all executors see; a folder that has one is gone on with."""

    def __init__(self, spark: SparkSession, path: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> None:
        self.spark, self.path, self.min_chars, self.min_docs = spark, path.rstrip("/"), min_chars, min_docs
        self.shards = 1
        done = [int(name[1:]) for name in children(spark, self.path) if name[1:].isdigit() and exists(spark, f"{self.path}/{name}/state/_SUCCESS")]
        self.version = max(done, default=0)
        if self.version:
            self.shards, *own = self._table("state").first()
            if own != [min_chars, min_docs]:
                raise ValueError(f"the state in {path} was made with min_chars, min_docs = {own}")
        ship(spark)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version}/{name}")

    def _every(self, name: str, schema: str) -> DataFrame:
        """A table of all changes together."""
        found = [p for p in (f"{self.path}/v{v}/{name}" for v in range(1, self.version + 1)) if exists(self.spark, p)]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _alive(self, table: DataFrame) -> DataFrame:
        """Rows of documents that no later change took out."""
        gone = self._every("gone", "id long, v int").groupBy("id").agg(F.max("v").alias("until"))
        return table.join(broadcast_below(cut(gone, "line-gone"), BROADCAST_IDS), "id", "left").where("until IS NULL OR v > until").drop("until")

    def _begin(self) -> int:
        drop_table(self.spark, f"{self.path}/v{self.version + 1}")  # what a change that was broken off left
        return self.version + 1

    def _write(self, df: DataFrame, name: str, version: int) -> DataFrame:
        where = f"{self.path}/v{version}/{name}"
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.parquet(where)

    def references(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(k1, k2, id): each key of each document once. Rows without id hold no keys."""
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                keys, ids = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = {k for k in keyed_lines(text, min_chars)[1] if k is not None}
                    keys += own
                    ids += [i] * len(own)
                half = _halves(keys)
                yield pa.RecordBatch.from_arrays([pa.array(half[:, 0]), pa.array(half[:, 1]), pa.array(ids, pa.int64())], names=["k1", "k2", "id"])

        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
        return rows.mapInArrow(run, "k1 long, k2 long, id long")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add the documents.

        Rows with equal ids are one document, also over several insertions: what is in already changes nothing, new lines
        are added. Rows without id and null texts hold no lines; an empty table adds nothing.
        """
        version = self._begin()
        new = self.references(docs, id_col, text_col).distinct().withColumn("v", F.lit(version))
        if self.version:
            new = cut(new, "line-new")
            known = self._alive(self._every("ids", "id long, v int")).select("id").distinct()
            again = cut(known.join(new.select("id").distinct(), "id", "left_semi"), "line-again")
            if not again.isEmpty():  # only documents that come again need their old references
                again = broadcast_below(again, BROADCAST_IDS)
                old = self._alive(self._every("refs", "k1 long, k2 long, id long, v int").join(again, "id", "left_semi"))
                new = cut(new.join(old.select("k1", "k2", "id"), ["k1", "k2", "id"], "left_anti"), "line-new")
        refs = self._write(new, "refs", version)
        self._write(refs.select("id", "v").distinct(), "ids", version)
        counts = refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        if self.version:
            counts = self._table("counts").unionByName(counts).groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        self._finish(counts, version)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take the documents with these ids out. Null ids, repeated ones and ids that are not in change nothing more."""
        if not self.version:
            return
        version = self._begin()
        gone = cut(ids.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct(), "line-gone")
        alive = self._alive(self._every("refs", "k1 long, k2 long, id long, v int")).select("k1", "k2", "id")
        sent = broadcast_below(gone, BROADCAST_IDS)
        touched = broadcast_below(cut(alive.join(sent, "id", "left_semi").select("k1", "k2").distinct(), "line-touched"), BROADCAST_COUNTS)
        left = alive.join(touched, ["k1", "k2"], "left_semi").join(sent, "id", "left_anti")
        again = left.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        counts = self._table("counts").join(touched, ["k1", "k2"], "left_anti").unionByName(again)
        self._write(gone.withColumn("v", F.lit(version)), "gone", version)
        self._finish(counts, version)

    def _finish(self, counts: DataFrame, version: int) -> None:
        counts = self._write(counts, "counts", version)
        droppable = counts.where(F.col("n") >= self.min_docs)
        need = max(1, -(-droppable.count() // SHARD_KEYS))
        shards = 1
        while shards < need:
            shards *= 2
        if not self.version or shards != self.shards:  # built anew from the exact counts
            filters, changes = None, droppable.select("k1", "k2", F.lit(1).alias("step"))
        else:
            filters = self._table("filters")
            was = self._table("counts").where(F.col("n") >= self.min_docs)
            up = droppable.join(was, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(1).alias("step"))
            down = was.join(droppable, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(-1).alias("step"))
            changes = down.unionByName(up)
        self._write(self._filters(filters, changes, shards), "filters", version)
        state = self.spark.createDataFrame([(shards, self.min_chars, self.min_docs)], "shards int, min_chars int, min_docs int")
        self._write(state.coalesce(1), "state", version)
        self.version, self.shards = version, shards
        for name in ("counts", "filters"):
            drop_table(self.spark, f"{self.path}/v{version - 2}/{name}")

    def _filters(self, filters: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
        """(shard, filter) after the changes; a shard's rows are streamed through its filter."""
        none = F.lit(None)
        rows = changes.select(F.pmod(F.col("k2"), F.lit(shards)).alias("shard"), "k1", "step", none.cast("binary").alias("filter"))
        if filters is not None:
            rows = rows.unionByName(filters.select("shard", none.cast("long").alias("k1"), F.lit(-2).alias("step"), "filter"))
        rows = rows.repartition("shard").sortWithinPartitions("shard", "step")

        def row(shard: int, held: CuckooFilter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([held.to_bytes()], pa.binary())], names=["shard", "filter"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held = None, None
            for batch in small(batches):
                own, step = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                k1 = batch.column(1).fill_null(0).to_numpy().view(np.uint64)
                for s in np.unique(own).tolist():
                    mine = np.flatnonzero(own == s)
                    if s != shard:
                        if held is not None:
                            yield row(shard, held)
                        shard, held = s, None
                    for i in mine[step[mine] == -2].tolist():
                        held = CuckooFilter.from_bytes(batch.column(3)[i].as_py())
                    held = held or CuckooFilter.for_keys(SHARD_KEYS * 3 // 2)
                    held.delete(k1[mine[step[mine] == -1]])
                    held.insert(k1[mine[step[mine] == 1]])
            if held is not None:
                yield row(shard, held)

        return rows.mapInArrow(run, "shard long, filter binary")

    def _group_filters(self, group: int) -> dict[int, bytes]:
        low = group * GROUP_SHARDS
        return {r.shard: bytes(r["filter"]) for r in self._table("filters").where(F.col("shard").between(low, low + GROUP_SHARDS - 1)).collect()}

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: bool = True) -> DataFrame:
        """id, n_lines, n_dropped, kept_sha256 and, with `text`, kept_text of every row of `docs`; its other columns play no part.

        A text is split at \\n; null or empty is one empty line. A line's key is the line without blanks at its ends
        and with A-Z lower-cased. Lines whose key has at least `min_chars` code points and is held by at least
        `min_docs` documents of the state go, but for those in the largest id that holds it; the others stay, joined by \\n. Rows with
        equal ids are one document; a row without id is none, but loses such lines as well. An empty table gives no rows, and a
        state without documents drops nothing.
        """
        min_chars, shards = self.min_chars, self.shards
        names = ["id", "text", "n_lines", "sha", "hits"]
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        hit_type = "array<struct<k1:long,k2:long>>"

        def sha_of(body: str | None) -> str:
            return hashlib.sha256((body or "").encode("utf-8", "surrogatepass")).hexdigest()

        def probe(held):
            """Rows with the keys that hit a filter; without filters all keys, to be probed later."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                filters = None if held is None else {s: CuckooFilter.from_bytes(f) for s, f in held.value.items()}
                for batch in small(batches):
                    texts = batch.column(1).to_pylist()
                    split = [keyed_lines(t, min_chars) for t in texts]
                    keys = [list({k for k in own if k is not None}) for _, own in split]
                    flat = _halves([k for own in keys for k in own])
                    hit = np.ones(len(flat), dtype=bool) if filters is None else _hits(filters, flat, shards)
                    ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int64)
                    hits = np.concatenate(([0], np.cumsum(hit)))[ends]
                    any_hit = (np.diff(hits) > 0).tolist()
                    pairs = pa.StructArray.from_arrays([pa.array(flat[hit, 0]), pa.array(flat[hit, 1])], names=["k1", "k2"])
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0), batch.column(1) if text else pa.array([t if h else None for t, h in zip(texts, any_hit)], pa.string()),
                        pa.array([len(lines) for lines, _ in split], pa.int64()), pa.array(
                            [None if h else sha_of(t) for t, h in zip(texts, any_hit)], pa.string()
                        ),
                        pa.ListArray.from_arrays(pa.array(hits.astype(np.int32)), pairs)], names=names)

            return run

        if not self.version:
            droppable = self.spark.createDataFrame([], "k1 long, k2 long, n long, last long")
        else:
            droppable = self._table("counts").where(F.col("n") >= self.min_docs)
        one_group = shards <= GROUP_SHARDS
        held = self.spark.sparkContext.broadcast(self._group_filters(0) if self.version else {}) if one_group else None
        probed = rows.mapInArrow(probe(held), f"id long, text string, n_lines long, sha string, hits {hit_type}")
        probed = cut(probed.withColumn("row", F.monotonically_increasing_id()), "line-probed")
        clean = probed.where("sha IS NOT NULL").select(
            "id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("sha").alias("kept_sha256"),
            F.coalesce("text", F.lit("")).alias("kept_text")
        )
        hits = probed.where("sha IS NULL")
        asked = hits.select("row", "id", F.explode("hits").alias("hit")).select("row", "id", "hit.k1", "hit.k2")
        if not one_group:
            asked = self._probe_groups(asked)
        decided = self._decide(asked, droppable.select("k1", "k2", "n", "last"))
        drops = decided.groupBy("row").agg(F.collect_list(F.struct("k1", "k2")).alias("drop"))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                gone, sha, kept_texts = [], [], []
                for body, drop in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                    lost = {(d["k1"], d["k2"]) for d in drop or []}
                    lines, keys = keyed_lines(body, min_chars)
                    own = [k is not None and tuple(np.frombuffer(k, "<i8").tolist()) in lost for k in keys] if lost else [False] * len(lines)
                    kept = b"\n".join([x for x, d in zip(lines, own) if not d])
                    gone.append(sum(own))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode("utf-8", "surrogatepass"))
                own = [pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_texts, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *own], names=["id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])

        cleaned = hits.select("row", "id", "text", "n_lines").join(drops, "row", "left").select("id", "text", "n_lines", "drop")
        cleaned = cleaned.mapInArrow(keep, "id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
        out = clean.unionByName(cleaned).withColumnRenamed("id", id_col)
        return out if text else out.drop("kept_text")

    def _probe_groups(self, keys: DataFrame) -> DataFrame:
        """Those of the line keys (row, id, k1, k2) that hit a filter, a group of shards after the other."""
        shards, spark = self.shards, self.spark
        group = F.floor(F.pmod(F.col("k2"), F.lit(shards)) / GROUP_SHARDS).cast("int")
        path = write_table(keys.withColumn("group", group), "line-keys", ["group"])
        found = []
        for g in range(-(-shards // GROUP_SHARDS)):
            if not exists(spark, f"{path}/group={g}"):
                continue
            held = spark.sparkContext.broadcast(self._group_filters(g))

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                filters = {s: CuckooFilter.from_bytes(f) for s, f in held.value.items()}
                for batch in small(batches):
                    flat = np.column_stack([batch.column(k).to_numpy() for k in (2, 3)])
                    yield batch.filter(pa.array(_hits(filters, flat, shards)))

            part = spark.read.schema(keys.schema).parquet(f"{path}/group={g}")
            found.append(cut(part.mapInArrow(run, keys.schema), "line-hits"))
            held.destroy()
        out = found[0] if found else keys.limit(0)
        for part in found[1:]:
            out = out.unionByName(part)
        return out

    def _decide(self, asked: DataFrame, droppable: DataFrame) -> DataFrame:
        """(row, k1, k2) of the hits that go. The few keys that very many documents hold are sent to all, so their rows are not exchanged."""
        droppable = cut(droppable, "line-droppable")
        rows, total = droppable.agg(F.count(F.lit(1)), F.sum("n")).first()
        keys = ["k1", "k2"]
        if rows <= BROADCAST_COUNTS:
            return asked.join(F.broadcast(droppable), keys).where("id IS NULL OR id <> last")
        return join_groups(asked, droppable, keys, "n", total).where("id IS NULL OR id <> last")


def _hits(filters: dict[int, CuckooFilter], keys: np.ndarray, shards: int) -> np.ndarray:
    """Which of the keys (k1, k2) their shard's filter knows."""
    hit, shard = np.zeros(len(keys), dtype=bool), keys[:, 1] % shards
    for s in np.unique(shard).tolist():
        if s in filters:
            mine = np.flatnonzero(shard == s)
            hit[mine] = filters[s].contains(keys[mine, 0].view(np.uint64))
    return hit


def dedup_lines(docs: DataFrame, state: str, id_col: str = "doc_id", text_col: str = "text", text: bool = True) -> DataFrame:
    """Dedup the lines of one table against itself: a new state at `state`, filled with `docs`. The cases are those of `LineDedup.dedup`."""
    lines = LineDedup(docs.sparkSession, state)
    if lines.version:
        raise ValueError(f"{state} has documents already")
    lines.insert(docs, id_col, text_col)
    return lines.dedup(docs, id_col, text_col, text)
