"""Near-duplicate groups by b-bit MinHash.

1. Sketch (one pass over whole texts, no exchange): distinct word shingles as 64-bit hashes, 128 minima,
   32 band keys of 4 minima each, and the low 4 bits of each minimum packed into 64 bytes (Li and
   König, "b-Bit Minwise Hashing", 2010). A pair at the threshold 0.75 shares no band with a chance of
   (1 - 0.75^4)^32 = 5e-6.
2. Texts with equal shingle sets form a class, whose smallest id represents it; only representatives go on,
   so copies never meet each other.
3. Star candidates: each representative with the smallest one of each of its buckets. The similarity is
   estimated from the count of equal b-bit values, corrected for chance collisions; what lies within
   five standard errors of the threshold is confirmed on the full sets of both texts. A text that very many are to be
   compared with goes along with parts of them: the pairs of such a hub are dealt by HUB_PAIRS, and its set of shingles is sent once a part.
4. Links give components. Buckets whose members now all lie in one component are done, as their
   other links would join nothing new. In the rest, members of different components are compared by
   bit counts in tiles of bounded size. Members of a passing pair are sent with their texts to the same tile, where
   the pairs are confirmed on full sets, each in the first band that it shares; only links leave a tile, and none
   between rows that it has already joined. Nothing is capped.
5. Components of all links; the label is the smallest id of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import broadcast_below, fresh, join_groups, small
from millrace.llm.textkit import mix, shingles, text_slices, words
from millrace.plans.closure import components
from millrace.storage import cut, ship

SHINGLE, PERMUTATIONS, BAND_ROWS, BITS = 5, 128, 4, 4
BANDS = PERMUTATIONS // BAND_ROWS
#: Shingles hashed at once, so that what the permutations touch stays in the cache.
BLOCK = 1 << 15
#: Representatives of a bucket, and shingles in them, that make a block; larger buckets are cut into tiles of two blocks.
TILE, TILE_SHINGLES = 512, 1 << 20
#: Pairs of a tile from which their intersections are counted together by matrix products, and the columns of a product.
DENSE_PAIRS, DENSE_COLUMNS = 256, 4096
#: Pairs of a hub that are confirmed in one part, and hubs whose part counts are broadcast at most.
HUB_PAIRS, BROADCAST_HUBS = 128, 1_000_000
#: Ids of documents to confirm are broadcast up to this count (8 bytes each), and joined by exchange beyond it.
BROADCAST_IDS = 500_000

_draw = np.random.default_rng(20250101)
_A = _draw.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _draw.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_SALT = _draw.integers(0, 1 << 63, (BANDS, BAND_ROWS + 1), dtype=np.uint64) | np.uint64(1)
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def minima(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The PERMUTATIONS minima of each set; sets lie end to end, an empty one gets the largest value."""
    out = np.full((len(ends) - 1, PERMUTATIONS), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(ends))
    small = (sets >> np.uint64(32)).astype(np.uint32)
    at = 0
    while at < len(full):
        stop = at + 1
        while stop < len(full) and ends[full[stop] + 1] - ends[full[at]] <= BLOCK:
            stop += 1
        rows = full[at:stop]
        part = small[ends[rows[0]] : ends[rows[-1] + 1]]
        starts = ends[rows] - ends[rows[0]]
        for k in range(PERMUTATIONS):
            out[rows, k] = np.minimum.reduceat(part * _A[k] + _B[k], starts)
        at = stop
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = mins.reshape(len(mins), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(_SALT[:, BAND_ROWS], rows.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key += mix(rows[:, :, k] * _SALT[:, k] + _SALT[:, BAND_ROWS])
        key = mix(key)
    return key.view(np.int64)


def packed_bits(mins: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, two minima a byte."""
    low = ((mins * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)
    return (low[:, 0::2] << BITS) | low[:, 1::2]


def equal_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many b-bit values agree, over the last axis of packed signatures: by bit counts."""
    x = a ^ b
    x |= x >> 1
    x |= x >> 2
    return PERMUTATIONS - _POP[x & 0x11].sum(axis=-1, dtype=np.int32)


def least_equal(similarity: float) -> float:
    """Count of equal values from which a pair may have the similarity: corrected for chance, less five errors."""
    chance = 1 / (1 << BITS)
    p = similarity + (1 - similarity) * chance
    return PERMUTATIONS * p - 5 * (PERMUTATIONS * p * (1 - p)) ** 0.5


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        ids = batch.column(0)
        for row, raw, offsets in text_slices(batch.column(1)):
            hashes, _, _, bounds = words(raw, offsets)
            sets, ends = shingles(hashes, bounds, SHINGLE)
            mins, n = minima(sets, ends), np.diff(ends)
            total = np.zeros((2, len(sets) + 1), dtype=np.uint64)
            np.cumsum(mix(sets), dtype=np.uint64, out=total[0, 1:])
            np.cumsum(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64, out=total[1, 1:])
            keys = np.empty((len(n), 2), dtype=np.uint64)
            for k in range(2):
                keys[:, k] = total[k][ends[1:]] - total[k][ends[:-1]]
            yield pa.RecordBatch.from_arrays([
                ids.slice(row, len(n)),
                pa.array(n),
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary()),
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(BANDS * 2), len(n), [None, pa.py_buffer(packed_bits(mins).tobytes())]).cast(pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(mins).ravel())),
            ], names=["id", "n", "key", "bits", "bands"])


def _similar(n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sizes alone allow the similarity."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * 2) for k in (2, 3))
            yield batch.filter(pa.array(equal_values(a, b) >= least)).select([0, 1])
    return run


def _by_tile(work, names: list[str]):
    """Run `work` on the table of each tile; rows come sorted by (band, x, y), and a tile may span batches."""

    def done(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        key = np.stack([table.column(k).to_numpy() for k in range(3)])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        found = [work(table.slice(s, e - s)) for s, e in zip([0, *new.tolist()], [*new.tolist(), table.num_rows]) if e - s > 1]
        found = [f for f in found if f is not None]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(len(names))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in small(batches):
            if not len(batch):
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)])
            other = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            whole = int(other[-1]) + 1 if len(other) else 0  # up to here all tiles are complete
            if whole:
                yield from done([*held, batch.slice(0, whole)])
                held = []
            elif held and [held[-1].column(k)[0].as_py() for k in range(3)] != key[:, -1].tolist():
                yield from done(held)
                held = []
            held.append(batch.slice(whole))
        if held:
            yield from done(held)

    return run


def _passing(table: pa.Table, least: float, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of a tile in different components that pass the estimate.

    Columns: band, x, y, side, id, comp, n, bits; in a tile of two blocks only pairs across them count.
    """
    x, y, side, comp, n = (table.column(k).to_numpy() for k in (1, 2, 3, 5, 6))
    bits = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(-1, BANDS * 2)
    diagonal = x[0] == y[0]
    i, j = (np.arange(len(n)), np.arange(len(n))) if diagonal else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    step = max(1, (1 << 16) // max(1, len(j)))
    for at in range(0, len(i), step):
        own = i[at : at + step]
        ok = comp[own, None] != comp[None, j]
        if diagonal:
            ok &= own[:, None] < j[None, :]
        ok &= np.minimum(n[own, None], n[None, j]) * 100 >= np.maximum(n[own, None], n[None, j]) * percent
        p, q = np.nonzero(ok)
        if len(p):
            p, q = own[p], j[q]
            good = equal_values(bits[p], bits[q]) >= least
            yield p[good], q[good]


def _involved(least: float, percent: int):
    """Rows of each tile that are in a passing pair: band, x, y, side, id, comp, n."""

    def work(table: pa.Table):
        hit = np.zeros(table.num_rows, dtype=bool)
        for p, q in _passing(table, least, percent):
            hit[p] = hit[q] = True
        return [table.column(k).to_numpy()[hit] for k in range(7)] if hit.any() else None

    return _by_tile(work, ["band", "x", "y", "side", "id", "comp", "n"])


def _tile_links(least: float, percent: int):
    """Links of each tile between different components; further columns: bands, text."""

    def work(table: pa.Table):
        band, ids, comp = table.column(0)[0].as_py(), table.column(4).to_numpy(), table.column(5).to_numpy()
        bands = table.column(8).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        p, q = (np.concatenate(x) for x in zip(*[(np.zeros(0, np.int64),) * 2, *_passing(table, least, percent)]))
        first = (bands[p] == bands[q]).argmax(axis=1)
        mine = bands[p, first] == band
        p, q = p[mine], q[mine]
        if not len(p):
            return None
        sets = _sets(table.column(9).combine_chunks())
        size = np.array([len(x) for x in sets])
        both = _intersections(sets, p, q)
        good = 100 * both >= percent * (size[p] + size[q] - both)
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        u, v = [], []
        for a, b in zip(p[good].tolist(), q[good].tolist()):
            ca, cb = root(int(comp[a])), root(int(comp[b]))
            if ca != cb:
                joined[max(ca, cb)] = min(ca, cb)
                u.append(int(ids[a]))
                v.append(int(ids[b]))
        return [np.array(u, dtype=np.int64), np.array(v, dtype=np.int64)] if u else None

    return _by_tile(work, ["u", "v"])


def _intersections(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets."""
    if len(p) < DENSE_PAIRS:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(p.tolist(), q.tolist())])
    rows, left = np.unique(p, return_inverse=True)
    cols, right = np.unique(q, return_inverse=True)
    used = np.union1d(rows, cols)
    _, column, count = np.unique(np.concatenate([sets[k] for k in used.tolist()]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used.tolist()])
    shared = count[column] > 1  # what one set alone has is in no intersection
    dense = np.cumsum(count > 1) - 1
    owner, column = owner[shared], dense[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(rows), len(cols)), dtype=np.float32)
    r, c = np.searchsorted(used, rows), np.searchsorted(used, cols)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, DENSE_COLUMNS):
        s, e = np.searchsorted(column, (at, at + DENSE_COLUMNS))
        x = np.zeros((len(used), DENSE_COLUMNS), dtype=np.float32)
        x[owner[s:e], column[s:e] - at] = 1
        total += x[r] @ x[c].T
    return total[left, right].astype(np.int64)


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The full shingle set of each text, sorted."""
    out = []
    for _, raw, offsets in text_slices(column):
        hashes, _, _, bounds = words(raw, offsets)
        found, ends = shingles(hashes, bounds, SHINGLE)
        out += [found[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return out


def _confirmed(percent: int):
    """Pairs (u, v) whose full shingle sets have the similarity.

    Rows (v, part, kind, id, text) come sorted: the texts of a hub v (kind 0), then those to compare with it, part by part. A
    hub's sets are held while its part goes by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hub = None, []
        for batch in small(batches):
            u, v = [], []
            sets = _sets(batch.column(4))
            for own, part, kind, i, a in zip(*(batch.column(k).to_pylist() for k in range(4)), sets):
                if current != (own, part):
                    current, hub = (own, part), []
                if kind == 0:
                    hub.append(a)
                elif len(a) and any(_linked(a, b, percent) for b in hub if len(b)):
                    u.append(i)
                    v.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _fetch(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of `docs` (id, text) with the ids, by broadcast of the ids up to a count."""
    ids = broadcast_below(cut(ids.distinct(), "near-involved"), BROADCAST_IDS)
    return docs.join(ids, "id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (u, v), a cut table, whose texts in `docs` (id, text) have the similarity, by full sets.

    v may be a hub that very many pairs share: they are dealt into parts, and the hub's text goes to each part once.
    """
    texts = cut(_fetch(pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).withColumnRenamed("u", "id"), docs), "near-texts")
    hubs = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("parts"))
    hubs = cut(hubs, "near-hubs")
    large = broadcast_below(cut(hubs.where("parts > 1"), "near-large-hubs"), BROADCAST_HUBS)
    part = F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part")
    asked = pairs.join(large, "v", "left").select("v", part, F.lit(1).alias("kind"), F.col("u").alias("id")).join(texts, "id")
    of_hub = hubs.withColumn("id", F.col("v")).join(texts, "id")
    of_hub = of_hub.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "id", "text")
    rows = asked.select("v", "part", "kind", "id", "text").unionByName(of_hub)
    rows = rows.repartition("v", "part").sortWithinPartitions("v", "part", "kind")
    return cut(rows.mapInArrow(_confirmed(percent), "u long, v long").distinct(), "near-links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Groups of texts linked by a Jaccard similarity of `percent`/100 or more of their word shingles.

    Words are runs outside [\\x20\\x09-\\x0D] with A-Z lower-cased; a set is the distinct 5-word shingles, or the
    whole sequence of a shorter text. A text without words, or null, is linked with nothing. Returns id,
    n_shingles, component_id (smallest id reachable) and kept for every row. Rows that repeat an id are one document: what any
    of their texts is linked with is in the group of all. A row without id is alone, with component_id null and kept true. Other
    columns play no part, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = cut(texts.mapInArrow(_sketches, "id long, n long, key binary, bits binary, bands array<long>"), "near-sketch")
    least = least_equal(percent / 100)

    usable = sketch.where("id IS NOT NULL AND n > 0")
    classes = cut(usable.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")), "near-classes")
    reps = usable.join(classes.select("key", F.col("rep").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["id", "key"])
    reps = cut(reps.select("id", "n", "bits", "bands"), "near-reps")
    count = reps.count()
    members = reps.select(F.explode("bands").alias("band"), "id", "n")
    buckets = members.groupBy("band").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(join_groups(members, cut(buckets, "near-buckets"), ["band"], "size", BANDS * count), "near-members")

    def side(name: str) -> DataFrame:
        return reps.select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.col("bits").alias(f"b{name}"))

    star = cut(members.where("id <> v").select(F.col("id").alias("u"), "v").distinct(), "near-pairs")
    hubs = cut(star.groupBy("v").agg(F.count(F.lit(1)).alias("size")).join(side("v"), "v"), "near-sides")
    star = join_groups(star.join(side("u"), "u"), hubs, ["v"], "size", star.count()).where(_similar(F.col("nu"), F.col("nv"), percent))
    star = cut(star.select("u", "v", "bu", "bv").mapInArrow(_estimated(least), "u long, v long").distinct(), "near-star")
    # an id with several texts joins their classes
    several = usable.select("id", "key").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("keys")).where("keys > 1").select("id")
    own = usable.join(several, "id", "left_semi").select("id", "key").distinct().join(classes.select("key", "rep"), "key")
    links = confirm(star, texts, percent).unionByName(own.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    links = cut(links, "near-joined")
    first = components(links)

    # buckets that still hold several components
    labelled = members.select("band", "id", "n").join(first.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.select("band", "id", "n", F.coalesce("component", "id").alias("comp"))
    labelled = cut(labelled, "near-labelled")
    mixed = labelled.groupBy("band").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")
    ).where("lo < hi")
    mixed = mixed.select("band", F.ceil(F.greatest(F.col("size") / TILE, F.col("n") / TILE_SHINGLES)).alias("blocks"))
    open_rows = labelled.drop("n").join(mixed, "band").join(reps.select("id", "n", "bits"), "id")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    open_rows = open_rows.select("band", "id", "comp", "n", "bits", "blocks", block)
    # a member of block i belongs to the tiles (i, j >= i) and (j <= i, i)
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(j, F.col("block")).alias("x"), F.greatest(j, F.col("block")).alias("y"),
        F.when(F.col("block") <= j, 0).otherwise(1).alias("side"))))
    tiled = open_rows.withColumn("tile", tile).select("band", "tile.x", "tile.y", "tile.side", "id", "comp", "n", "bits")
    schema = "band long, x long, y long, side int, id long, comp long, n long"
    tiled = tiled.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    involved = cut(tiled.mapInArrow(_involved(least, percent), schema), "near-open")
    if involved.isEmpty():
        linked = first
    else:
        texts = cut(_fetch(involved.select("id"), texts).join(reps.select("id", "bits", "bands"), "id"), "near-texts")
        full = involved.join(texts, "id").select(*involved.columns, "bits", "bands", "text")
        full = full.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
        more = cut(full.mapInArrow(_tile_links(least, percent), "u long, v long"), "near-more")
        linked = components(links.unionByName(more))

    named = classes.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.where("size > 1 OR component IS NOT NULL").select("key", F.coalesce("component", "rep").alias("component_id"), "size")
    rows = sketch.select("id", F.col("n").alias("n_shingles"), F.when(F.expr("id IS NOT NULL AND n > 0"), F.col("key")).alias("key"))
    # a key of its own spreads the rows that are in no class
    rows = rows.withColumn("key", F.coalesce("key", F.encode(F.concat(F.lit("alone"), F.coalesce(F.col("id").cast("string"), F.lit(""))), "utf-8")))
    rows = join_groups(rows, cut(named, "near-named"), ["key"], "size", sketch.count(), "left")
    component = F.coalesce("component_id", "id").alias("component_id")
    return rows.select(F.col("id").alias(id_col), "n_shingles", component).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """`docs` with one row of each group, the one of the smallest id, in its own columns, whatever their names.

    Rows that repeat that id all stay, as do rows without id or words.
    """
    gone = fresh(docs, "gone")[0]
    lost = near_groups(docs, id_col, text_col, percent).where("NOT kept").select(F.col(id_col).alias(gone)).distinct()
    lost = broadcast_below(cut(lost, "near-gone"), BROADCAST_IDS)
    return docs.join(lost, docs[id_col] == lost[gone], "left_anti")
