"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every normalised text to a cell of a sparse filter of CELLS_PER_ROW cells a row, which is never in one place:
what falls into each cell is counted in each task and then over all, so a text that a third of all rows share
sends one row a task, and any other one count. Cells hit at least twice are those of *possibly repeated* hashes, and
go into a Bloom filter of BITS_PER_CELL bits each, which is what is broadcast: it grows with what repeats, not with the rows.
Pass 2 probes it: a row with a clear bit cannot have a twin and goes straight to
the result. Only the others, the twins and a few false positives, are exchanged by their SHA-256,
where they are grouped exactly.

The filter has at most `max_bits` bits (2^30: 128 MB, enough for 67 million repeated cells). Beyond, more and more rows
without a twin take the exchange, nearly all from four times as many repeated cells on; the result is the same.

Of the exchanged rows, groups of more than 1/1024 of them are at most 1024 by count, so their
decisions are broadcast and the rows of such a group stay where they are; the rest are joined by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import HOT_GROUPS, ascii_lower, fresh
from millrace.storage import cut

#: Cells of the sparse filter for each row; bits of the Bloom filter for each repeated cell, and the most it may have.
CELLS_PER_ROW, BITS_PER_CELL, MAX_BITS = 64, 16, 1 << 30


def _power(least: int, low: int) -> int:
    while low < least:
        low *= 2
    return low


def repeated_cells(hashed: DataFrame, hash_col: str, rows: int) -> DataFrame:
    """(cell): the cells that at least two rows hit."""
    cell = F.col(hash_col).bitwiseAND(F.lit(_power(CELLS_PER_ROW * rows, 1 << 15) - 1))
    return hashed.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("hits")).where("hits > 1").select("cell")


def bloom_filter(cells: DataFrame, bits: int) -> DataFrame:
    """A Bloom filter of the cells as bitmaps: (bucket long, bits binary), at most bits/8 bytes."""
    position = F.explode(F.array(*_positions(F.col("cell"), bits))).alias("position")
    marked = cells.select(position).groupBy(F.bitmap_bucket_number("position").alias("bucket"))
    return marked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bits"))


def _positions(cell: Column, bits: int) -> list[Column]:
    h, mask = F.xxhash64(cell), F.lit(bits - 1)
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]


def _bit(bits: Column, cell: Column) -> Column:
    """Whether the bitmap has the cell's bit; a bucket without bitmap has no bit."""
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """Mark the copies among `docs`.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays (a null id is below all others); of rows that share text and id, one.
    Returns the `carry` columns (all by default) of every row, with `keep_id`, `group_size`, `kept` and
    `text_sha256`; where `docs` has such a name, ours gets a leading underscore. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    extra = fresh(docs, "keep_id", "group_size", "kept", "text_sha256")
    # carried columns go by their number until the end, so no name of ours can meet one of theirs
    own = [f"c{i}" for i in range(len(carry))]

    def named(keep_id: Column, size: Column, kept: Column) -> list[Column]:
        found = (keep_id, size, kept, F.col("sha"))
        return [*[F.col(c).alias(name) for c, name in zip(own, carry)], *[c.alias(name) for c, name in zip(found, extra)]]

    rows = docs.select(F.lit(1)).count()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    source = docs.select(*[docs[c].alias(name) for c, name in zip(carry, own)], docs[id_col].alias("id"), ascii_lower(text, spark).alias("norm"))
    hashed = docs.select(ascii_lower(text, spark).alias("norm")).select(F.xxhash64("norm").alias("h"))
    cells = cut(repeated_cells(hashed, "h", rows), "exact-cells")
    bits = min(_power(BITS_PER_CELL * cells.count(), 1 << 15), max_bits)
    bitmaps = F.broadcast(cut(bloom_filter(cells, bits), "exact-filter"))

    cell = F.xxhash64("norm").bitwiseAND(F.lit(_power(CELLS_PER_ROW * rows, 1 << 15) - 1))
    probed = source.withColumn("cell", cell).withColumn("sha", F.sha2("norm", 256)).drop("norm")
    first, second = _positions(F.col("cell"), bits)
    probed = probed.withColumn("k1", F.bitmap_bucket_number(first)).withColumn("k2", F.bitmap_bucket_number(second))
    probed = probed.join(bitmaps.select(F.col("bucket").alias("k1"), F.col("bits").alias("b1")), "k1", "left")
    probed = probed.join(bitmaps.select(F.col("bucket").alias("k2"), F.col("bits").alias("b2")), "k2", "left")
    probed = probed.withColumn("likely", _bit(F.col("b1"), first) & _bit(F.col("b2"), second)).drop("k1", "k2", "b1", "b2", "cell")

    straight = probed.where(~F.col("likely")).select(*named(F.col("id"), F.lit(1).cast("long"), F.lit(True)))
    exchanged = cut(probed.where("likely").withColumn("row", F.monotonically_increasing_id()).drop("likely"), "exact-likely")
    # the row that stays: one of the largest id; where no row of a group has an id, any
    keeper = F.coalesce(F.max_by("row", "id"), F.max("row")).alias("keeper")
    groups = cut(exchanged.groupBy("sha").agg(F.max("id").alias("best"), keeper, F.count(F.lit(1)).alias("n")), "exact-groups")
    bound = max(2, exchanged.count() // HOT_GROUPS)
    hot = groups.where(F.col("n") > bound).select(
        F.col("sha").alias("hot"), F.col("best").alias("hot_best"), F.col("keeper").alias("hot_keeper"), F.col("n").alias("hot_n")
    )
    cold = groups.where(F.col("n") <= bound).select(F.col("sha").alias("cold"), "best", "keeper", "n")
    met = exchanged.join(F.broadcast(hot), F.col("sha") == F.col("hot"), "left")
    # a row whose group is hot has found its decision; its own number spreads it over the partitions of the second join
    met = met.withColumn("key", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("#"), F.col("row").cast("string"))))
    met = met.join(cold, F.col("key") == F.col("cold"), "left")
    kept = F.coalesce("hot_keeper", "keeper") == F.col("row")
    # a hot group may have no id at all, so its best may be null
    decided = met.select(*named(F.coalesce("hot_best", "best"), F.coalesce("hot_n", "n"), kept))
    return straight.unionByName(decided)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without its copies, in its own columns, whatever their names. The cases are those of `exact_dedup`."""
    kept = fresh(docs, "kept")[0]
    return exact_dedup(docs, id_col, text_col).where(F.col(kept)).select(*docs.columns)
