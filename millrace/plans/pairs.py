"""Pairs of rows in blocks: every row against every row of an index side.

An index of up to INDEX_ROWS rows is sent to all and the rows stay where they are. A larger one is dealt into blocks, as are the
rows; blocks meet pairwise on the executors, and what each pair of blocks gives is merged by id. Neither side goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core import matrix_of
from millrace.storage import cut, ship

#: Rows of an index that is sent to all, and of a block of a larger one; with 64 features it is 10 MB.
INDEX_ROWS = 20_000

#: From an index as a table with the columns it was given, and a batch of rows, to what the batch's rows get.
Work = Callable[[pa.Table, pa.Table], pa.Table]


def against_index(rows: DataFrame, index: DataFrame, work: Work, schema: str, most: int = INDEX_ROWS) -> tuple[DataFrame, bool]:
    """What `work` gives for batches of `rows` and the index or blocks of it, and whether there was more than one block."""
    spark = rows.sparkSession
    ship(spark)
    index = cut(index, "index")
    total = index.count()
    if total <= most:
        held = spark.sparkContext.broadcast(index.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    yield from work(held.value, pa.Table.from_batches([batch])).to_batches()

        return rows.mapInArrow(run, schema), False
    blocks, row_blocks = -(-total // most), max(1, -(-rows.count() // most))

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.withColumn("__row", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int")).withColumn("__block", numbers(blocks))
    right = index.withColumn("__block", F.pmod(F.xxhash64(*index.columns), F.lit(blocks)).cast("int")).withColumn("__row", numbers(row_blocks))

    def meet(own: pa.Table, block: pa.Table) -> pa.Table:
        own, block = own.drop_columns(["__row", "__block"]), block.drop_columns(["__row", "__block"])
        found = [work(block, own.slice(at, 1024)) for at in range(0, own.num_rows, 1024)] if block.num_rows else []
        return pa.concat_tables(found) if found else empty

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(spark.createDataFrame([], schema).schema).empty_table()
    return left.groupBy("__row", "__block").cogroup(right.groupBy("__row", "__block")).applyInArrow(meet, schema), True


def _matrix(table: pa.Table, name: str, width: int) -> np.ndarray:
    return matrix_of(table.column(name).combine_chunks(), width)


def blocked_sums(
    rows: DataFrame, index: DataFrame, width: int, sums: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int,
    most: int = INDEX_ROWS
) -> DataFrame:
    """(id, label, sums) of every row (id, label, x): the sum over the index (x, code from 1) of what `sums` gives for matrices."""

    def work(index: pa.Table, own: pa.Table) -> pa.Table:
        other, code = _matrix(index, "x", width), index.column("code").to_numpy().astype(int) - 1
        x = _matrix(own, "x", width)
        found = np.concatenate([sums(x[at : at + 256], other, code) for at in range(0, len(x), 256)])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(found.ravel()))
        return pa.table({"id": own.column("id"), "label": own.column("label"), "sums": lists})

    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, sums array<double>"
    out, many = against_index(rows.select("id", "label", "x"), index, work, schema, most)
    if not many:
        return out
    parts = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(size)]
    return out.groupBy("id", "label").agg(*parts).select("id", "label", F.array(*[f"s{k}" for k in range(size)]).alias("sums"))


def distances(x: np.ndarray, other: np.ndarray, metric: str) -> np.ndarray:
    """Distances by differences, not by the expanded square, so that equal rows are at 0."""
    if metric == "manhattan":
        return np.abs(x[:, None, :] - other[None, :, :]).sum(axis=2)
    return np.sqrt(((x[:, None, :] - other[None, :, :]) ** 2).sum(axis=2))
