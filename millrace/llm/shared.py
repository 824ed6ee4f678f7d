"""What the operators of this subpackage have in common: slices of Arrow batches, checked broadcasts, columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python step takes at once. Texts of 100 kB and more occur, so it is kept small: arrays made from a text
#: are larger than the text.
STEP_ROWS = 256


def small(batches: Iterator[pa.RecordBatch], rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, which share their memory; how many rows a batch has is the session's choice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """`df`, a cut table, marked for broadcast if it has at most so many rows; joined by exchange otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


#: A group with over 1/HOT_GROUPS of the rows is hot; there are fewer than HOT_GROUPS such groups.
HOT_GROUPS = 1024


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """`rows`, of which there are `total`, joined with what `groups`, a cut table, has for their group; `size` are the groups' row counts.

    The few hot groups are sent to all, so their rows stay where they are; the rest are exchanged. `how` is inner or left.
    """
    bound = max(2, total // HOT_GROUPS)
    hot, cold = F.broadcast(groups.where(F.col(size) > bound).drop(size)), groups.where(F.col(size) <= bound).drop(size)
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys, how))


def ascii_lower(column: Column | str, spark: SparkSession) -> Column:
    """Lower-case A-Z and nothing else.

    `translate` walks a text character by character through a dictionary; the static method that the
    SQL function `reflect` calls does the same in a tenth of the time. Where its class is missing,
    `translate` is used.
    """
    column = F.col(column) if isinstance(column, str) else column
    try:
        spark._jvm.java.lang.Class.forName("com.google.common.base.Ascii", False, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    except Exception:  # py4j wraps ClassNotFoundException
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return F.translate(column, upper, upper.lower())
    return F.reflect(F.lit("com.google.common.base.Ascii"), F.lit("toLowerCase"), column)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like `wanted` that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
