"""Running sums, ranks and percentiles in the order of a value, for groups that no single task should hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import cut

#: Rows from which the values of a feature are dealt into buckets, and the buckets.
BUCKET_ROWS, BUCKETS = 1_000_000, 64


def bucket_bounds(rows: DataFrame, d: int, column: str = "x") -> list[list[float]] | None:
    """Bounds of about equal buckets for each of the d entries of the array column; None below BUCKET_ROWS rows."""
    if rows.limit(BUCKET_ROWS + 1).count() <= BUCKET_ROWS:
        return None
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    found = rows.agg(*[F.percentile_approx(F.get(column, F.lit(j)), shares).alias(f"b{j}") for j in range(d)]).first()
    return [sorted(set(found[j])) for j in range(d)]


def running_sums(values: DataFrame, group: list[str], sums: list[str], bounds: list[list[float]] | None) -> DataFrame:
    """For rows of distinct v in each group: group, v, nxt (the next v), and for each of `sums` its own, upto_ (v included) and all_.

    With bounds (for the column f of the group), a task holds one bucket of a group; what lies before comes from the buckets' totals.
    """
    if bounds is None:
        upto = Window.partitionBy(*group).orderBy("v")
        running, whole = upto.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*group)
        before_own = [F.sum(s).over(running).alias(f"upto_{s}") for s in sums]
        return values.select(*group, "v", *sums, F.lead("v").over(upto).alias("nxt"), *before_own, *[F.sum(s).over(whole).alias(f"all_{s}") for s in sums])
    edges = F.get(F.array(*[F.array(*[F.lit(float(b)) for b in own]) for own in bounds]), F.col("f"))
    dealt = values.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("v"))))
    keys = [*group, "bucket"]
    order = Window.partitionBy(*group).orderBy("bucket")
    totals = dealt.groupBy(*keys).agg(F.min("v").alias("low"), *[F.sum(s).alias(s) for s in sums])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    before_bucket = [F.coalesce(F.sum(s).over(before), F.lit(0.0)).alias(f"before_{s}") for s in sums]
    whole = [F.sum(s).over(Window.partitionBy(*group)).alias(f"all_{s}") for s in sums]
    totals = totals.select(*keys, F.lead("low").over(order).alias("low"), *before_bucket, *whole)
    own = Window.partitionBy(*keys).orderBy("v")
    running = own.rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(totals, keys).select(
        *group, "v", *sums, F.coalesce(F.lead("v").over(own), F.col("low")).alias("nxt"),
        *[(F.col(f"before_{s}") + F.sum(s).over(running)).alias(f"upto_{s}") for s in sums], *[f"all_{s}" for s in sums])


def ranked(df: DataFrame, order: list[Column], by: str | None = None, rank: str = "rank", size: str | None = None) -> DataFrame:
    """`df` with the place of each row, from 0, in the given order, within each value of `by` if given; `size` counts its rows.

    No single task ranks all rows: they are dealt into ordered ranges, ranked in each, and shifted by the sizes of the ranges
    before, of which there is a row for each task and value. Equal rows come in any order.
    """
    first = [F.col(by)] if by else []
    keys = ["__range", *([by] if by else [])]
    ranged = df.repartitionByRange(*first, *order).withColumn("__range", F.spark_partition_id())
    # kept as it is: dealt again, the ranges could have other bounds
    ranged = cut(ranged.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1), "ranked")
    sizes = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    before = own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col(by).eqNullSafe(F.col("__by")) if by else F.lit(True)
    shifts = sizes.select(
        F.col("__range").alias("__of"), *([F.col(by).alias("__by")] if by else []),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"), F.sum("n").over(own).alias("__all"))
    out = ranged.join(F.broadcast(shifts), (F.col("__range") == F.col("__of")) & same)
    out = out.withColumn(rank, F.col("__before") + F.col("__place"))
    if size:
        out = out.withColumn(size, F.col("__all"))
    return out.drop("__range", "__of", "__by", "__place", "__before", "__all")


def exact_percentile(df: DataFrame, column: Column, share: float) -> float | None:
    """The value at `share` of the way through the sorted values, interpolated; None without values.

    Values are counted first, and the counts summed up in buckets where there are many.
    """
    values = df.select(column.cast("double").alias("v")).where("v IS NOT NULL").withColumn("f", F.lit(0))
    bounds = bucket_bounds(values.select(F.array("v").alias("x")), 1)
    counted = cut(running_sums(values.groupBy("f", "v").agg(F.count(F.lit(1)).cast("double").alias("n")), ["f"], ["n"], bounds), "percentile")
    total = counted.agg(F.max("all_n")).first()[0]
    if not total:
        return None
    place = share * (total - 1)
    low, high = math.floor(place), math.ceil(place)
    found = counted.agg(*[F.min(F.when(F.col("upto_n") > k, F.col("v"))) for k in (low, high)]).first()
    return found[0] if low == high else (high - place) * found[0] + (place - low) * found[1]
