"""Samples with replacement of exactly as many rows as a table has.

Rows are numbered in order of their id. Each of n draws, itself a hash of seed, sample and draw, picks a number; counting the draws by number gives
the rows' weights. Draws are made where they are counted, a short row each, and meet the table by number: no task holds a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.scan import ranked
from millrace.storage import cut

#: Draws have 52 bits, as many as a double tells apart.
DRAW_BITS = 52


def fine_uniform(*keys: Column | str | int) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of the keys as text joined by colons."""
    text = F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("bigint") / F.lit(float(1 << DRAW_BITS))


def draws(spark, n: int, samples: int, seed: int) -> DataFrame:
    """(sample, place, weight): how often each place from 0 to n - 1 is drawn in each sample of n draws with replacement; those drawn at all."""
    every = spark.range(n * samples).select(F.floor(F.col("id") / n).cast("int").alias("sample"), (F.col("id") % n).alias("draw"))
    place = F.least(F.floor(fine_uniform(seed, "draw", F.col("sample"), F.col("draw")) * n).cast("long"), F.lit(n - 1))
    return every.select("sample", place.alias("place")).groupBy("sample", "place").agg(F.count(F.lit(1)).cast("int").alias("weight"))


def bootstrap(df: DataFrame, id_col: str, samples: int, seed: int = 0, weights: str = "weights") -> DataFrame:
    """`df` with its weights in `samples` samples with replacement, each of exactly as many draws as there are rows.

    `weights` is an array with the number of times that the row is in each sample. Rows are numbered by id; those with equal ids in any order. An
    empty table gives no rows.
    """
    numbered = cut(ranked(df, [F.col(id_col)], rank="__number"), "bootstrap")
    n = numbered.count()
    if not n:
        return df.withColumn(weights, F.array().cast("array<smallint>"))
    drawn = draws(df.sparkSession, n, samples, seed)
    found = drawn.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("sample", "weight"))).alias("__drawn"))  # `samples` entries at most
    joined = numbered.join(found, F.col("__number") == F.col("place"), "left")
    each = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.coalesce(F.element_at("__drawn", s), F.lit(0)).cast("smallint"))
    return joined.withColumn(weights, each).drop("__number", "place", "__drawn")
