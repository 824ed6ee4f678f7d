"""Model statistics over streams: counts, sums and squares merge, so class statistics can be kept by event-time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_class_stats(events: DataFrame, time: str, label: str, features: Sequence[str], window: str, delay: str) -> DataFrame:
    """Count, mean and population variance of each feature by window and label; later rows than `delay` are dropped by the watermark.

    Works on streams and on tables: what GaussianNB and StandardScaler fit, in mergeable form.
    """
    marked = events.withWatermark(time, delay)
    stats = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("var", F.var_pop))]
    grouped = marked.groupBy(F.window(time, window).alias("w"), F.col(label)).agg(F.count(F.lit(1)).alias("n"), *stats)
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), label, "n", *[f"{n}_{c}" for c in features for n in ("mean", "var")])
