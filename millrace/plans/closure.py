"""Connected components of a link table, without bringing links or labels to the driver.

Large-star and small-star steps alternate (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): each
groups links by one end and needs only the smallest neighbour of a node, an aggregate that is combined before it is
exchanged, and a join back to the links. A hot node's links are therefore never held together, and a chain of n nodes is done in
about log n rounds. Each round is written to the shared folder and reread, so plans, and what the optimiser
takes them to hold, stay small; the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import drop_table, write_table


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) of every node with a link to another; component is the smallest node reachable.

    Nulls in either end and links of a node with itself are no links. An empty table gives no rows.
    """
    spark = links.sparkSession
    links = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen, schema, path = None, links.schema, write_table(links, "links")
    while True:
        links, before = spark.read.schema(schema).parquet(path), path
        path = write_table(_small_star(_large_star(links)), "links")
        drop_table(spark, before)
        links = spark.read.schema(schema).parquet(path)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def closure(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each node of `nodes` (id) reaches over `links` (u, v); a node without links is its own label."""
    found = components(links).withColumnRenamed("node", "id")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label"))
