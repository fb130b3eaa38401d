"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation with map-side minima and one join back on the node; each round's edges are
written to the shared folder, so lineage stays short and a lost executor costs a reread.  Neither edges nor
components reach the driver, only two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.llm.common import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = _least(down)
    return down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _clean(e: DataFrame) -> DataFrame:
    return e.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component."""
    now = scratch.save(_clean(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    mark = None
    while True:
        new = scratch.save(_clean(_small_star(_clean(_large_star(now)))))
        scratch.drop(now)
        now = new
        n, h = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, h) == mark or not n:
            break
        mark = (n, h)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
