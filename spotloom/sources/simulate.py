"""Synthetic usage with known patterns; every draw is a hash of its cell, so partitions don't matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _uniform(*parts):
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) + 0.5) / (1 << 30)


def simulated_usage(spots: DataFrame, n_genes: int, dropout: float, seed: int = 0, noise: float = 0.05) -> DataFrame:
    """(gene, spot, pattern, truth, value): genes by domain (40 %), gradient (30 %), noise (20 %) and waves (10 %)."""
    s = F.lit(seed)
    span = spots.agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    cells = spots.crossJoin(F.broadcast(span)).withColumn("gene", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_genes - 1).cast("bigint"))))
    u = _uniform("gene", s)
    pattern = F.when(u < 0.4, "domain").when(u < 0.7, "gradient").when(u < 0.9, "noise").otherwise("wave")
    at = (F.col("x") - F.col("x0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1))
    level = F.when(F.col("pattern") == "domain", _uniform("gene", "domain", s, F.lit(1))).when(F.col("pattern") == "gradient", 0.1 + 0.8 * at).when(F.col("pattern") == "wave", 0.5 + 0.4 * F.sin(at * 12)).otherwise(_uniform("gene", "spot", s, F.lit(2)))
    normal = F.sqrt(-2 * F.log(_uniform("gene", "spot", s, F.lit(3)))) * F.cos(2 * F.pi() * _uniform("gene", "spot", s, F.lit(4)))
    seen = _uniform("gene", "spot", s, F.lit(5)) >= dropout
    out = cells.withColumn("pattern", pattern).withColumn("truth", level)
    return out.select("gene", "spot", "pattern", "truth", F.when(seen, F.least(F.greatest(F.col("truth") + noise * normal, F.lit(0.0)), F.lit(1.0))).alias("value"))
