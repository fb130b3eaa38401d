"""Analytic views over the star-schema tables, as DataFrames and as SQL text for the oracle.

Each table stands for one input of the engine: parts are poly(A) sites, line items are site counts by
spot (supplier), suppliers are spots with integer coordinates.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.operators import quantify

MIN_PARENT = 200
#: lines that a task of dealt_counts adds up
LINES = 1_000_000


def r6(c, name: str):
    return F.round(c, 6).alias(name)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def sites(self) -> DataFrame:
        k = F.col("p_partkey")
        s = self.table("part").select(k.alias("site"), (k % 50).alias("gene"), F.concat(F.lit("chr"), (k % 5).cast("string")).alias("chr"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), (k * 3).alias("s"), (k * 3 + 5 + F.col("p_size") % 20).alias("e"), F.round((F.col("p_size") % 10) / 10, 1).alias("support"), F.col("p_size").cast("bigint").alias("reads"), F.col("p_brand").alias("kind"))
        return s.withColumn("coord", F.when(F.col("strand") == "+", F.col("e")).otherwise(F.col("s")))

    @cached_property
    def counts(self) -> DataFrame:
        return self._counts(self.table("lineitem"))

    @staticmethod
    def _counts(lines: DataFrame) -> DataFrame:
        return lines.groupBy(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("spot")).agg(F.sum("l_quantity").cast("bigint").alias("count"))

    def dealt_counts(self, lines: int = LINES) -> tuple[DataFrame, int]:
        """counts, dealt by site over so many tasks that the memory of one doesn't grow with the table, and their number."""
        t = self.table("lineitem")
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-t.count() // lines))
        return self._counts(t.select("l_partkey", "l_suppkey", "l_quantity").repartition(tasks, "l_partkey")), tasks

    @cached_property
    def spots(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(k.alias("spot"), ((k * k * 37 + k * 11) % 1009).alias("x"), ((k * k * 61 + k * 17) % 1013).alias("y"), F.col("s_nationkey").alias("sample"), (F.col("s_nationkey") % 3).alias("domain"), (F.col("s_nationkey") % 2).alias("batch"))

    @cached_property
    def usage(self) -> DataFrame:
        return quantify.gene_index(self.counts, self.sites, MIN_PARENT).select("gene", "spot", "value")

    @cached_property
    def observed(self) -> DataFrame:
        return self.usage.where("value IS NOT NULL")

    @cached_property
    def pred(self) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("gene")
        return self.observed.select("gene", "spot", F.col("value").alias("truth"), F.round(F.avg("value").over(w), 9).alias("pred"), F.round(F.stddev_pop("value").over(w) * (1 + (F.col("spot") % 7) / 10), 9).alias("std"), ((F.col("gene") * 31 + F.col("spot")) % 2).alias("part"))

    @cached_property
    def diff(self) -> DataFrame:
        """A table of p-values: one for each gene and batch pair stand-in."""
        return self.observed.groupBy("gene").agg(F.round(F.pow(F.avg("value"), 4) * F.pow(F.stddev_pop("value"), 2), 9).alias("p"), F.round(F.log2((F.avg(F.when(F.col("spot") % 2 == 1, F.col("value"))) + 1e-6) / (F.avg(F.when(F.col("spot") % 2 == 0, F.col("value"))) + 1e-6)), 6).alias("log2fc"))


SQL_VIEWS = f"""
site AS (
  SELECT p_partkey AS site, p_partkey % 50 AS gene, 'chr' || (p_partkey % 5) AS chr, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    p_partkey * 3 AS s, p_partkey * 3 + 5 + p_size % 20 AS e, round((p_size % 10) / 10.0, 1) AS support, CAST(p_size AS BIGINT) AS reads, p_brand AS kind,
    CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 3 + 5 + p_size % 20 ELSE p_partkey * 3 END AS coord FROM part),
counts AS (SELECT l_partkey AS site, l_suppkey AS spot, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem GROUP BY ALL),
spot AS (
  SELECT s_suppkey AS spot, (s_suppkey * s_suppkey * 37 + s_suppkey * 11) % 1009 AS x, (s_suppkey * s_suppkey * 61 + s_suppkey * 17) % 1013 AS y,
    s_nationkey AS sample, s_nationkey % 3 AS domain, s_nationkey % 2 AS batch FROM supplier),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN strand = '-' THEN -coord ELSE coord END, site) AS rn, count(*) OVER (PARTITION BY gene) AS n FROM site),
gindex AS (
  SELECT gene, spot, CAST(sum(count) AS BIGINT) AS total, CAST(coalesce(sum(count) FILTER (rn > greatest(n // 2, 1)), 0) AS BIGINT) AS distal
  FROM counts JOIN ranked USING (site) WHERE n >= 2 GROUP BY gene, spot),
usage AS (SELECT gene, spot, CASE WHEN total >= {MIN_PARENT} THEN distal / total END AS value FROM gindex),
obs AS (SELECT * FROM usage WHERE value IS NOT NULL),
pred AS (
  SELECT gene, spot, value AS truth, round(avg(value) OVER w, 9) AS pred, round(stddev_pop(value) OVER w * (1 + (spot % 7) / 10.0), 9) AS std, (gene * 31 + spot) % 2 AS part
  FROM obs WINDOW w AS (PARTITION BY gene)),
diff AS (
  SELECT gene, round(pow(avg(value), 4) * pow(stddev_pop(value), 2), 9) AS p,
    round(log2((avg(value) FILTER (spot % 2 = 1) + 1e-6) / (avg(value) FILTER (spot % 2 = 0) + 1e-6)), 6) AS log2fc FROM obs GROUP BY gene)"""


def sql(body: str, extra: str = "") -> str:
    return f"WITH {SQL_VIEWS}{',' + extra if extra else ''}\n{body}"
