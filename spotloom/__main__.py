"""python -m spotloom run | impute | diff: the analysis of one slide from files, each result a folder of Parquet files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.operators import recover
from spotloom.plans.workflow import Workflow, differential
from spotloom.sources import tables


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="spotloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, told in (("run", "usage, imputed values, domains, tests and trends"), ("impute", "fill missing usage values"), ("diff", "test usage between labelled spots")):
        c = sub.add_parser(name, help=told)
        c.add_argument("--usage", required=True, help="genes by spots, CSV or TSV, or Parquet of (gene, spot, value)")
        c.add_argument("--coordinates", required=True, help="CSV or TSV with barcode or spot_id, x and y")
        c.add_argument("--output", required=True)
        c.add_argument("--neighbours", type=int, default=6)
        c.add_argument("--fdr", type=float, default=0.05)
    sub.choices["run"].add_argument("--domains", type=int, default=5)
    for name in ("run", "impute"):
        sub.choices[name].add_argument("--imputer", default="spatial_knn", choices=sorted(recover.IMPUTERS))
    sub.choices["diff"].add_argument("--labels", required=True, help="CSV or TSV with barcode or spot_id, and label")
    sub.choices["diff"].add_argument("--log2fc", type=float, default=0.5)
    return p.parse_args(argv)


def _usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("gene", "spot", "value") if path.rstrip("/").endswith(".parquet") else tables.matrix(spark, path)


def numbered(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """usage and spots by number, since operators count in numbers, and the names (gene, name) and (spot, name)."""
    usage, spots = _usage(spark, a.usage), tables.coordinates(spark, a.coordinates)
    tables.assemble(usage, spots)  # names spots without a place
    id_of = lambda c: F.xxhash64(F.col(c).cast("string"))
    genes = usage.select(id_of("gene").alias("gene"), F.col("gene").alias("name")).distinct()
    places = spots.select(id_of("spot").alias("spot"), "x", "y")
    return usage.select(id_of("gene").alias("gene"), id_of("spot").alias("spot"), "value"), places, genes, spots.select(id_of("spot").alias("spot"), F.col("spot").alias("name"))


def named(df: DataFrame, genes: DataFrame, spots: DataFrame) -> DataFrame:
    for c, names in (("gene", genes), ("spot", spots)):
        if c in df.columns:
            df = df.join(names.withColumnRenamed(c, "__id").withColumnRenamed("name", "__name"), df[c] == F.col("__id"), "left").withColumn(c, F.col("__name")).drop("__id", "__name")
    return df


def results(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    usage, spots, genes, names = numbered(spark, a)
    if a.command == "impute":
        out = {"imputed": recover.IMPUTERS[a.imputer](usage, spots)}
    elif a.command == "diff":
        labels = tables.spot_labels(spark, a.labels).select(F.xxhash64("spot").alias("spot"), "label")
        tested = differential(usage.where("value IS NOT NULL").join(labels, "spot"), "label")
        out = {"differential": tested, "significant": tested.where((F.col("padj") < a.fdr) & (F.abs("log2fc") >= a.log2fc))}
    else:
        out = Workflow.of_usage(usage, spots, neighbours=a.neighbours, n_domains=a.domains, imputer=a.imputer).run()
    return {k: named(v, genes, names) for k, v in out.items()}


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("spotloom").getOrCreate()
    tables.write_results(results(spark, a), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
