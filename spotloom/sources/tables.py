"""Readers of coordinate, site, count and annotation files, and the writers that mirror them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotloom.operators.lineage import cut


def separator(path: str) -> str:
    for end, sep in ((".csv", ","), (".csv.gz", ","), (".tsv", "\t"), (".txt", "\t"), (".tsv.gz", "\t")):
        if path.endswith(end):
            return sep
    raise ValueError(f"neither CSV nor TSV: {path}")


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(spot, x, y); the key is barcode, else spot_id, else the row's number in the file."""
    df = spark.read.csv(path, sep=separator(path), header=True)
    if missing := {"x", "y"} - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    key = next((c for c in ("barcode", "spot_id") if c in df.columns), None)
    if key is None:
        key, df = "__n", numbered_rows(df, "__n")
    return df.select(F.col(key).cast("string").alias("spot"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """df with the number of each row, from 0, in the order of the partitions: rows are counted by partition first."""
    own = cut(df.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = own.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))
    before = counts.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__before"))  # one row a partition
    at = own.withColumn("__p", part).join(F.broadcast(before), "__p")
    return at.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__before", "__id")


def spot_labels(spark: SparkSession, path: str) -> DataFrame:
    """(spot, label); the key is barcode or spot_id, the label a column label, layer or domain."""
    df = spark.read.csv(path, sep=separator(path), header=True)
    key, label = (next((c for c in names if c in df.columns), None) for names in (("barcode", "spot_id"), ("label", "layer", "domain")))
    if key is None or label is None:
        raise ValueError("columns barcode or spot_id, and label, layer or domain are needed")
    return df.select(F.col(key).alias("spot"), F.col(label).alias("label"))


def two_way(spark: SparkSession, coordinates_path: str | None = None, matrix_path: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Coordinates (spot, x, y) and usage (gene, spot, value), each from its file if one is named.

    A matrix given as Parquet of (gene, spot, value, x, y) carries its spots' places, which win over those of the file.
    """
    spots = coordinates(spark, coordinates_path) if coordinates_path else None
    if matrix_path is None:
        return spots, None
    if not matrix_path.rstrip("/").endswith(".parquet"):
        return spots, matrix(spark, matrix_path)
    whole = spark.read.parquet(matrix_path)
    if {"x", "y"} <= set(whole.columns):
        spots = whole.select("spot", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    return spots, whole.select("gene", "spot", "value")


def common_spots(usage: DataFrame, spots: DataFrame, metadata: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """usage and spots of the spots that both have, spots with the metadata (spot, ...) where there is any."""
    both = usage.select("spot").distinct().join(spots.select("spot").distinct(), "spot")
    own = spots.join(both, "spot", "left_semi")
    return usage.join(both, "spot", "left_semi").select(*usage.columns), own if metadata is None else own.join(metadata, "spot", "left")


def published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """apa_matrix.csv (spots by genes), coordinates.csv (spot_id, x, y) and, if there, metadata.csv (spot_id, layer) of a folder."""
    raw = spark.read.csv(f"{path}/apa_matrix.csv", header=True)
    spot, *genes = raw.columns
    v = F.col("value").cast("double")
    usage = raw.unpivot([spot], genes, "gene", "value").select("gene", F.col(spot).alias("spot"), F.when(~F.isnan(v), v).alias("value"))
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata.csv")
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    meta = spark.read.csv(f"{path}/metadata.csv", header=True) if there else None
    return common_spots(usage, coordinates(spark, f"{path}/coordinates.csv"), meta.withColumnRenamed(meta.columns[0], "spot") if there else None)


def tissue_positions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless positions of 6 columns: spots in the tissue, last two columns as x, y, with the barcode's core."""
    raw = spark.read.csv(path, schema="spot string, in_tissue int, row int, col int, x double, y double")
    return raw.where("in_tissue = 1").select("spot", F.regexp_replace("spot", "-[0-9]+$", "").alias("core"), "x", "y")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """BED6 as sites; '#' lines are comments; support is a thousandth of the score; strand defaults to '+'."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="chr string, s bigint, e bigint, name string, score double, strand string")
    return raw.select("chr", "s", "e", F.coalesce("strand", F.lit("+")).alias("strand"), F.col("name").alias("gene_name"), (F.col("score") / 1000).alias("support"))


def gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene lines of a GTF: 1-based inclusive intervals, id without version, name (else id), width."""
    raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chr string, src string, feature string, s bigint, e bigint, score string, strand string, frame string, attrs string")
    attr = lambda k: F.regexp_extract("attrs", k + ' "([^"]*)"', 1)
    g = raw.where("feature = 'gene'").select("chr", "s", "e", "strand", F.regexp_replace(attr("gene_id"), r"\.[0-9]+$", "").alias("gene_id"), attr("gene_name").alias("n"), (F.col("e") - F.col("s") + 1).alias("width"))
    return g.select("chr", "s", "e", "strand", "gene_id", F.when(F.col("n") == "", F.col("gene_id")).otherwise(F.col("n")).alias("gene_name"), "width")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A wide gene-by-spot table as (gene, spot, value), NaN and empty as null."""
    raw = spark.read.csv(path, sep=separator(path), header=True)
    gene, *spots = raw.columns
    long = raw.unpivot([gene], spots, "spot", "value") if spots else raw.select(F.col(gene), F.lit(None).alias("spot"), F.lit(None).alias("value"))
    v = F.col("value").cast("double")
    return long.select(F.col(gene).alias("gene"), "spot", F.when(~F.isnan(v), v).alias("value"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """Sparse peak_id, spot_id ('Cx_Cy'), count, with the coordinates split out."""
    raw = spark.read.csv(path, sep=separator(path), header=True, schema="peak_id string, spot_id string, count bigint")
    part = lambda i: F.regexp_replace(F.split("spot_id", "_")[i], "^C", "").cast("bigint")
    return raw.select("peak_id", "spot_id", part(0).alias("x"), part(1).alias("y"), "count")


def named_peaks(df: DataFrame, name: str = "name") -> DataFrame:
    """gene:chr:start-end:strand names, split from the right; coord is the 3' end; genes of two peaks or more."""
    x = F.regexp_extract
    p = df.select("*", *[x(name, r"^(.*):([^:]+):([0-9]+)-([0-9]+):([^:]+)$", i).alias(n) for i, n in ((1, "gene"), (2, "chr"), (3, "s"), (4, "e"), (5, "st"))])
    strand = F.when(F.col("st").isin("1", "+"), "+").otherwise("-")
    p = p.where("gene <> ''").select(name, "gene", "chr", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), strand.alias("strand"))
    p = p.withColumn("coord", F.when(F.col("strand") == "+", F.col("e")).otherwise(F.col("s")))
    many = p.groupBy("gene").agg(F.count("*").alias("k")).where("k >= 2").select("gene")
    return p.join(many, "gene", "left_semi")


def motif_hits(spark: SparkSession, path: str) -> DataFrame:
    """'>' lines (not '>>') of a target-prediction report, as (regulator, target, score, energy)."""
    f = F.split(F.substring("value", 2, 1 << 20), "\t")
    return spark.read.text(path).where("value LIKE '>%' AND value NOT LIKE '>>%'").select(f[0].alias("regulator"), f[1].alias("target"), f[2].cast("double").alias("score"), f[3].cast("double").alias("energy"))


def normalise_sites(df: DataFrame) -> DataFrame:
    """Site columns under one name each, with the defaults chr1 and '+'."""
    def first(names: list[str], default):
        return F.coalesce(*[F.col(n) for n in names if n in df.columns], default)

    return df.select("*", first(["chr", "seqnames"], F.lit("chr1")).alias("chr"), first(["strand"], F.lit("+")).alias("strand"), first(["site_type", "ftr"], F.lit(".")).alias("kind"), first(["read_count", "count"], F.lit(0)).cast("bigint").alias("reads"))


def assemble(usage: DataFrame, spots: DataFrame) -> DataFrame:
    """Usage with coordinates; spots without any are an error that names five of them."""
    lost = [r.spot for r in usage.select("spot").distinct().join(spots, "spot", "left_anti").orderBy("spot").limit(5).collect()]
    if lost:
        raise ValueError(f"spots without coordinates, such as {lost}")
    return usage.join(spots.select("spot", "x", "y"), "spot")


def bed_lines(sites: DataFrame) -> DataFrame:
    """BED6 lines: name is the gene (else '.'), score a thousand times the support (else 0)."""
    return sites.select(F.concat_ws("\t", "chr", "s", "e", F.coalesce(F.col("gene").cast("string"), F.lit(".")), F.coalesce((F.col("support") * 1000).cast("int"), F.lit(0)), "strand").alias("value"))


def write_bed(sites: DataFrame, path: str) -> None:
    bed_lines(sites).write.mode("overwrite").text(path)


def write_sites(sites: DataFrame, path: str, kind: str = "bed") -> None:
    """Sites as BED6 without a header, or all their columns as CSV or TSV with one; a folder of part files."""
    if kind not in ("bed", "csv", "tsv"):
        raise ValueError("kind must be bed, csv or tsv")
    if kind == "bed":
        write_bed(sites, path)
    else:
        sites.write.mode("overwrite").csv(path, sep="," if kind == "csv" else "\t", header=True)


def report(sections: dict[str, DataFrame], title: str, most: int = 20) -> str:
    """A Markdown page: of each section its number of rows and up to `most` of them, in the table's own order."""
    page = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(most).collect()
        page += ["", f"## {name}", "", f"{df.count()} rows", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        page += ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join(page) + "\n"


def best_methods(ratings: DataFrame, lower: tuple[str, ...] = ("rmse", "mae"), higher: tuple[str, ...] = ("pearson", "r2")) -> DataFrame:
    """(metric, method, value): the best method by each metric; ties to the first name."""
    metrics = [m for m in (*lower, *higher) if m in ratings.columns]
    long = ratings.unpivot(["method"], metrics, "metric", "value").where("value IS NOT NULL")
    sign = F.when(F.col("metric").isin(*higher), -1.0).otherwise(1.0)
    return long.groupBy("metric").agg(F.min_by(F.struct("method", "value"), F.struct(sign * F.col("value"), "method")).alias("b")).select("metric", "b.method", "b.value")


def write_matrix(usage: DataFrame, path: str, sep: str = ",") -> None:
    usage.groupBy("gene").pivot("spot").agg(F.first("value")).write.mode("overwrite").csv(path, sep=sep, header=True)


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
