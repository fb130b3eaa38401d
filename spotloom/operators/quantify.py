"""Counts to usage: gene and site indices, quality of sites, spatial bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def oriented(coord: str = "coord", strand: str = "strand") -> Column:
    return F.when(F.col(strand) == "-", -F.col(coord)).otherwise(F.col(coord))


def ranked_sites(sites: DataFrame) -> DataFrame:
    """Rank of each site in its gene along the strand (ties: site id), and the gene's number of sites."""
    w = Window.partitionBy("gene")
    return sites.withColumn("rn", F.row_number().over(w.orderBy(oriented(), "site"))).withColumn("n", F.count("*").over(w))


def gene_index(counts: DataFrame, sites: DataFrame, min_parent: int = 5) -> DataFrame:
    """(gene, spot, total, distal, value): share of counts on distal sites; null below min_parent.

    Of n >= 2 sites the first max(1, n div 2) are proximal.  Counts meet the ranks by site and collapse to
    (gene, spot) with map-side sums.
    """
    r = ranked_sites(sites).where("n >= 2").select("site", "gene", (F.col("rn") > F.greatest(F.floor(F.col("n") / 2), F.lit(1))).alias("is_distal"))
    g = counts.join(r, "site").groupBy("gene", "spot").agg(F.sum("count").alias("total"), F.sum(F.when(F.col("is_distal"), F.col("count")).otherwise(0)).alias("distal"))
    return g.withColumn("value", F.when(F.col("total") >= min_parent, F.col("distal") / F.col("total")))


def site_usage(counts: DataFrame, sites: DataFrame, min_parent: int = 5) -> DataFrame:
    """Count of a site over its gene's total in the spot; null below min_parent; genes of two sites or more."""
    many = sites.withColumn("n", F.count("*").over(Window.partitionBy("gene"))).where("n >= 2").select("site", "gene")
    parent = F.sum("count").over(Window.partitionBy("gene", "spot"))
    return counts.join(many, "site").withColumn("parent", parent).select("site", "gene", "spot", F.when(F.col("parent") >= min_parent, F.col("count") / F.col("parent")).alias("usage"))


def max_distal_usage(counts: DataFrame, sites: DataFrame, min_parent: int = 5) -> DataFrame:
    """Mean usage of the sites at the gene's extreme coordinate along the strand."""
    far = Window.partitionBy("gene")
    ends = sites.withColumn("far", F.max(oriented()).over(far)).where(oriented() == F.col("far")).select("site")
    return site_usage(counts, sites, min_parent).where("usage IS NOT NULL").join(ends, "site", "left_semi").groupBy("gene").agg(F.avg("usage").alias("usage"))


def site_metrics(counts: DataFrame) -> DataFrame:
    """Total, spots with counts, mean, median and population CV over nonzero counts, and maximum.

    The CV of integers comes from their exact sums, so one that is 0.6 is 0.6 in whatever order counts are met.
    """
    c = F.when(F.col("count") > 0, F.col("count"))
    cv = F.stddev_pop(c) / F.avg(c)
    if isinstance(counts.schema["count"].dataType, IntegralType):
        whole, total = c.cast("decimal(19,0)"), F.sum(c).cast("decimal(38,0)")
        cv = F.sqrt((F.count(c).cast("decimal(19,0)") * F.sum(whole * whole) - total * total).cast("double")) / F.sum(c)
    return counts.groupBy("site").agg(
        F.sum("count").alias("total"), F.count(c).alias("n_spots"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0)).alias("median"),
        cv.alias("cv"), F.max("count").alias("max"),
    )


def site_report(counts: DataFrame, min_reads: int = 10, min_spots: int = 3, min_mean: float = 1.0, max_cv: float | None = None) -> DataFrame:
    """The metrics with a flag for each filter and for all."""
    m = site_metrics(counts)
    flags = {"pass_reads": F.col("total") >= min_reads, "pass_spots": F.col("n_spots") >= min_spots, "pass_mean": (F.col("n_spots") > 0) & (F.col("mean") >= min_mean), "pass_cv": F.lit(True) if max_cv is None else F.coalesce(F.col("cv") <= max_cv, F.lit(False))}
    every = F.lit(True)
    for f in flags.values():
        every = every & f
    return m.withColumns(flags | {"pass_all": every})


def filter_sites(sites: DataFrame, counts: DataFrame, min_support: float | None = None, **limits) -> DataFrame:
    ok = site_report(counts, **limits).where("pass_all").select("site")
    kept = sites.join(ok, "site", "left_semi")
    return kept if min_support is None else kept.where(F.col("support") >= min_support)


def peaks_by_support(sites: DataFrame, counts: DataFrame, min_spots: int = 3) -> DataFrame:
    ok = counts.where("count > 0").groupBy("site").agg(F.count("*").alias("k")).where(F.col("k") >= min_spots)
    return sites.join(ok, "site", "left_semi")


def bin_counts(counts: DataFrame, spots: DataFrame, size: int) -> DataFrame:
    """Counts of a site by square bin, its share of the bin's total, and the bin's centre."""
    b = counts.join(spots.select("spot", F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by")), "spot").groupBy("site", "bx", "by").agg(F.sum("count").alias("count"))
    total = F.sum("count").over(Window.partitionBy("bx", "by"))
    half = size // 2
    return b.select("site", "bx", "by", "count", (F.col("count") / total).alias("usage"), (F.col("bx") * size + half).alias("cx"), (F.col("by") * size + half).alias("cy"))


def roll_up(usage: DataFrame, spots: DataFrame, sizes: list[int]) -> DataFrame:
    """Mean usage by gene and square cell, for several cell sizes in one pass."""
    s = spots.select("spot", "x", "y", F.explode(F.array(*map(F.lit, sizes))).alias("size")).select("spot", "size", F.floor(F.col("x") / F.col("size")).alias("bx"), F.floor(F.col("y") / F.col("size")).alias("by"))
    return usage.join(s, "spot").groupBy("gene", "size", "bx", "by").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def profile(usage: DataFrame, n_spots: int, n_genes: int, many_spots: int = 1000, sparse: float = 0.35) -> DataFrame:
    """Observed and positive fractions over all cells, medians by spot, and whether the data look high-resolution."""
    per = usage.groupBy("spot").agg(F.count("value").alias("o"), F.count(F.when(F.col("value") > 0, 1)).alias("p"))
    cells = n_spots * n_genes
    a = per.agg((F.sum("o") / cells).alias("observed"), (F.sum("p") / cells).alias("positive"), F.percentile("o", F.lit(0.5)).alias("median_observed"), F.percentile("p", F.lit(0.5)).alias("median_positive"))
    high = (F.lit(n_spots) >= many_spots) | (F.col("observed") < sparse) | ((F.lit(n_spots) >= 300) & (F.col("positive") < 0.15) & (F.col("median_positive") <= max(5, 0.1 * n_genes)))
    return a.withColumn("highres", high)


def domain_stats(usage: DataFrame, spots: DataFrame) -> DataFrame:
    """Spots, mean, population deviation and median of all values of a domain, and its centre."""
    values = usage.join(spots.select("spot", "domain"), "spot").groupBy("domain").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", F.lit(0.5)).alias("median"))
    place = spots.groupBy("domain").agg(F.count("*").alias("n_spots"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return place.join(values, "domain", "left")


def sample_means(usage: DataFrame, spots: DataFrame) -> DataFrame:
    """Mean by gene and sample, then whether the samples of the two batches are apart."""
    m = usage.join(spots.select("spot", "sample", "batch"), "spot").groupBy("gene", "sample", "batch").agg(F.avg("value").alias("m"))
    a, b = (F.when(F.col("batch") == i, F.col("m")) for i in (0, 1))
    return m.groupBy("gene").agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), ((F.min(a) > F.max(b)) | (F.max(a) < F.min(b))).alias("direction_agree"))


# --- scalar indices -------------------------------------------------------------------------------


def rud(p: Column, d: Column, pc: float = 1.0) -> Column:
    return d / (p + d + pc)


def pdui(p: Column, d: Column, long: Column | None = None, pc: float = 1.0) -> Column:
    return 100 * d / (p + d + pc) if long is None else 100 * (d + long) / (p + d + long + pc)


def pai(p: Column, d: Column, method: str = "log2", pc: float = 1.0) -> Column:
    return F.log2((d + pc) / (p + pc)) if method == "log2" else (d - p) / (p + d + pc)


def wul(counts: DataFrame, sites: DataFrame, normalize: bool = True, pc: float = 1.0) -> DataFrame:
    """Count-weighted position by gene and spot, scaled to the range of the gene's positions (equal positions: 0.5)."""
    place = sites.withColumn("lo", F.min("coord").over(Window.partitionBy("gene"))).withColumn("hi", F.max("coord").over(Window.partitionBy("gene"))).select("site", "gene", "coord", "lo", "hi")
    w = counts.join(place, "site").groupBy("gene", "spot").agg((F.sum(F.col("count") * F.col("coord")) / (F.sum("count") + pc)).alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), F.lit(0.5)).otherwise((F.col("w") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return w.select("gene", "spot", (scaled if normalize else F.col("w")).alias("wul"))


def register_index(usage: DataFrame, value: str = "value") -> DataFrame:
    """An index computed elsewhere: values clipped to [0, 1], NaN as missing; one row for each (gene, spot), or an error."""
    twice = usage.groupBy("gene", "spot").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one value for gene {twice[0].gene}, spot {twice[0].spot}")
    v = F.col(value).cast("double")
    return usage.withColumn(value, F.when(~F.isnan(v), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))))
