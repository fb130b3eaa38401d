"""The whole analysis as one object: counts, sites and spots in, named tables out; edges, usage and filled values are written once, the others are lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.operators import cluster, quantify, recover, spatial, stats
from spotloom.operators.lineage import cut


def differential(values: DataFrame, label: str) -> DataFrame:
    """(label, gene, n1, n2, u, z, log2fc, p, padj): each label's spots against all others, by gene; adjusted within a label.

    Sides of fewer than three values are left out.  A row goes to the comparisons of all labels; there are few.
    """
    known = values.where(F.col(label).isNotNull()).select("gene", "value", F.col(label).alias("own"))
    of = known.select(F.col("own").alias(label)).distinct()
    sides = known.crossJoin(F.broadcast(of))  # a row a label
    sides = sides.withColumn("g", F.when(F.col("own") == F.col(label), 1).otherwise(2))
    mean = lambda g: F.avg(F.when(F.col("g") == g, F.col("value")))
    change = sides.groupBy(label, "gene").agg(F.log2((mean(1) + 1e-6) / (mean(2) + 1e-6)).alias("log2fc"))
    tested = stats.rank_sum(sides, [label, "gene"]).where("n1 >= 3 AND n2 >= 3").join(change, [label, "gene"]).withColumn("p", stats.normal_p("z"))
    return stats.adjust(tested, [label])


class Workflow:
    """From counts of sites, or from usage values (of_usage).

    Values are filled by an imputer of recover.IMPUTERS.  Domains come from one half of the genes (by a hash) and are
    tested on the other half and the other way round, since labels made from the values tested would always differ.
    """

    def __init__(self, counts: DataFrame | None, sites: DataFrame | None, spots: DataFrame, min_parent: int = 5, neighbours: int = 6, n_domains: int = 3, apply_filters: bool = False, least_support: float = 0.3, imputer: str = "spatial_knn", alpha: float = 0.1):
        if imputer not in recover.IMPUTERS:
            raise ValueError(f"imputer must be one of {sorted(recover.IMPUTERS)}")
        self.counts, self.sites, self.spots = counts, sites, spots
        self.min_parent, self.k, self.n_domains = min_parent, neighbours, n_domains
        self.apply_filters, self.least_support = apply_filters, least_support
        self.imputer, self.alpha, self.given = imputer, alpha, None

    @classmethod
    def of_usage(cls, usage: DataFrame, spots: DataFrame, **options) -> "Workflow":
        w = cls(None, None, spots, **options)
        w.given = usage.select("gene", "spot", "value")
        return w

    def _usage(self, edges: DataFrame) -> DataFrame:
        if self.given is not None:
            return self.given
        sites = self.sites
        if self.apply_filters:
            sites = sites.join(spatial.site_support(self.counts, edges, self.least_support).where("valid").select("site"), "site", "left_semi")
        return quantify.gene_index(self.counts, sites, self.min_parent).select("gene", "spot", "value")

    def calibrated(self, usage: DataFrame) -> DataFrame:
        """How far off the imputer is on a tenth of the observed cells, at the level 1 - alpha: half the width of an interval; (q, floor)."""
        out = (F.pmod(F.xxhash64("gene", "spot", F.lit(7)), F.lit(10)) == 0) & F.col("value").isNotNull()
        train = usage.select("gene", "spot", F.when(~out, F.col("value")).alias("value"))
        held = usage.where(out).join(recover.IMPUTERS[self.imputer](train, self.spots).select("gene", "spot", F.col("imputed").alias("pred")), ["gene", "spot"]).where("pred IS NOT NULL")
        return stats.conformal(held.select(F.col("value").alias("truth"), "pred", F.lit(1.0).alias("std")), self.alpha, scaled=False)

    def run(self) -> dict[str, DataFrame]:
        """edges, usage, imputed, calibration, domains, differential, trends and report."""
        edges = spatial.knn_edges(self.spots, self.k)
        # several results read each of these
        edges = cut(edges)
        usage = cut(self._usage(edges))
        imputed = cut(recover.IMPUTERS[self.imputer](usage, self.spots))
        filled = imputed.select("gene", "spot", F.col("imputed").alias("value"))
        domains = cluster.kmeans_domains(filled, self.spots, self.n_domains)
        half, tests = F.pmod(F.xxhash64("gene"), F.lit(2)), None
        seen = usage.where("value IS NOT NULL")
        for k in (0, 1):
            others = cluster.kmeans_domains(filled.where(half == 1 - k), self.spots, self.n_domains)
            one = differential(seen.where(half == k).join(others, "spot"), "domain").withColumn("half", F.lit(k))
            tests = one if tests is None else tests.union(one)
        trends = spatial.autocorrelation(filled.where("value IS NOT NULL"), spatial.symmetric(edges))
        report = usage.agg(F.count("*").alias("cells"), F.count("value").alias("observed"))
        return {
            "edges": edges,
            "usage": usage,
            "imputed": imputed,
            "calibration": self.calibrated(usage),
            "domains": domains,
            "differential": tests,
            "trends": trends.withColumn("rank", F.row_number().over(Window.orderBy(F.col("morans_i").desc_nulls_last(), "gene"))),
            "report": report,
        }
