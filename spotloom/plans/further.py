"""Further queries of the catalogue: annotation, tests and autocorrelation by uncertainty, compactness, registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotloom.operators import cluster, intervals, quantify, spatial, stats
from spotloom.plans.catalogue import _GENES, _KNN, _genes, _knn, _points, add
from spotloom.plans.views import r6


@add("jn08_annotate", """SELECT site, gid, gap, CASE WHEN gap = 0 THEN 'inside' WHEN gap <= 5000 THEN 'near' WHEN gap IS NOT NULL THEN 'far' END AS tier FROM (
  SELECT a.site, g.gid, CASE WHEN g.gid IS NOT NULL THEN greatest(g.gs - a.coord, a.coord - g.ge, 0) END AS gap,
    row_number() OVER (PARTITION BY a.site ORDER BY greatest(g.gs - a.coord, a.coord - g.ge, 0), a.strand <> g.strand, g.gid) AS k
  FROM site a LEFT JOIN wide g ON a.chr = g.chr) WHERE k = 1""", _GENES + ", wide AS (SELECT genes.* FROM genes JOIN site ON site = gid WHERE support >= 0.9 AND reads >= 40)")
def _(v):
    wide = _genes(v).join(v.sites.where("support >= 0.9 AND reads >= 40").select(F.col("site").alias("gid")), "gid", "left_semi")
    return intervals.annotate(_points(v), wide)


_HALF = """
gu AS (SELECT gene, spot, truth AS value, std, CASE WHEN domain = 0 THEN 1 ELSE 2 END AS g FROM pred JOIN spot USING (spot)),
gw AS (SELECT *, CASE WHEN std > 0 AND count(*) FILTER (std > 0) OVER (PARTITION BY gene) >= 3 THEN 1 / (std + 1e-8) ELSE 1 END AS weight FROM gu),
gh AS (SELECT * FROM (SELECT *, median(weight) OVER (PARTITION BY gene, g) AS m, count(*) OVER (PARTITION BY gene, g) AS n FROM gw) WHERE n <= 5 OR weight > m),
rk AS (SELECT gene, g, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r FROM gh)"""


def _weighted(v):
    g = v.pred.join(v.spots, "spot").select("gene", F.col("truth").alias("value"), "std", F.when(F.col("domain") == 0, 1).otherwise(2).alias("g"))
    return stats.uncertainty_weights(g, ["gene"])


@add("sta04_certain_half", "SELECT gene, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 2) AS n2, sum(r) FILTER (g = 1) - count(*) FILTER (g = 1) * (count(*) FILTER (g = 1) + 1) / 2 AS u FROM rk GROUP BY gene HAVING count(*) FILTER (g = 1) > 0 AND count(*) FILTER (g = 2) > 0", _HALF)
def _(v):
    return stats.rank_sum(stats.certain_half(_weighted(v), ["gene"]), ["gene"]).select("gene", "n1", "n2", "u")


@add("sta04_resampled")
def _(v):
    return stats.rank_sum(stats.resampled(_weighted(v), "gene"), ["gene"]).withColumn("p", stats.normal_p("z"))


@add("spa13_uncertain_moran", """SELECT gene, n, round(CASE WHEN var < 1e-10 THEN 0 ELSE coalesce(c, 0) / var END, 6) AS morans_i, round(-1.0 / (n - 1), 6) AS expected_i
FROM (SELECT gene, count(*) AS n, sum(a * z * z) AS var FROM uz GROUP BY gene) LEFT JOIN (
  SELECT gene, sum(c) AS c FROM (SELECT i.gene, i.spot, any_value(i.a * i.z) * avg(j.a * j.z) AS c FROM uz i JOIN knn ON knn.src = i.spot JOIN uz j ON j.gene = i.gene AND j.spot = knn.dst GROUP BY i.gene, i.spot) GROUP BY gene) USING (gene)""", _KNN + """,
ua AS (SELECT gene, spot, truth, 1 / (std + 1e-10) / sum(1 / (std + 1e-10)) OVER (PARTITION BY gene) AS a, count(*) OVER (PARTITION BY gene) AS n FROM pred WHERE std IS NOT NULL),
uz AS (SELECT gene, spot, a, truth - sum(a * truth) OVER (PARTITION BY gene) AS z FROM ua WHERE n >= 10)""")
def _(v):
    values = v.pred.select("gene", "spot", F.col("truth").alias("value"), "std")
    return spatial.uncertain_moran(values, _knn(v)).select("gene", "n", r6(F.col("morans_i"), "morans_i"), r6(F.col("expected_i"), "expected_i"))


@add("eva08_davies_bouldin", "SELECT round(avg(r), 5) AS davies_bouldin FROM (SELECT i.domain, max((i.s + j.s) / sqrt(pow(i.mx - j.mx, 2) + pow(i.my - j.my, 2))) AS r FROM cl i JOIN cl j ON i.domain <> j.domain GROUP BY i.domain)", "cl AS (SELECT domain, mx, my, avg(sqrt(pow(x - mx, 2) + pow(y - my, 2))) AS s FROM (SELECT domain, x, y, avg(x) OVER (PARTITION BY domain) AS mx, avg(y) OVER (PARTITION BY domain) AS my FROM spot) GROUP BY ALL)")
def _(v):
    return cluster.davies_bouldin(v.spots.select("domain", "x", "y"), "domain", ["x", "y"]).select(F.round("davies_bouldin", 5).alias("davies_bouldin"))


@add("sca06_registered", "SELECT gene, spot, round(greatest(0, least(1, value * 1.5 - 0.2)), 6) AS value FROM usage")
def _(v):
    given = v.usage.select("gene", "spot", (F.col("value") * 1.5 - 0.2).alias("value"))
    return quantify.register_index(given).select("gene", "spot", r6(F.col("value"), "value"))
