"""Queries of the engine's operators on the star-schema tables, each with its oracle SQL.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotloom.operators import impute, intervals, quantify, spatial, stats
from spotloom.plans.views import Views, r6, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K = 6


def add(name: str, oracle: str | None = None, extra: str = ""):
    def wrap(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            SQL[name] = sql(oracle, extra)
        return f

    return wrap


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- sites: scans, filters, properties ---------------------------------------------------------


@add("agg09_gene_index", "SELECT gene, spot, round(value, 6) AS value FROM usage")
def _(v):
    return rounded(v.usage, "value")


@add("flt01_subset", "SELECT gene, spot, round(value, 6) AS value FROM usage WHERE gene IN (1, 3, 5, 999) AND spot IN (SELECT spot FROM spot WHERE domain = 1)")
def _(v):
    return rounded(v.usage.where(F.col("gene").isin(1, 3, 5, 999)).join(v.spots.where("domain = 1").select("spot"), "spot", "left_semi"), "value").select("gene", "spot", "value")


@add("flt02_support", "SELECT site, support FROM site WHERE support IS NOT NULL AND support >= 0.3")
def _(v):
    return v.sites.where("support IS NOT NULL AND support >= 0.3").select("site", "support")


@add("flt03_reads", "SELECT site, reads FROM site WHERE reads >= 5")
def _(v):
    return v.sites.where("reads IS NOT NULL AND reads >= 5").select("site", "reads")


@add("flt04_kind_chr", "SELECT site, chr, kind FROM site WHERE kind IN (SELECT DISTINCT kind FROM site ORDER BY kind LIMIT 3) AND chr IN ('chr1', 'chr2')")
def _(v):
    kinds = v.sites.select("kind").distinct().orderBy("kind").limit(3)
    return v.sites.join(kinds, "kind", "left_semi").where(F.col("chr").isin("chr1", "chr2")).select("site", "chr", "kind")


@add("flt05_properties", "SELECT site, e - s AS length, (s + e) // 2 AS middle FROM site")
def _(v):
    return intervals.properties(v.sites).select("site", "length", "middle")


@add("flt05_distance", "SELECT site, lead(site) OVER w AS next_site, CASE WHEN lead(site) OVER w IS NOT NULL THEN greatest(lead(s) OVER w - e, s - lead(e) OVER w, 0) END AS distance FROM site WINDOW w AS (PARTITION BY gene, chr, strand ORDER BY s, e, site)")
def _(v):
    return intervals.next_distance(v.sites, ["gene", "chr", "strand"]).select("site", "next_site", "distance")


@add("flt06_normalise", "SELECT p_partkey AS site, 'chr1' AS chr, '+' AS strand, coalesce(p_brand, '.') AS kind, CAST(coalesce(p_size, 0) AS BIGINT) AS reads FROM part")
def _(v):
    from spotloom.sources.tables import normalise_sites

    return normalise_sites(v.table("part").select(F.col("p_partkey").alias("site"), F.col("p_brand").alias("ftr"), F.col("p_size").alias("count"))).select("site", "chr", "strand", "kind", "reads")


@add("flt07_mask_clip", "SELECT gene, spot, round(greatest(least(value * 1.5, 1), 0), 6) AS clipped FROM usage WHERE value IS NOT NULL AND value > 0")
def _(v):
    return v.usage.where("value IS NOT NULL AND value > 0").select("gene", "spot", r6(F.greatest(F.least(F.col("value") * 1.5, F.lit(1.0)), F.lit(0.0)), "clipped"))


@add("flt08_peak_support", "SELECT site, gene FROM site WHERE site IN (SELECT site FROM counts WHERE count > 0 GROUP BY site HAVING count(*) >= 20)")
def _(v):
    return quantify.peaks_by_support(v.sites, v.counts, 20).select("site", "gene")


@add("flt09_observed_sample", "SELECT gene, round(f, 6) AS fraction FROM (SELECT gene, count(value) / count(*) AS f FROM usage GROUP BY gene) WHERE f BETWEEN 0.05 AND 0.95 ORDER BY md5(CAST(gene AS VARCHAR) || '-7'), gene LIMIT 12")
def _(v):
    g = v.usage.groupBy("gene").agg((F.count("value") / F.count("*")).alias("f")).where("f BETWEEN 0.05 AND 0.95")
    return g.orderBy(F.md5(F.concat(F.col("gene").cast("string"), F.lit("-7"))), "gene").limit(12).select("gene", r6(F.col("f"), "fraction"))


_BH = """
adj AS (SELECT gene, p, log2fc, least(1.0, min(p * m / k) OVER (ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)) AS padj
  FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, gene) AS k FROM diff))"""


def _adjusted(v):
    return stats.adjust(v.diff.withColumn("c", F.lit(1)), ["c"]).drop("c")


@add("flt10_significant", "SELECT gene, round(padj, 6) AS padj, log2fc FROM adj WHERE padj < 0.05 AND abs(log2fc) > 0.01", _BH)
def _(v):
    return _adjusted(v).where("padj < 0.05 AND abs(log2fc) > 0.01").select("gene", r6(F.col("padj"), "padj"), "log2fc")


# --- joins -------------------------------------------------------------------------------------


@add("jn01_align", "SELECT u.gene, u.spot, s.x, s.y, s.domain FROM usage u JOIN spot s USING (spot)")
def _(v):
    return v.usage.join(v.spots, "spot").select("gene", "spot", "x", "y", "domain")


@add("jn02_left_fill", "SELECT gene, coalesce(n, 0) AS n, coalesce(names, '') AS names FROM (SELECT DISTINCT gene FROM site) LEFT JOIN (SELECT gene, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS names FROM site WHERE support >= 0.9 AND reads >= 40 GROUP BY gene) USING (gene)")
def _(v):
    r = v.sites.where("support >= 0.9 AND reads >= 40").groupBy("gene").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("names"))
    return v.sites.select("gene").distinct().join(r, "gene", "left").select("gene", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("names", F.lit("")).alias("names"))


@add("jn03_missing_spots", "SELECT DISTINCT spot FROM counts WHERE spot NOT IN (SELECT spot FROM spot WHERE domain > 0)")
def _(v):
    return v.counts.select("spot").distinct().join(v.spots.where("domain > 0"), "spot", "left_anti")


@add("jn04_full_union", "SELECT coalesce(a.gene, b.gene) AS gene, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM (SELECT gene, count(*) AS n FROM site WHERE support >= 0.9 AND reads >= 40 GROUP BY gene) a FULL JOIN (SELECT gene, count(*) AS n FROM site WHERE support <= 0.1 AND reads <= 10 GROUP BY gene) b ON a.gene = b.gene")
def _(v):
    a = v.sites.where("support >= 0.9 AND reads >= 40").groupBy("gene").agg(F.count("*").alias("n_a"))
    b = v.sites.where("support <= 0.1 AND reads <= 10").groupBy("gene").agg(F.count("*").alias("n_b"))
    return a.join(b, "gene", "full_outer").select("gene", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


#: every site stands for a gene too, as wide as it has reads
_GENES = "genes AS (SELECT site AS gid, chr, strand, s - 40 AS gs, e + reads * 3 AS ge FROM site)"


def _genes(v):
    return v.sites.select(F.col("site").alias("gid"), "chr", "strand", (F.col("s") - 40).alias("gs"), (F.col("e") + F.col("reads") * 3).alias("ge"))


@add("jn05_smallest_gene", "SELECT site, gid FROM (SELECT a.site, g.gid, row_number() OVER (PARTITION BY a.site ORDER BY g.ge - g.gs, g.gs, g.gid) AS k FROM site a LEFT JOIN genes g ON a.chr = g.chr AND a.strand = g.strand AND a.coord BETWEEN g.gs AND g.ge) WHERE k = 1", _GENES)
def _(v):
    return intervals.smallest_containing(v.sites.select("site", "chr", "strand", F.col("coord").alias("pos")), _genes(v), ["chr", "strand"])


@add("jn06_overlaps", "SELECT a.site, g.gid AS other FROM site a JOIN genes g ON a.chr = g.chr AND a.strand = g.strand AND a.s < g.ge AND g.gs < a.e AND a.site <> g.gid", _GENES)
def _(v):
    b = _genes(v).select("chr", "strand", F.col("gs").alias("bs"), F.col("ge").alias("be"), F.col("gid").alias("other"))
    return intervals.overlaps(v.sites.select("chr", "strand", "s", "e", "site"), b, ["chr", "strand"]).where("site <> other").select("site", "other")


def _points(v, which: str = "true"):
    return v.sites.where(which).select("chr", "strand", F.col("coord").alias("pos"), "site")


@add("jn07_nearest", "SELECT a.site AS id, min(abs(a.coord - b.coord)) AS distance FROM site a LEFT JOIN site b ON a.chr = b.chr AND a.strand = b.strand AND b.support >= 0.8 GROUP BY a.site")
def _(v):
    return intervals.nearest(_points(v).withColumnRenamed("site", "id"), _points(v, "support >= 0.8"), ["chr", "strand"])


@add("jn07_nearest_rate", "SELECT round(avg(CAST(d <= 50 AS DOUBLE)), 6) AS within_50, round(avg(CAST(d <= 100 AS DOUBLE)), 6) AS within_100, round(median(d), 6) AS median FROM (SELECT min(abs(a.coord - b.coord)) AS d FROM site a JOIN site b ON a.chr = b.chr AND a.strand = b.strand AND b.support >= 0.9 AND b.reads >= 40 GROUP BY a.site)")
def _(v):
    d = intervals.nearest(_points(v).withColumnRenamed("site", "id"), _points(v, "support >= 0.9 AND reads >= 40"), ["chr", "strand"]).where("distance IS NOT NULL")
    rate = lambda n: r6(F.avg((F.col("distance") <= n).cast("double")), f"within_{n}")
    return d.agg(rate(50), rate(100), r6(F.percentile("distance", F.lit(0.5)), "median"))


_KNN = f"""
pairs AS (SELECT a.spot AS src, b.spot AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM spot a JOIN spot b ON a.spot <> b.spot),
knn AS (SELECT src, dst, d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM pairs) WHERE rank <= {K})"""


def _knn(v):
    return spatial.knn_edges(v.spots, K)


@add("jn09_knn", "SELECT src, dst, d2, CAST(rank AS INTEGER) AS rank FROM knn", _KNN)
def _(v):
    return _knn(v)


@add("jn10_radius", "SELECT src, dst, d2 FROM pairs WHERE d2 <= 150 * 150", _KNN)
def _(v):
    return spatial.radius_edges(v.spots, 150)


@add("jn12_nearest_attribute", "SELECT a.spot, b.sample AS taken, round(sqrt(b.d2), 6) AS distance FROM spot a JOIN (SELECT a.spot AS src, b.sample, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, row_number() OVER (PARTITION BY a.spot ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.spot) AS k FROM spot a JOIN spot b ON b.domain = 0 AND a.domain <> 0) b ON a.spot = b.src AND k = 1")
def _(v):
    train = v.spots.where("domain = 0")
    e = spatial.knn_edges(train, 1, v.spots.where("domain <> 0"))
    return e.join(train.select(F.col("spot").alias("dst"), F.col("sample").alias("taken")), "dst").select(F.col("src").alias("spot"), "taken", r6(F.sqrt(F.col("d2").cast("double")), "distance"))


@add("jn13_longest", "SELECT gene, site, length FROM (SELECT gene, site, e - s AS length, row_number() OVER (PARTITION BY gene ORDER BY e - s DESC, site) AS k FROM site) WHERE k = 1")
def _(v):
    best = F.row_number().over(Window.partitionBy("gene").orderBy((F.col("e") - F.col("s")).desc(), "site"))
    return v.sites.withColumn("k", best).where("k = 1").select("gene", "site", (F.col("e") - F.col("s")).alias("length"))


@add("jn14_cross_caller", "SELECT a.gene, count(*) AS n, round(corr(a.value, b.value), 5) AS r FROM obs a JOIN obs b ON a.spot = b.spot AND b.gene = a.gene + 1 GROUP BY a.gene HAVING count(*) >= 10 AND stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0")
def _(v):
    b = v.observed.select((F.col("gene") - 1).alias("gene"), "spot", F.col("value").alias("other"))
    g = v.observed.join(b, ["gene", "spot"]).groupBy("gene").agg(F.count("*").alias("n"), F.corr("value", "other").alias("r"), F.stddev_pop("value").alias("s1"), F.stddev_pop("other").alias("s2"))
    return g.where("n >= 10 AND s1 > 0 AND s2 > 0").select("gene", "n", F.round("r", 5).alias("r"))


@add("jn15_group_pairs", "SELECT a.domain AS a, b.domain AS b, count(*) AS genes FROM (SELECT DISTINCT domain, gene FROM obs JOIN spot USING (spot)) a JOIN (SELECT DISTINCT domain, gene FROM obs JOIN spot USING (spot)) b ON a.gene = b.gene AND a.domain < b.domain GROUP BY ALL")
def _(v):
    d = v.observed.join(v.spots.select("spot", "domain"), "spot").select("domain", "gene").distinct()
    return d.select("gene", F.col("domain").alias("a")).join(d.select("gene", F.col("domain").alias("b")), "gene").where("a < b").groupBy("a", "b").agg(F.count("*").alias("genes"))


# --- aggregates --------------------------------------------------------------------------------

_METRICS = """
metrics AS (
  SELECT site, sum(count) AS total, count(*) FILTER (count > 0) AS n_spots, coalesce(avg(count) FILTER (count > 0), 0) AS mean, coalesce(median(count) FILTER (count > 0), 0) AS median,
    stddev_pop(count) FILTER (count > 0) / avg(count) FILTER (count > 0) AS cv, max(count) AS max FROM counts GROUP BY site)"""


@add("agg01_site_metrics", "SELECT site, CAST(total AS BIGINT) AS total, n_spots, round(mean, 6) AS mean, round(median, 6) AS median, round(cv, 6) AS cv, max FROM metrics", _METRICS)
def _(v):
    return rounded(quantify.site_metrics(v.counts), "mean", "median", "cv")


for _name, _cond in (("agg02_read_filter", "total >= 500"), ("agg03_spot_filter", "n_spots >= 20"), ("agg04_mean_filter", "n_spots > 0 AND mean >= 25"), ("agg05_cv_filter", "cv <= 0.5")):
    add(_name, f"SELECT site FROM metrics WHERE {_cond}", _METRICS)(lambda v, c=_cond: quantify.site_metrics(v.counts).where(c).select("site"))


@add("agg06_filter_sites", "SELECT site, gene FROM site JOIN metrics USING (site) WHERE total >= 500 AND n_spots >= 20 AND mean >= 20 AND cv <= 0.6 AND support >= 0.3", _METRICS)
def _(v):
    return quantify.filter_sites(v.sites, v.counts, 0.3, min_reads=500, min_spots=20, min_mean=20, max_cv=0.6).select("site", "gene")


@add("agg07_report", "SELECT site, total >= 500 AS pass_reads, n_spots >= 20 AS pass_spots, n_spots > 0 AND mean >= 20 AS pass_mean, coalesce(cv <= 0.6, false) AS pass_cv FROM metrics", _METRICS)
def _(v):
    return quantify.site_report(v.counts, 500, 20, 20, 0.6).select("site", "pass_reads", "pass_spots", "pass_mean", "pass_cv")


@add("agg08_by_gene", "SELECT gene, count(*) AS n, string_agg(CAST(site AS VARCHAR), ',' ORDER BY site) AS sites FROM site GROUP BY gene")
def _(v):
    return v.sites.groupBy("gene").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("site")), ",").alias("sites"))


_SITEUSE = "su AS (SELECT site, gene, spot, CASE WHEN sum(count) OVER (PARTITION BY gene, spot) >= 200 THEN count / sum(count) OVER (PARTITION BY gene, spot) END AS usage FROM counts JOIN ranked USING (site) WHERE n >= 2)"


@add("agg10_site_usage", "SELECT site, gene, spot, round(usage, 6) AS usage FROM su", _SITEUSE)
def _(v):
    return rounded(quantify.site_usage(v.counts, v.sites, 200), "usage")


@add("agg11_max_distal", "SELECT gene, round(avg(usage), 6) AS usage FROM su JOIN (SELECT site, CASE WHEN strand = '-' THEN -coord ELSE coord END AS o, max(CASE WHEN strand = '-' THEN -coord ELSE coord END) OVER (PARTITION BY gene) AS far FROM site) USING (site) WHERE o = far AND usage IS NOT NULL GROUP BY gene", _SITEUSE)
def _(v):
    return rounded(quantify.max_distal_usage(v.counts, v.sites, 200), "usage")


@add("agg12_bins", "SELECT site, bx, by_ AS by, CAST(count AS BIGINT) AS count, round(count / sum(count) OVER (PARTITION BY bx, by_), 6) AS usage, bx * 250 + 125 AS cx, by_ * 250 + 125 AS cy FROM (SELECT site, x // 250 AS bx, y // 250 AS by_, sum(count) AS count FROM counts JOIN spot USING (spot) GROUP BY ALL)")
def _(v):
    return rounded(quantify.bin_counts(v.counts, v.spots, 250), "usage")


@add("agg13_roll_up", "SELECT gene, size, x // size AS bx, y // size AS by, round(avg(value), 6) AS value, count(value) AS n FROM usage JOIN spot USING (spot), (SELECT unnest([100, 200, 400]) AS size) GROUP BY ALL")
def _(v):
    return rounded(quantify.roll_up(v.usage, v.spots, [100, 200, 400]), "value")


@add("agg14_parents", "SELECT gene, spot // 4 AS parent, round(avg(value), 6) AS value FROM obs GROUP BY ALL")
def _(v):
    return v.observed.groupBy("gene", F.floor(F.col("spot") / 4).alias("parent")).agg(r6(F.avg("value"), "value"))


@add("agg15_domain_stats", "SELECT domain, (SELECT count(*) FROM spot s WHERE s.domain = d.domain) AS n_spots, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median FROM obs JOIN spot d USING (spot) GROUP BY domain")
def _(v):
    return rounded(quantify.domain_stats(v.observed, v.spots), "mean", "std", "median").select("domain", "n_spots", "mean", "std", "median")


@add("agg17_domain_gene", "SELECT sample, domain, gene, round(avg(value), 6) AS value FROM obs JOIN spot USING (spot) GROUP BY ALL")
def _(v):
    return v.observed.join(v.spots, "spot").groupBy("sample", "domain", "gene").agg(r6(F.avg("value"), "value"))


@add("agg18_profile", "SELECT round(sum(o) / (ns * ng), 6) AS observed, round(sum(p) / (ns * ng), 6) AS positive, median(o) AS median_observed, median(p) AS median_positive FROM (SELECT spot, count(value) AS o, count(*) FILTER (value > 0) AS p FROM usage GROUP BY spot), (SELECT count(*) AS ns FROM spot), (SELECT count(DISTINCT gene) AS ng FROM site) GROUP BY ns, ng")
def _(v):
    n, g = v.spots.count(), v.sites.select("gene").distinct().count()
    return rounded(quantify.profile(v.usage, n, g), "observed", "positive").drop("highres")


@add("agg19_coverage", "SELECT count(*) AS cells, count(value) AS observed, round(count(value) / count(*), 6) AS fraction FROM usage")
def _(v):
    return v.usage.agg(F.count("*").alias("cells"), F.count("value").alias("observed"), r6(F.count("value") / F.count("*"), "fraction"))


@add("agg20_summary", "SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median FROM obs")
def _(v):
    c = F.col("value")
    return v.observed.agg(r6(F.avg(c), "mean"), r6(F.stddev_pop(c), "std"), r6(F.min(c), "min"), r6(F.max(c), "max"), r6(F.percentile(c, F.lit(0.5)), "median"))


@add("agg21_dropout", "SELECT 'spot' AS kind, spot AS id, round(avg(CAST(value IS NULL AS DOUBLE)), 6) AS missing FROM usage GROUP BY spot UNION ALL SELECT 'gene', gene, round(avg(CAST(value IS NULL AS DOUBLE)), 6) FROM usage GROUP BY gene")
def _(v):
    part = lambda k: v.usage.groupBy(F.lit(k).alias("kind"), F.col(k).alias("id")).agg(r6(F.avg(F.col("value").isNull().cast("double")), "missing"))
    return part("spot").union(part("gene"))


@add("agg22_sample_level", "SELECT gene, round(avg(m) FILTER (batch = 0), 6) AS mean_a, round(avg(m) FILTER (batch = 1), 6) AS mean_b, min(m) FILTER (batch = 0) > max(m) FILTER (batch = 1) OR max(m) FILTER (batch = 0) < min(m) FILTER (batch = 1) AS direction_agree FROM (SELECT gene, sample, batch, avg(value) AS m FROM obs JOIN spot USING (spot) GROUP BY ALL) GROUP BY gene")
def _(v):
    return rounded(quantify.sample_means(v.observed, v.spots), "mean_a", "mean_b")


@add("agg23_majority", "SELECT chr, kind FROM (SELECT chr, kind, row_number() OVER (PARTITION BY chr ORDER BY count(*) DESC, kind) AS k FROM site GROUP BY chr, kind) WHERE k = 1")
def _(v):
    n = v.sites.groupBy("chr", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("chr").agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("kind"))


@add("agg25_lists", "SELECT gene, string_agg(kind || ':' || n, ',' ORDER BY kind) AS motifs, count(*) AS n_motifs, CAST(sum(n) AS BIGINT) AS n_sites FROM (SELECT gene, kind, count(*) AS n FROM site GROUP BY ALL) GROUP BY gene")
def _(v):
    n = v.sites.groupBy("gene", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("gene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit(":"), x["n"].cast("string"))), ",").alias("motifs"), F.count("*").alias("n_motifs"), F.sum("n").alias("n_sites"))


@add("agg26_rewiring", "SELECT gene, domain, round(avg(value) FILTER (batch = 1) - avg(value) FILTER (batch = 0), 6) AS delta FROM obs JOIN spot USING (spot) GROUP BY gene, domain UNION ALL SELECT gene, NULL, round(avg(value) FILTER (batch = 1) - avg(value) FILTER (batch = 0), 6) FROM obs JOIN spot USING (spot) GROUP BY gene")
def _(v):
    j = v.observed.join(v.spots, "spot")
    mean = lambda b: F.avg(F.when(F.col("batch") == b, F.col("value")))
    j = j.withColumn("both", F.explode(F.array(F.col("domain"), F.lit(None).cast("int"))))
    return j.groupBy("gene", F.col("both").alias("domain")).agg(r6(mean(1) - mean(0), "delta"))


@add("agg27_perturbation", "SELECT gene, n, round(0.5 * sign * delta, 6) AS abundance_delta, round(abs(0.5 * sign * delta), 6) AS impact FROM (SELECT gene, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN -1 ELSE 1 END AS sign FROM site GROUP BY gene) JOIN (SELECT gene, avg(value) FILTER (batch = 1) - avg(value) FILTER (batch = 0) AS delta FROM obs JOIN spot USING (spot) GROUP BY gene) USING (gene)")
def _(v):
    j = v.observed.join(v.spots, "spot").groupBy("gene").agg((F.avg(F.when(F.col("batch") == 1, F.col("value"))) - F.avg(F.when(F.col("batch") == 0, F.col("value")))).alias("delta"))
    n = v.sites.groupBy("gene").agg(F.count("*").alias("n")).withColumn("sign", F.when(F.col("n") % 2 == 0, -1).otherwise(1))
    d = 0.5 * F.col("sign") * F.col("delta")
    return n.join(j, "gene").select("gene", "n", r6(d, "abundance_delta"), r6(F.abs(d), "impact"))


@add("agg29_pivot", "SELECT gene, round(avg(value) FILTER (domain = 0), 6) AS d0, round(avg(value) FILTER (domain = 1), 6) AS d1, round(avg(value) FILTER (domain = 2), 6) AS d2 FROM obs JOIN spot USING (spot) GROUP BY gene")
def _(v):
    p = v.observed.join(v.spots, "spot").groupBy("gene").pivot("domain", [0, 1, 2]).avg("value")
    return p.select("gene", *[r6(F.col(f"`{i}`"), f"d{i}") for i in range(3)])


# --- windows -----------------------------------------------------------------------------------


@add("win01_site_rank", "SELECT site, gene, CAST(rn AS INTEGER) AS rn, n FROM ranked")
def _(v):
    return quantify.ranked_sites(v.sites).select("site", "gene", "rn", "n")


def _islands_sql(reach: int) -> str:
    return f"""
fl AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY chr, strand ORDER BY s, e, site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL OR s - max(e) OVER (PARTITION BY chr, strand ORDER BY s, e, site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {reach} THEN 1 ELSE 0 END AS b FROM site),
isl AS (SELECT *, sum(b) OVER (PARTITION BY chr, strand ORDER BY s, e, site) AS island FROM fl)"""


@add("win02_merge", "SELECT chr, strand, min(s) AS s, max(e) AS e, max(support) AS support, CAST(sum(reads) AS BIGINT) AS reads, arg_min(gene, s * 100000000 + site) AS gene, count(*) AS n FROM isl GROUP BY chr, strand, island", _islands_sql(10))
def _(v):
    return intervals.merge(v.sites, 10)


@add("win03_consensus", "SELECT chr, strand, min(s) AS s, max(e) AS e, count(DISTINCT reads % 4) AS n_samples, count(*) AS n_sites, string_agg(CAST(site AS VARCHAR), ',' ORDER BY CAST(site AS VARCHAR)) AS members, min(top) AS gene FROM (SELECT i.*, t.gene AS top FROM isl i JOIN (SELECT chr, strand, island, gene, row_number() OVER (PARTITION BY chr, strand, island ORDER BY count(*) DESC, gene) AS k FROM isl GROUP BY chr, strand, island, gene) t ON i.chr = t.chr AND i.strand = t.strand AND i.island = t.island AND t.k = 1) GROUP BY chr, strand, island", _islands_sql(8))
def _(v):
    return intervals.consensus(v.sites.withColumn("sample", F.col("reads") % 4), "sample", 8)


@add("win04_cluster_overlap", "SELECT count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard FROM (SELECT bool_or(site % 3 = 0) AS a, bool_or(site % 3 <> 0) AS b FROM (SELECT *, sum(br) OVER (PARTITION BY chr, strand ORDER BY coord, site) AS k FROM (SELECT *, CASE WHEN coord - lag(coord) OVER (PARTITION BY chr, strand ORDER BY coord, site) > 35 THEN 1 ELSE 0 END AS br FROM site)) GROUP BY chr, strand, k)")
def _(v):
    p = v.sites.select("site", "chr", "strand", F.col("coord").alias("pos"), (F.col("site") % 3 != 0).cast("int").alias("caller"))
    return rounded(intervals.cluster_overlap(p, "caller", 35), "jaccard")


@add("win05_rank_quantile", "SELECT gene, spot, round((row_number() OVER (PARTITION BY gene ORDER BY value, spot) - 1) / count(*) OVER (PARTITION BY gene), 6) AS q FROM obs")
def _(v):
    w = Window.partitionBy("gene")
    return v.observed.select("gene", "spot", r6((F.row_number().over(w.orderBy("value", "spot")) - 1) / F.count("*").over(w), "q"))


@add("win06_scale", "SELECT gene, spot, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-10), 5) AS z, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-10), 6) AS unit FROM obs WINDOW w AS (PARTITION BY gene)")
def _(v):
    w, c = Window.partitionBy("gene"), F.col("value")
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return v.observed.select("gene", "spot", F.round((c - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-10), 5).alias("z"), r6((c - lo) / (hi - lo + 1e-10), "unit"))


_QN = """
v0 AS (SELECT gene, spot, batch, value FROM obs JOIN spot USING (spot)),
pooled AS (SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY value, spot) - 1 AS j, value AS ref FROM v0),
v1 AS (SELECT *, count(*) OVER (PARTITION BY gene, batch) AS nb, row_number() OVER (PARTITION BY gene, batch ORDER BY value, spot) - 1 AS r, count(*) OVER (PARTITION BY gene) AS m FROM v0),
v2 AS (SELECT *, least(greatest((r + 0.5) / nb * m - 0.5, 0.0), m - 1.0) AS at_ FROM v1)"""


@add("win07_quantile_normalize", "SELECT v2.gene, spot, round(CASE WHEN nb < 2 THEN value ELSE a.ref + (at_ - floor(at_)) * (b.ref - a.ref) END, 5) AS normalized FROM v2 JOIN pooled a ON a.gene = v2.gene AND a.j = floor(at_) JOIN pooled b ON b.gene = v2.gene AND b.j = ceil(at_)", _QN)
def _(v):
    q = impute.quantile_normalize(v.observed.join(v.spots.select("spot", "batch"), "spot"))
    return q.select("gene", "spot", F.round("normalized", 5).alias("normalized"))


@add("win08_quantile_bins", "SELECT gene, spot, CASE WHEN std <= a THEN 0 WHEN std <= b THEN 1 WHEN std <= c THEN 2 WHEN std <= d THEN 3 ELSE 4 END AS bin FROM pred, (SELECT round(quantile_cont(std, 0.2), 8) AS a, round(quantile_cont(std, 0.4), 8) AS b, round(quantile_cont(std, 0.6), 8) AS c, round(quantile_cont(std, 0.8), 8) AS d FROM pred)")
def _(v):
    e = v.pred.agg(*[F.round(F.percentile("std", F.lit(q)), 8).alias(n) for n, q in zip("abcd", (0.2, 0.4, 0.6, 0.8))])
    b = F.lit(4)
    for i, n in reversed(list(enumerate("abcd"))):
        b = F.when(F.col("std") <= F.col(n), i).otherwise(b)
    return v.pred.crossJoin(F.broadcast(e)).select("gene", "spot", b.alias("bin"))


@add("win09_reliability", "SELECT gene, bin, count(*) AS n, round(avg(std), 6) AS mean_std, round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse, round(avg(CAST(abs(pred - truth) <= std AS DOUBLE)), 6) AS within FROM (SELECT *, ntile(4) OVER (PARTITION BY gene ORDER BY std, spot) AS bin FROM pred) GROUP BY ALL")
def _(v):
    d = F.col("pred") - F.col("truth")
    b = v.pred.withColumn("bin", F.ntile(4).over(Window.partitionBy("gene").orderBy("std", "spot")))
    return b.groupBy("gene", "bin").agg(F.count("*").alias("n"), r6(F.avg("std"), "mean_std"), r6(F.sqrt(F.avg(d * d)), "rmse"), r6(F.avg((F.abs(d) <= F.col("std")).cast("double")), "within"))


@add("win10_risk_coverage", "SELECT gene, keep, round(sqrt(avg(e2)), 6) AS rmse FROM (SELECT gene, (pred - truth) * (pred - truth) AS e2, row_number() OVER (PARTITION BY gene ORDER BY std, spot) AS k, count(*) OVER (PARTITION BY gene) AS n FROM pred), (SELECT unnest([20, 40, 60, 80, 100]) AS keep) WHERE k <= greatest(1, (n * keep + 50) // 100) GROUP BY ALL")
def _(v):
    w = Window.partitionBy("gene")
    d = v.pred.select("gene", F.pow(F.col("pred") - F.col("truth"), 2).alias("e2"), F.row_number().over(w.orderBy("std", "spot")).alias("k"), F.count("*").over(w).alias("n"))
    d = d.withColumn("keep", F.explode(F.array(*map(F.lit, (20, 40, 60, 80, 100))))).where("k <= greatest(1, (n * keep + 50) div 100)")
    return d.groupBy("gene", "keep").agg(r6(F.sqrt(F.avg("e2")), "rmse"))


_PATH = """
step AS (SELECT domain, spot, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d FROM spot WINDOW w AS (PARTITION BY domain ORDER BY spot)),
cum AS (SELECT domain, spot, sum(d) OVER (PARTITION BY domain ORDER BY spot) AS c, sum(d) OVER (PARTITION BY domain) AS t FROM step),
pseudo AS (SELECT domain, spot, CASE WHEN t > 0 THEN round(c / t, 9) ELSE 0 END AS p FROM cum)"""


def _pseudo(v):
    w = Window.partitionBy("domain").orderBy("spot")
    sq = lambda c: F.pow(F.col(c) - F.lag(c).over(w), 2)
    s = v.spots.select("domain", "spot", F.coalesce(F.sqrt(sq("x") + sq("y")), F.lit(0.0)).alias("d"))
    t = F.sum("d").over(Window.partitionBy("domain"))
    return s.withColumn("c", F.sum("d").over(w)).select("domain", "spot", F.when(t > 0, F.round(F.col("c") / t, 9)).otherwise(0.0).alias("p"))


@add("win11_pseudospace", "SELECT domain, spot, round(p, 6) AS p FROM pseudo", _PATH)
def _(v):
    return rounded(_pseudo(v), "p")


_CURVE = _PATH + ", curve AS (SELECT gene, domain, CAST(least(floor(p * 5), 4) AS BIGINT) AS bin, round(avg(value), 9) AS m FROM obs JOIN pseudo USING (spot) GROUP BY ALL)"


def _curve(v):
    return v.observed.join(_pseudo(v), "spot").groupBy("gene", "domain", F.least(F.floor(F.col("p") * 5), F.lit(4).cast("bigint")).alias("bin")).agg(F.round(F.avg("value"), 9).alias("m"))


@add("win12_curve", "SELECT gene, domain, bin, round(m, 6) AS m FROM curve", _CURVE)
def _(v):
    return rounded(_curve(v), "m")


_GRAD = _CURVE + """, grad AS (SELECT *, CASE WHEN lag(m) OVER w IS NULL THEN lead(m) OVER w - m WHEN lead(m) OVER w IS NULL THEN m - lag(m) OVER w ELSE (lead(m) OVER w - lag(m) OVER w) / 2 END AS g FROM curve WINDOW w AS (PARTITION BY gene, domain ORDER BY bin)),
turn AS (SELECT *, sign(round(g, 7)) <> sign(round(lag(g) OVER (PARTITION BY gene, domain ORDER BY bin), 7)) AS turned FROM grad)"""


def _turns(v):
    w = Window.partitionBy("gene", "domain").orderBy("bin")
    before, after = F.lag("m").over(w), F.lead("m").over(w)
    g = F.when(before.isNull(), after - F.col("m")).when(after.isNull(), F.col("m") - before).otherwise((after - before) / 2)
    c = _curve(v).withColumn("g", g)
    return c.withColumn("turned", F.signum(F.round("g", 7)) != F.signum(F.round(F.lag("g").over(w), 7)))


@add("win13_turns", "SELECT gene, domain, bin FROM turn WHERE turned", _GRAD)
def _(v):
    return _turns(v).where("turned").select("gene", "domain", "bin")


@add("win14_dynamic", "SELECT gene, domain, round(var_pop(m), 6) AS variance, round(max(m) - min(m), 6) AS range_, count(*) FILTER (turned) AS n_turns FROM turn GROUP BY ALL", _GRAD)
def _(v):
    return _turns(v).groupBy("gene", "domain").agg(r6(F.var_pop("m"), "variance"), r6(F.max("m") - F.min("m"), "range_"), F.count_if("turned").alias("n_turns"))


@add("win15_class", "SELECT gene, domain, CASE WHEN count(*) < 3 THEN 'stable' WHEN count(*) FILTER (turned) >= 2 THEN 'switch' WHEN round(corr(bin, m), 6) > 0.5 THEN 'increasing' WHEN round(corr(bin, m), 6) < -0.5 THEN 'decreasing' ELSE 'stable' END AS class FROM turn GROUP BY ALL", _GRAD)
def _(v):
    r = F.round(F.corr("bin", "m"), 6)
    return _turns(v).groupBy("gene", "domain").agg(F.when(F.count("*") < 3, "stable").when(F.count_if("turned") >= 2, "switch").when(r > 0.5, "increasing").when(r < -0.5, "decreasing").otherwise("stable").alias("class"))


@add("win17_holdout", "SELECT gene, spot FROM (SELECT gene, spot, row_number() OVER (PARTITION BY gene ORDER BY md5(gene || '-' || spot), spot) AS k, count(*) OVER (PARTITION BY gene) AS n FROM obs) WHERE n >= 5 AND k <= greatest(1, n // 5)")
def _(v):
    w = Window.partitionBy("gene")
    h = F.md5(F.concat_ws("-", "gene", "spot"))
    return v.observed.withColumn("k", F.row_number().over(w.orderBy(h, "spot"))).withColumn("n", F.count("*").over(w)).where("n >= 5 AND k <= greatest(1, n div 5)").select("gene", "spot")


# --- top-k, sets, reshape ----------------------------------------------------------------------


@add("top01_rank_genes", "SELECT gene, round(padj, 6) AS padj FROM adj ORDER BY padj, gene LIMIT 10", _BH)
def _(v):
    return _adjusted(v).orderBy("padj", "gene").limit(10).select("gene", r6(F.col("padj"), "padj"))


@add("top03_variable_genes", "SELECT gene, round(var_pop(value), 6) AS v FROM obs GROUP BY gene ORDER BY round(var_pop(value), 9) DESC, gene LIMIT 15")
def _(v):
    g = v.observed.groupBy("gene").agg(F.var_pop("value").alias("v"))
    return g.orderBy(F.round("v", 9).desc(), "gene").limit(15).select("gene", r6(F.col("v"), "v"))


@add("top04_observed_genes", "SELECT gene, count(*) AS n FROM obs GROUP BY gene HAVING count(*) >= 5 ORDER BY n DESC, gene LIMIT 20")
def _(v):
    return v.observed.groupBy("gene").agg(F.count("*").alias("n")).where("n >= 5").orderBy(F.desc("n"), "gene").limit(20)


@add("top05_recovered", "SELECT count(*) AS recovered FROM (SELECT gene FROM diff ORDER BY p, gene LIMIT 20) WHERE gene % 2 = 0")
def _(v):
    ref = v.sites.select("gene").distinct().where("gene % 2 = 0")
    return v.diff.orderBy("p", "gene").limit(20).join(ref, "gene", "left_semi").agg(F.count("*").alias("recovered"))


@add("set01_pool", "SELECT sample || ':' || spot AS spot, gene, round(value, 6) AS value FROM usage JOIN spot USING (spot)")
def _(v):
    return v.usage.join(v.spots, "spot").select(F.concat_ws(":", "sample", "spot").alias("spot"), "gene", r6(F.col("value"), "value"))


@add("set02_common", "SELECT gene FROM obs JOIN spot USING (spot) GROUP BY gene HAVING count(DISTINCT domain) = (SELECT count(DISTINCT domain) FROM spot)")
def _(v):
    n = v.spots.agg(F.count_distinct("domain").alias("n"))
    return v.observed.join(v.spots, "spot").groupBy("gene").agg(F.count_distinct("domain").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("gene")


@add("set03_jaccard", "SELECT a, b, round(both_ / (na + nb - both_), 6) AS jaccard FROM (SELECT a.domain AS a, b.domain AS b, count(*) AS both_ FROM hi a JOIN hi b ON a.gene = b.gene AND a.domain < b.domain GROUP BY ALL) JOIN (SELECT domain AS a, count(*) AS na FROM hi GROUP BY ALL) USING (a) JOIN (SELECT domain AS b, count(*) AS nb FROM hi GROUP BY ALL) USING (b)", "hi AS (SELECT domain, gene FROM obs JOIN spot USING (spot) GROUP BY ALL HAVING round(avg(value), 6) > 0.49)")
def _(v):
    hi = v.observed.join(v.spots, "spot").groupBy("domain", "gene").agg(F.round(F.avg("value"), 6).alias("m")).where("m > 0.49")
    n = hi.groupBy("domain").agg(F.count("*").alias("n"))
    both = hi.select("gene", F.col("domain").alias("a")).join(hi.select("gene", F.col("domain").alias("b")), "gene").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    j = both.join(n.select(F.col("domain").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("domain").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", r6(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), "jaccard"))


@add("set04_dedup", "SELECT gene, chr, site FROM (SELECT *, row_number() OVER (PARTITION BY gene, chr, reads ORDER BY site) AS k FROM site) WHERE k = 1")
def _(v):
    return v.sites.withColumn("k", F.row_number().over(Window.partitionBy("gene", "chr", "reads").orderBy("site"))).where("k = 1").select("gene", "chr", "site")


@add("set05_requantify", "SELECT chr, strand, CAST(island AS BIGINT) AS island, spot, CAST(sum(count) AS BIGINT) AS count FROM counts JOIN isl USING (site) GROUP BY ALL", _islands_sql(10))
def _(v):
    i = intervals.islands(v.sites, ["chr", "strand"], "s", "e", 10, "site").select("site", "chr", "strand", "island")
    counts, tasks = v.dealt_counts()
    key = ["chr", "strand", "island", "spot"]
    return counts.join(i, "site").select(*key, "count").repartition(tasks, *key).groupBy(*key).agg(F.sum("count").alias("count"))


@add("set06_explode", "SELECT w, count(*) AS n FROM (SELECT trim(unnest(string_split(p_type || ';' || p_brand, ';'))) AS w FROM part) WHERE w <> '' GROUP BY w")
def _(v):
    w = F.explode(F.split(F.concat_ws(";", "p_type", "p_brand"), ";"))
    return v.table("part").select(w.alias("w")).select(F.trim("w").alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))


@add("set07_stack", "SELECT gene, 'mean' AS index_type, round(avg(value), 6) AS value FROM obs GROUP BY gene UNION ALL SELECT gene, 'std', round(stddev_pop(value), 6) FROM obs GROUP BY gene")
def _(v):
    g = v.observed.groupBy("gene").agg(r6(F.avg("value"), "mean"), r6(F.stddev_pop("value"), "std"))
    return g.unpivot(["gene"], ["mean", "std"], "index_type", "value")


@add("set08_relabel", "SELECT spot, CAST(dense_rank() OVER (ORDER BY sample) - 1 AS INTEGER) AS label FROM spot")
def _(v):
    codes = v.spots.select("sample").distinct().withColumn("label", F.dense_rank().over(Window.orderBy("sample")) - 1)
    return v.spots.join(F.broadcast(codes), "sample").select("spot", "label")


@add("set09_replicate", "SELECT spot, unnest(range(1, 1 + 1 + spot % 4)) AS copy FROM spot")
def _(v):
    return v.spots.select("spot", F.explode(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("spot") % 4)).alias("copy"))


# --- scalar indices ----------------------------------------------------------------------------

_PD = "pd AS (SELECT gene, spot, total - distal AS p, distal AS d FROM gindex)"


@add("sca01_05_indices", "SELECT gene, spot, round(d / (p + d + 1), 6) AS rud, round(100 * d / (p + d + 1), 6) AS pdui, round(log2((d + 1) / (p + 1)), 6) AS pai, round((d - p) / (p + d + 1), 6) AS pai_ratio FROM pd", _PD)
def _(v):
    g = quantify.gene_index(v.counts, v.sites, 0)
    p, d = F.col("total") - F.col("distal"), F.col("distal")
    return g.select("gene", "spot", r6(quantify.rud(p, d), "rud"), r6(quantify.pdui(p, d), "pdui"), r6(quantify.pai(p, d), "pai"), r6(quantify.pai(p, d, "ratio"), "pai_ratio"))


@add("sca04_wul", "SELECT gene, spot, round(CASE WHEN max(hi) = min(lo) THEN 0.5 ELSE (sum(count * coord) / (sum(count) + 1) - min(lo)) / (max(hi) - min(lo)) END, 6) AS wul FROM counts JOIN (SELECT site, gene, coord, min(coord) OVER (PARTITION BY gene) AS lo, max(coord) OVER (PARTITION BY gene) AS hi FROM site) USING (site) GROUP BY gene, spot")
def _(v):
    return rounded(quantify.wul(v.counts, v.sites), "wul")


@add("sca07_confidence", "SELECT gene, spot, round(least(greatest(1 / (std + 1e-6) / m, 0), 10), 6) AS confidence FROM pred, (SELECT median(1 / (std + 1e-6)) AS m FROM pred)")
def _(v):
    c = 1 / (F.col("std") + 1e-6)
    m = v.pred.agg(F.percentile(c, F.lit(0.5)).alias("m"))
    return v.pred.crossJoin(F.broadcast(m)).select("gene", "spot", r6(F.least(F.greatest(c / F.col("m"), F.lit(0.0)), F.lit(10.0)), "confidence"))


@add("sca08_geometry", "SELECT spot, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 6) AS radius, round(atan2(y - my, x - mx), 6) AS theta FROM spot, (SELECT avg(x) AS mx, avg(y) AS my FROM spot)")
def _(v):
    m = v.spots.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return v.spots.crossJoin(F.broadcast(m)).select("spot", r6(F.hypot(dx, dy), "radius"), r6(F.atan2(dy, dx), "theta"))


@add("sca09_log2fc", "SELECT gene, log2fc FROM diff")
def _(v):
    return v.diff.select("gene", "log2fc")


@add("sca10_segments", "SELECT gene, chr, strand, CASE WHEN strand = '+' THEN min(coord) ELSE max(coord) END AS proximal, CASE WHEN strand = '+' THEN max(coord) ELSE min(coord) END AS distal FROM site GROUP BY gene, chr, strand HAVING count(*) >= 2")
def _(v):
    return intervals.segments(v.sites).select("gene", "chr", "strand", "proximal", "distal")


@add("sca11_revcomp", "SELECT p_partkey AS site, reverse(translate(upper(substr(p_name, 2, 6)), 'ACGT', 'TGCA')) AS seq FROM part")
def _(v):
    return v.table("part").select(F.col("p_partkey").alias("site"), F.reverse(F.translate(F.upper(F.substring("p_name", 2, 6)), "ACGT", "TGCA")).alias("seq"))


@add("sca12_retag", "SELECT spot, 'C' || x || '_' || y AS cb, substr(CAST(spot AS VARCHAR) || 'NNNNN', 1, 5) AS umi FROM spot")
def _(v):
    return v.spots.select("spot", F.concat(F.lit("C"), F.concat_ws("_", "x", "y")).alias("cb"), F.substring(F.concat(F.col("spot").cast("string"), F.lit("NNNNN")), 1, 5).alias("umi"))


@add("sca13_signed_load", "SELECT gene, CAST(sum(CASE kind WHEN (SELECT min(kind) FROM site) THEN 1 WHEN (SELECT max(kind) FROM site) THEN 1 ELSE -1 END) AS BIGINT) AS load FROM site GROUP BY gene")
def _(v):
    signs = v.sites.agg(F.array(F.min("kind"), F.max("kind")).alias("k")).select(F.explode("k").alias("kind"), F.lit(1).alias("sign")).distinct()
    return v.sites.join(F.broadcast(signs), "kind", "left").groupBy("gene").agg(F.sum(F.coalesce("sign", F.lit(-1))).alias("load"))


@add("sca14_volcano", "SELECT gene, round(-log10(p + 1e-300), 6) AS y, CASE WHEN padj < 0.05 AND log2fc > 0.01 THEN 'up' WHEN padj < 0.05 AND log2fc < -0.01 THEN 'down' ELSE 'ns' END AS class FROM adj", _BH)
def _(v):
    s = F.col("padj") < 0.05
    return _adjusted(v).select("gene", r6(-F.log10(F.col("p") + 1e-300), "y"), F.when(s & (F.col("log2fc") > 0.01), "up").when(s & (F.col("log2fc") < -0.01), "down").otherwise("ns").alias("class"))


# --- spatial -----------------------------------------------------------------------------------

_W = _KNN + """,
wi AS (SELECT src, dst, d2, v / sum(v) OVER (PARTITION BY src) AS w FROM (SELECT *, 1 / (sqrt(d2) + 1e-6) AS v FROM knn)),
sym AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn))"""


@add("spa01_weights", "SELECT src, dst, round(w, 6) AS w FROM wi", _W)
def _(v):
    return rounded(spatial.weights(_knn(v)), "w")


@add("spa02_symmetric", "SELECT src, dst, round(w, 6) AS w FROM sym", _W)
def _(v):
    return rounded(spatial.symmetric(_knn(v)), "w")


_SUP = _W + f""",
big AS (SELECT site, spot, CASE WHEN count > 30 THEN count ELSE 0 END AS count FROM counts),
sup AS (
  SELECT a.site, a.spot, count(b.spot) / {K}.0 AS support, coalesce(sum(w.w) FILTER (b.spot IS NOT NULL), 0) AS weighted
  FROM big a JOIN wi w ON a.spot = w.src LEFT JOIN big b ON b.site = a.site AND b.spot = w.dst AND b.count > 0 WHERE a.count > 0 GROUP BY a.site, a.spot)"""


def _big(v):
    return v.counts.select("site", "spot", F.when(F.col("count") > 30, F.col("count")).otherwise(0).alias("count"))


@add("spa03_site_support", "SELECT site, round(coalesce(avg(support) FILTER (support > 0), 0), 6) AS score, round(coalesce(avg(support) FILTER (support > 0), 0), 9) >= 0.3 AS valid FROM sup GROUP BY site", _SUP)
def _(v):
    return rounded(spatial.site_support(_big(v), _knn(v)), "score")


@add("spa04_weighted_support", "SELECT site, spot, round(weighted, 6) AS support FROM sup", _SUP)
def _(v):
    return rounded(spatial.support(_big(v), _knn(v), weighted=True), "support")


@add("spa05_consistent", "SELECT big.site, big.spot, CASE WHEN coalesce(support, 0) >= 0.3 THEN count ELSE 0 END AS count FROM big LEFT JOIN sup USING (site, spot)", _SUP)
def _(v):
    return spatial.consistent_counts(_big(v), _knn(v))


_MORAN = _W + """,
zz AS (SELECT gene, spot, value - avg(value) OVER (PARTITION BY gene) AS z FROM obs),
own AS (SELECT gene, count(*) AS n, sum(z * z) AS ss FROM zz GROUP BY gene),
cross_ AS (SELECT a.gene, sum(w) AS s0, sum(w * a.z * b.z) AS c, sum(w * (a.z - b.z) * (a.z - b.z)) AS g FROM zz a JOIN sym ON a.spot = sym.src JOIN zz b ON b.gene = a.gene AND b.spot = sym.dst GROUP BY a.gene)"""


@add("spa06_07_autocorrelation", "SELECT gene, n, round(CASE WHEN n >= 3 AND ss > 1e-12 AND s0 > 0 THEN n / s0 * c / ss END, 6) AS morans_i, round(CASE WHEN n >= 3 AND ss > 1e-12 AND s0 > 0 THEN (n - 1) / (2 * s0) * g / ss END, 6) AS gearys_c FROM own LEFT JOIN cross_ USING (gene)", _MORAN)
def _(v):
    return rounded(spatial.autocorrelation(v.observed, spatial.symmetric(_knn(v))), "morans_i", "gearys_c")


@add("spa08_permutation")
def _(v):
    return impute.permutation_p(v.usage, spatial.symmetric(_knn(v)), 100)


@add("spa09_table")
def _(v):
    t = impute.permutation_p(v.usage, spatial.symmetric(_knn(v)), 100).where("n >= 10").withColumn("c", F.lit(1))
    return stats.adjust(t, ["c"]).drop("c").withColumn("significant", F.col("padj") < 0.05)


@add("spa10_moments", "SELECT round((SELECT sum(pow(coalesce(a.w, 0) + coalesce(b.w, 0), 2)) / 2 FROM sym a FULL JOIN sym b ON a.src = b.dst AND a.dst = b.src), 5) AS s1, round(sum(t * t), 5) AS s2, round(sum(t) / 2, 5) AS s0 FROM (SELECT k, sum(w) AS t FROM (SELECT src AS k, w FROM sym UNION ALL SELECT dst, w FROM sym) GROUP BY k)", _W)
def _(v):
    m = spatial.moran_moments(spatial.symmetric(_knn(v)))
    return m.select(*[F.round(c, 5).alias(c) for c in ("s1", "s2", "s0")])


@add("spa16_similarity", "SELECT a.gene AS a, b.gene AS b, count(*) AS n, round(corr(a.value, b.value), 5) AS pearson, round(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)), 5) AS cosine FROM obs a JOIN obs b ON a.spot = b.spot AND b.gene > a.gene GROUP BY ALL HAVING count(*) >= 3")
def _(v):
    b = v.observed.select(F.col("gene").alias("b"), "spot", F.col("value").alias("y"))
    j = v.observed.select(F.col("gene").alias("a"), "spot", F.col("value").alias("x")).join(b, "spot").where("a < b")
    cosine = F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    return j.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 5).alias("pearson"), F.round(cosine, 5).alias("cosine")).where("n >= 3")


@add("spa20_fidelity", "SELECT round(corr(a, b), 5) AS fidelity FROM (SELECT pred - avg(pred) OVER (PARTITION BY gene) AS a, m - avg(m) OVER (PARTITION BY gene) AS b FROM (SELECT p.gene, p.spot, p.truth + 0.01 * (p.spot % 5) AS pred, avg(q.truth) AS m FROM pred p JOIN knn ON p.spot = knn.src JOIN pred q ON q.gene = p.gene AND q.spot = knn.dst GROUP BY p.gene, p.spot, p.truth))", _KNN)
def _(v):
    p = v.pred.withColumn("pred", F.col("truth") + 0.01 * (F.col("spot") % 5))
    return spatial.fidelity(p, _knn(v)).select(F.round("fidelity", 5).alias("fidelity"))


# --- tests -------------------------------------------------------------------------------------

_GROUPS = "gr AS (SELECT gene, value, CASE WHEN domain = 0 THEN 1 ELSE 2 END AS g FROM obs JOIN spot USING (spot))"
_U = _GROUPS + """,
rk AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene, value) AS t FROM gr),
us AS (SELECT gene, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 2) AS n2, sum(r) FILTER (g = 1) - count(*) FILTER (g = 1) * (count(*) FILTER (g = 1) + 1) / 2 AS u, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM rk GROUP BY gene)"""


def _groups(v):
    return v.observed.join(v.spots, "spot").select("gene", "value", F.when(F.col("domain") == 0, 1).otherwise(2).alias("g"))


@add("sta01_rank_sum", "SELECT gene, n1, n2, u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 5) AS z FROM us WHERE n1 > 0 AND n2 > 0", _U)
def _(v):
    return stats.rank_sum(_groups(v), ["gene"]).withColumn("z", F.round("z", 5))


@add("sta01_p_values")
def _(v):
    return stats.rank_sum(_groups(v), ["gene"]).withColumn("p", stats.normal_p("z"))


_WELCH = _GROUPS + ", we AS (SELECT gene, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 2) AS n2, avg(value) FILTER (g = 1) AS m1, avg(value) FILTER (g = 2) AS m2, var_samp(value) FILTER (g = 1) AS v1, var_samp(value) FILTER (g = 2) AS v2 FROM gr GROUP BY gene)"


@add("sta02_welch", "SELECT gene, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df FROM we WHERE n1 > 1 AND n2 > 1", _WELCH)
def _(v):
    return stats.welch(_groups(v), ["gene"]).select("gene", F.round("t", 5).alias("t"), F.round("df", 4).alias("df"))


@add("sta05_adjust", "SELECT gene, round(padj, 6) AS bh, round(least(1.0, p * (SELECT count(*) FROM diff)), 6) AS bonferroni, round(least(1.0, padj_raw * (SELECT sum(1.0 / i) FROM range(1, 1 + (SELECT count(*) FROM diff)) t(i))), 6) AS by_ FROM (SELECT *, min(p * m / k) OVER (ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING) AS padj_raw, least(1.0, min(p * m / k) OVER (ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, gene) AS k FROM diff))")
def _(v):
    d = v.diff.withColumn("c", F.lit(1))
    a = stats.adjust(d, ["c"]).select("gene", r6(F.col("padj"), "bh"))
    b = stats.adjust(d, ["c"], method="bonferroni").select("gene", r6(F.col("padj"), "bonferroni"))
    c = stats.adjust(d, ["c"], method="by").select("gene", r6(F.col("padj"), "by_"))
    return a.join(b, "gene").join(c, "gene")


@add("sta06_all_pairs", "SELECT a, b, gene, sum(r) FILTER (domain = a) - count(*) FILTER (domain = a) * (count(*) FILTER (domain = a) + 1) / 2 AS u FROM (SELECT a, b, gene, domain, rank() OVER (PARTITION BY a, b, gene ORDER BY value) + (count(*) OVER (PARTITION BY a, b, gene, value) - 1) / 2.0 AS r FROM obs JOIN spot USING (spot) JOIN (SELECT p.domain AS a, q.domain AS b FROM (SELECT DISTINCT domain FROM spot) p, (SELECT DISTINCT domain FROM spot) q WHERE p.domain < q.domain) ON domain = a OR domain = b) GROUP BY a, b, gene HAVING count(*) FILTER (domain = a) >= 3 AND count(*) FILTER (domain = b) >= 3")
def _(v):
    return stats.all_pairs(v.observed.join(v.spots, "spot"), "domain", ["gene"]).select("a", "b", "gene", "u")


@add("sta07_markers", "SELECT d AS domain, gene, round(log2((avg(value) FILTER (domain <> d) + 1e-6) / (avg(value) FILTER (domain = d) + 1e-6)), 6) AS log2fc_rest_over_domain FROM obs JOIN spot USING (spot), (SELECT DISTINCT domain AS d FROM spot) GROUP BY d, gene HAVING count(*) FILTER (domain = d) > 0 AND count(*) FILTER (domain <> d) > 0")
def _(v):
    per = v.observed.join(v.spots, "spot").groupBy("gene", "domain").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("gene")
    m = per.withColumn("rest_n", F.sum("n").over(w) - F.col("n")).withColumn("rest", F.when(F.col("rest_n") > 0, F.try_divide(F.sum("s").over(w) - F.col("s"), F.col("rest_n"))))
    return m.where("rest_n > 0").select("domain", "gene", r6(F.log2((F.col("rest") + 1e-6) / (F.col("s") / F.col("n") + 1e-6)), "log2fc_rest_over_domain"))


@add("sta12_slope", "SELECT round(regr_slope(log10(n + 1), log10(total + 1)), 5) AS slope FROM (SELECT gene, count(*) AS n, sum(total) AS total FROM gindex GROUP BY gene HAVING count(*) > 0)")
def _(v):
    g = quantify.gene_index(v.counts, v.sites, 0).groupBy("gene").agg(F.count("*").alias("n"), F.sum("total").alias("total"))
    return g.agg(F.round(F.regr_slope(F.log10(F.col("n") + 1), F.log10(F.col("total") + 1)), 5).alias("slope"))


# --- imputation and uncertainty ----------------------------------------------------------------


@add("imp14_gene_mean", "SELECT gene, spot, round(coalesce(value, avg(value) OVER (PARTITION BY gene)), 6) AS imputed FROM usage")
def _(v):
    return impute.by_gene(v.usage).select("gene", "spot", r6(F.col("imputed"), "imputed"))


@add("imp14_gene_median", "SELECT gene, spot, round(coalesce(value, median(value) OVER (PARTITION BY gene)), 6) AS imputed FROM usage")
def _(v):
    return impute.by_gene(v.usage, "median").select("gene", "spot", r6(F.col("imputed"), "imputed"))


@add("imp15_neighbours", "SELECT u.gene, u.spot, round(coalesce(u.value, m.m, avg(u.value) OVER (PARTITION BY u.gene)), 6) AS imputed FROM usage u LEFT JOIN (SELECT o.gene, knn.src AS spot, avg(o.value) AS m FROM knn JOIN obs o ON o.spot = knn.dst GROUP BY ALL) m ON u.gene = m.gene AND u.spot = m.spot", _KNN)
def _(v):
    return impute.by_neighbours(v.usage, _knn(v)).select("gene", "spot", r6(F.col("imputed"), "imputed"))


@add("imp06_length_scale", "SELECT round(median(sqrt(d2)), 6) AS length_scale FROM knn WHERE rank = 5", _KNN)
def _(v):
    return _knn(v).where("rank = 5").agg(r6(F.percentile(F.sqrt(F.col("d2").cast("double")), F.lit(0.5)), "length_scale"))


@add("imp04_inducing_grid", "SELECT i, j, round(x0 + (x1 - x0) * i / 4, 6) AS x, round(y0 + (y1 - y0) * j / 4, 6) AS y FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM spot), range(5) a(i), range(5) b(j)")
def _(v):
    b = v.spots.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    g = b.withColumn("i", F.explode(F.expr("sequence(0L, 4L)"))).withColumn("j", F.explode(F.expr("sequence(0L, 4L)")))
    return g.select("i", "j", r6(F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / 4, "x"), r6(F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("j") / 4, "y"))


def _grid(v, m: int = 6):
    import numpy as np

    x0, x1, y0, y1 = v.spots.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return np.array([(x, y) for x in np.linspace(x0, x1, m) for y in np.linspace(y0, y1, m)])


@add("imp03_05_sparse_gp")
def _(v):
    return impute.sparse_gp(v.usage, v.spots, _grid(v), 150.0, 0.3)


@add("dom15_likelihood_ratio")
def _(v):
    return impute.likelihood_ratio(v.usage, v.spots, [50.0, 150.0, 400.0])


_LOCAL = _KNN + ", loc AS (SELECT o.gene, o.spot, o.value, count(n.value) AS k, avg(n.value) AS m, var_pop(n.value) AS var FROM obs o LEFT JOIN knn ON knn.src = o.spot LEFT JOIN obs n ON n.gene = o.gene AND n.spot = knn.dst GROUP BY o.gene, o.spot, o.value)"


_NEAR = """
op AS (SELECT gene, spot, value, x, y, count(*) OVER (PARTITION BY gene) AS n FROM obs JOIN spot USING (spot)),
nb AS (SELECT a.gene, a.spot, any_value(a.value) AS value, b.value AS v, row_number() OVER (PARTITION BY a.gene, a.spot ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.spot) AS k
  FROM op a JOIN op b ON a.gene = b.gene AND a.spot <> b.spot GROUP BY a.gene, a.spot, a.x, a.y, b.spot, b.value, b.x, b.y),
nm AS (SELECT gene, median(d) AS mad FROM (SELECT gene, spot, abs(any_value(value) - median(v)) AS d FROM nb WHERE k <= 8 GROUP BY gene, spot) GROUP BY gene)"""


@add("imp07_local_noise", "SELECT gene, any_value(n) AS n, round(greatest(CASE WHEN any_value(n) < 4 THEN var_pop(value) ELSE pow(1.4826 * any_value(mad), 2) END * 1000, 1e-3), 5) AS noise FROM op LEFT JOIN nm USING (gene) GROUP BY gene", _NEAR)
def _(v):
    return impute.local_noise(v.observed, v.spots).select("gene", "n", F.round("noise", 5).alias("noise"))


@add("imp08_spot_noise", "SELECT gene, spot, round(greatest(coalesce(CASE WHEN k >= 2 THEN var END, var_pop(value) OVER (PARTITION BY gene), 0.01), 1e-6) * 1000, 4) AS noise FROM loc", _LOCAL)
def _(v):
    loc = spatial.local_statistics(v.observed, _knn(v))
    n = F.coalesce(F.when(F.col("n") >= 2, F.col("var")), F.var_pop("value").over(Window.partitionBy("gene")), F.lit(0.01))
    return loc.select("gene", "spot", F.round(F.greatest(n, F.lit(1e-6)) * 1000, 4).alias("noise"))


_CONF = """
fl AS (SELECT greatest(max(std) * 1e-3, 1e-12) AS floor_ FROM pred WHERE part = 0),
sc AS (SELECT abs(truth - pred) / greatest(std, floor_) AS s FROM pred, fl WHERE part = 0),
q AS (SELECT s AS q FROM (SELECT s, row_number() OVER (ORDER BY s) AS k, count(*) OVER () AS n FROM sc) WHERE k = ceil(least(1.0, ceil((n + 1) * 0.9) / n) * (n - 1)) + 1)"""


def _q(v):
    return stats.conformal(v.pred.where("part = 0"), 0.1)


@add("imp18_conformal", "SELECT round(q, 6) AS q FROM q", _CONF)
def _(v):
    return _q(v).select(r6(F.col("q"), "q"))


@add("imp19_intervals", "SELECT gene, spot, round(pred - q * greatest(std, floor_), 6) AS lo, round(pred + q * greatest(std, floor_), 6) AS hi FROM pred, fl, q WHERE part = 1", _CONF)
def _(v):
    return rounded(stats.intervals(v.pred.where("part = 1"), _q(v)).select("gene", "spot", "lo", "hi"), "lo", "hi")


_IV = _CONF + ", iv AS (SELECT *, pred - q * greatest(std, floor_) AS lo, pred + q * greatest(std, floor_) AS hi FROM pred, fl, q WHERE part = 1)"
_COV = "round(avg(CAST(truth BETWEEN lo AND hi AS DOUBLE)), 6) AS coverage, round(avg(hi - lo), 6) AS width, round(avg(hi - lo + 20 * greatest(lo - truth, 0) + 20 * greatest(truth - hi, 0)), 6) AS interval_score"


@add("imp20_21_coverage", f"SELECT {_COV} FROM iv", _IV)
def _(v):
    return rounded(stats.coverage(stats.intervals(v.pred.where("part = 1"), _q(v)), 0.1, []), "coverage", "width", "interval_score")


@add("imp22_by_domain", f"SELECT domain, {_COV} FROM iv JOIN spot USING (spot) GROUP BY domain", _IV)
def _(v):
    iv = stats.intervals(v.pred.where("part = 1"), _q(v)).join(v.spots.select("spot", "domain"), "spot")
    return rounded(stats.coverage(iv, 0.1, ["domain"]), "coverage", "width", "interval_score")


@add("imp23_calibration", "SELECT round(avg(CAST(abs(truth - pred) <= greatest(std, 1e-6) AS DOUBLE)), 6) AS within_1, round(avg(CAST(abs(truth - pred) <= 1.96 * greatest(std, 1e-6) AS DOUBLE)), 6) AS within_2, round(avg(0.5 * ln(2 * pi() * pow(greatest(std, 1e-6), 2)) + pow(truth - pred, 2) / (2 * pow(greatest(std, 1e-6), 2))), 5) AS nll, round(corr(std, abs(truth - pred)), 5) AS r FROM pred")
def _(v):
    s, d = F.greatest("std", F.lit(1e-6)), F.abs(F.col("truth") - F.col("pred"))
    return v.pred.agg(r6(F.avg((d <= s).cast("double")), "within_1"), r6(F.avg((d <= 1.96 * s).cast("double")), "within_2"), F.round(F.avg(0.5 * F.log(2 * F.pi() * s * s) + d * d / (2 * s * s)), 5).alias("nll"), F.round(F.corr("std", d), 5).alias("r"))


# --- evaluation --------------------------------------------------------------------------------


@add("eva01_errors", "SELECT gene, count(*) AS n, round(sqrt(avg(pow(pred - truth, 2))), 6) AS rmse, round(avg(abs(pred - truth)), 6) AS mae, round(1 - avg(pow(pred - truth, 2)) / var_pop(truth), 5) AS r2 FROM pred GROUP BY gene HAVING var_pop(truth) > 1e-12")
def _(v):
    return stats.errors(["gene"], v.pred).where("r2 IS NOT NULL").select("gene", "n", r6(F.col("rmse"), "rmse"), r6(F.col("mae"), "mae"), F.round("r2", 5).alias("r2"))


@add("eva02_spearman", "SELECT gene, round(corr(a, b), 5) AS spearman FROM (SELECT gene, rank() OVER (PARTITION BY gene ORDER BY std) + (count(*) OVER (PARTITION BY gene, std) - 1) / 2.0 AS a, rank() OVER (PARTITION BY gene ORDER BY truth) + (count(*) OVER (PARTITION BY gene, truth) - 1) / 2.0 AS b FROM pred) GROUP BY gene")
def _(v):
    return stats.spearman(v.pred, ["gene"], "std", "truth").withColumn("spearman", F.round("spearman", 5))


@add("eva03_quality", "SELECT count(*) AS n, round(avg(std), 6) AS mean_std, round(median(std), 6) AS median_std, round(max(std), 6) AS max_std, round(corr(std, abs(pred - truth)), 5) AS r FROM pred")
def _(v):
    return v.pred.agg(F.count("*").alias("n"), r6(F.avg("std"), "mean_std"), r6(F.percentile("std", F.lit(0.5)), "median_std"), r6(F.max("std"), "max_std"), F.round(F.corr("std", F.abs(F.col("pred") - F.col("truth"))), 5).alias("r"))


_FOLD = "fo AS (SELECT gene, spot, value, CAST('0x' || substr(md5(gene || '/' || spot), 1, 6) AS BIGINT) % 4 AS fold FROM obs)"


def _folds(v):
    return v.observed.withColumn("fold", F.conv(F.substring(F.md5(F.concat_ws("/", "gene", "spot")), 1, 6), 16, 10).cast("bigint") % 4)


@add("eva04_cross_validation", "SELECT f AS fold, count(*) AS n, round(sqrt(avg(pow(value - m, 2))), 6) AS rmse FROM (SELECT k.fold AS f, k.value, (s.s - t.s) / (s.n - t.n) AS m FROM fo k JOIN (SELECT gene, sum(value) AS s, count(*) AS n FROM fo GROUP BY gene) s USING (gene) JOIN (SELECT gene, fold, sum(value) AS s, count(*) AS n FROM fo GROUP BY gene, fold) t ON t.gene = k.gene AND t.fold = k.fold WHERE s.n > t.n) GROUP BY f", _FOLD)
def _(v):
    f, g, gf = _folds(v), Window.partitionBy("gene"), Window.partitionBy("gene", "fold")
    t = f.withColumn("n", F.count("*").over(g) - F.count("*").over(gf)).withColumn("s", F.sum("value").over(g) - F.sum("value").over(gf)).where("n > 0")
    return t.groupBy("fold").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.pow(F.col("value") - F.col("s") / F.col("n"), 2))), "rmse"))


_AGREE = """
ct AS (SELECT domain, batch, CAST(count(*) AS DOUBLE) AS n FROM spot GROUP BY ALL), ra AS (SELECT domain, sum(n) AS a FROM ct GROUP BY ALL), rb AS (SELECT batch, sum(n) AS b FROM ct GROUP BY ALL), tt AS (SELECT sum(n) AS t FROM ct)"""


@add("eva07_agreement", "SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 5) AS ari, round(2 * mi / (ha + hb), 5) AS nmi, round(pure / t, 6) AS purity FROM tt, (SELECT sum(n * (n - 1) / 2) AS s FROM ct), (SELECT sum(a * (a - 1) / 2) AS sa, -sum(a / t * ln(a / t)) AS ha FROM ra, tt), (SELECT sum(b * (b - 1) / 2) AS sb, -sum(b / t * ln(b / t)) AS hb FROM rb, tt), (SELECT sum(n / t * ln(n * t / (a * b))) AS mi FROM ct JOIN ra USING (domain) JOIN rb USING (batch), tt), (SELECT sum(m) AS pure FROM (SELECT max(n) AS m FROM ct GROUP BY domain))", _AGREE)
def _(v):
    a = stats.agreement(v.spots, "domain", "batch")
    return a.select(F.round("ari", 5).alias("ari"), F.round("nmi", 5).alias("nmi"), r6(F.col("purity"), "purity"))


@add("eva09_within_layer", "SELECT domain, round(avg(r), 5) AS mean_r, count(*) AS pairs FROM (SELECT sa.domain, corr(a.value, b.value) AS r FROM obs a JOIN obs b ON a.gene = b.gene AND a.spot < b.spot JOIN spot sa ON sa.spot = a.spot JOIN spot sb ON sb.spot = b.spot AND sa.domain = sb.domain WHERE sa.sample = sb.sample GROUP BY sa.domain, a.spot, b.spot HAVING count(*) >= 10) GROUP BY domain")
def _(v):
    c = stats.pair_correlations(v.observed.join(v.spots.select("spot", "domain", "sample"), "spot"), ["domain", "sample"], 10)
    return c.groupBy("domain").agg(F.round(F.try_divide(F.sum("total"), F.sum(F.col("pairs") - F.col("flat"))), 5).alias("mean_r"), F.sum("pairs").alias("pairs"))


@add("eva10_entropy", "SELECT round(max(p), 6) AS collapse, round(-sum(p * log2(p)), 6) AS entropy, max(p) > 0.8 AND count(*) > 3 AS warn FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM spot GROUP BY domain)")
def _(v):
    n = v.spots.groupBy("domain").agg(F.count("*").alias("n"))
    p = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select((F.col("n") / F.col("t")).alias("p"))
    return p.agg(r6(F.max("p"), "collapse"), r6(-F.sum(F.col("p") * F.log2("p")), "entropy"), ((F.max("p") > 0.8) & (F.count("*") > 3)).alias("warn"))


@add("eva13_baseline_delta", "SELECT gene, round(sqrt(avg(pow(pred + 0.01 - truth, 2))) - sqrt(avg(pow(pred - truth, 2))), 6) AS delta FROM pred GROUP BY gene")
def _(v):
    m = stats.errors(["gene"], v.pred.withColumn("pred", F.col("pred") + 0.01)).select("gene", F.col("rmse").alias("a"))
    return m.join(stats.errors(["gene"], v.pred).select("gene", "rmse"), "gene").select("gene", r6(F.col("a") - F.col("rmse"), "delta"))


# --- domains, graphs, batches ------------------------------------------------------------------

_RBF = _KNN + ", sg AS (SELECT median(sqrt(d2)) AS s FROM knn WHERE d2 > 0), rbf AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(exp(-d2 / (2 * s * s))) AS w FROM knn, sg GROUP BY ALL)"


@add("dom01_rbf_graph", "SELECT a, b, round(w, 6) AS w FROM rbf", _RBF)
def _(v):
    return rounded(spatial.rbf_graph(_knn(v)), "w")


@add("dom02_laplacian", "SELECT i, j, round(sum(v), 6) AS v FROM (SELECT a AS i, b AS j, -w AS v FROM rbf UNION ALL SELECT b, a, -w FROM rbf UNION ALL SELECT a, a, w FROM rbf UNION ALL SELECT b, b, w FROM rbf) GROUP BY ALL", _RBF)
def _(v):
    return rounded(spatial.laplacian(spatial.rbf_graph(_knn(v))), "v")


@add("dom08_smooth", "SELECT spot.spot, coalesce(l, domain) AS label FROM spot LEFT JOIN (SELECT src, l FROM (SELECT src, d.domain AS l, count(*) AS k, sum(count(*)) OVER (PARTITION BY src) AS t, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, d.domain) AS r FROM knn JOIN spot d ON d.spot = knn.dst GROUP BY src, d.domain) WHERE r = 1 AND k * 2 > t) m ON m.src = spot.spot", _KNN)
def _(v):
    return spatial.smooth_labels(v.spots.select("spot", F.col("domain").alias("label")), _knn(v))


@add("dom09_small_domains", "SELECT spot, CASE WHEN count(*) OVER (PARTITION BY sample) < 4 THEN -1 ELSE sample END AS label FROM spot")
def _(v):
    return v.spots.select("spot", F.when(F.count("*").over(Window.partitionBy("sample")) < 4, -1).otherwise(F.col("sample")).alias("label"))


_LIFT = "pe AS (SELECT a.p AS a, b.p AS b, 1.0 / (1 + b.p - a.p) AS w FROM (SELECT DISTINCT spot // 4 AS p FROM spot) a JOIN (SELECT DISTINCT spot // 4 AS p FROM spot) b ON b.p BETWEEN a.p + 1 AND a.p + 2), ch AS (SELECT spot, spot // 4 AS parent, count(*) OVER (PARTITION BY spot // 4) AS k FROM spot)"


@add("dom11_lift", "SELECT l.spot AS i, r.spot AS j, round(w / sqrt(l.k * r.k), 6) AS w FROM pe JOIN ch l ON l.parent = a JOIN ch r ON r.parent = b", _LIFT)
def _(v):
    ch = v.spots.select("spot", F.floor(F.col("spot") / 4).alias("parent"))
    p = ch.select(F.col("parent").alias("a")).distinct()
    edges = p.withColumn("b", F.explode(F.array(F.col("a") + 1, F.col("a") + 2))).join(p.select(F.col("a").alias("b")), "b", "left_semi").withColumn("w", 1 / (1 + F.col("b") - F.col("a")))
    return rounded(spatial.lift_graph(edges, ch), "w")


@add("dom12_neighbour_count", "SELECT CAST(greatest(1, least(15 + greatest(0, round((n / np - 4) * 10)), n - 1)) AS BIGINT) AS k FROM (SELECT count(*) AS n, count(DISTINCT spot // 4) AS np FROM spot)")
def _(v):
    a = v.spots.agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("spot") / 4)).alias("np"))
    return a.select(F.greatest(F.lit(1), F.least(15 + F.greatest(F.lit(0), F.round((F.col("n") / F.col("np") - 4) * 10)), F.col("n") - 1)).cast("bigint").alias("k"))


@add("dom13_batch_correction", "SELECT gene, spot, round(CASE WHEN batch = 1 THEN value - coalesce(avg(value) FILTER (batch = 1) OVER (PARTITION BY gene) - avg(value) FILTER (batch = 0) OVER (PARTITION BY gene), 0) ELSE value END, 6) AS corrected FROM obs JOIN spot USING (spot)")
def _(v):
    return impute.two_batch_correction(v.observed.join(v.spots.select("spot", "batch"), "spot")).select("gene", "spot", r6(F.col("corrected"), "corrected"))


@add("dom14_sample_correlation", "SELECT a.sample AS a, b.sample AS b, round(corr(a.m, b.m), 5) AS r FROM (SELECT sample, gene, avg(value) AS m FROM obs JOIN spot USING (spot) GROUP BY ALL) a JOIN (SELECT sample, gene, avg(value) AS m FROM obs JOIN spot USING (spot) GROUP BY ALL) b ON a.gene = b.gene AND a.sample < b.sample GROUP BY ALL HAVING count(*) >= 3")
def _(v):
    m = v.observed.join(v.spots, "spot").groupBy("sample", "gene").agg(F.avg("value").alias("m"))
    j = m.select(F.col("sample").alias("a"), "gene", F.col("m").alias("x")).join(m.select(F.col("sample").alias("b"), "gene", F.col("m").alias("y")), "gene").where("a < b")
    return j.groupBy("a", "b").agg(F.round(F.corr("x", "y"), 5).alias("r"), F.count("*").alias("k")).where("k >= 3").drop("k")


@add("dom06_kmeans")
def _(v):
    from spotloom.operators.cluster import kmeans_domains

    return kmeans_domains(v.usage, v.spots, 3)


@add("dom05_label_propagation")
def _(v):
    from spotloom.operators.cluster import label_propagation

    return label_propagation(spatial.rbf_graph(_knn(v)), v.spots.select("spot"))


@add("spa17_shortest_path")
def _(v):
    from spotloom.operators.graph import shortest_path

    return shortest_path(_knn(v), 1, 2, spots=v.spots)


# --- study operators ---------------------------------------------------------------------------


@add("stu05_pooled_within", "SELECT round(corr(std, abs(pred - truth)), 5) AS pooled, round(median(r), 5) AS median_within FROM pred, (SELECT median(r) AS r FROM (SELECT corr(std, abs(pred - truth)) AS r FROM pred GROUP BY gene HAVING count(*) >= 5))")
def _(v):
    e = F.abs(F.col("pred") - F.col("truth"))
    per = v.pred.groupBy("gene").agg(F.corr("std", e).alias("r"), F.count("*").alias("k")).where("k >= 5").agg(F.round(F.percentile("r", F.lit(0.5)), 5).alias("median_within"))
    return v.pred.agg(F.round(F.corr("std", e), 5).alias("pooled")).crossJoin(per)


@add("stu04_leave_one_out", "SELECT domain, batch AS picked FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY m DESC, batch) AS k FROM (SELECT a.domain, b.batch, round(avg(b.m), 6) AS m FROM (SELECT DISTINCT domain FROM spot) a JOIN (SELECT domain, batch, avg(value) AS m FROM obs JOIN spot USING (spot) GROUP BY ALL) b ON a.domain <> b.domain GROUP BY a.domain, b.batch)) WHERE k = 1")
def _(v):
    m = v.observed.join(v.spots, "spot").groupBy("domain", "batch").agg(F.avg("value").alias("m"))
    a = v.spots.select(F.col("domain").alias("held")).distinct()
    o = a.join(m, F.col("held") != F.col("domain")).groupBy("held", "batch").agg(F.round(F.avg("m"), 6).alias("m"))
    return o.groupBy(F.col("held").alias("domain")).agg(F.max_by("batch", F.struct("m", -F.col("batch"))).alias("picked"))


@add("stu01_stratified", "SELECT spot FROM (SELECT spot, row_number() OVER (PARTITION BY x // 250, y // 250 ORDER BY md5(CAST(spot AS VARCHAR)), spot) AS k FROM spot) WHERE k <= 2")
def _(v):
    w = Window.partitionBy(F.floor(F.col("x") / 250), F.floor(F.col("y") / 250)).orderBy(F.md5(F.col("spot").cast("string")), "spot")
    return v.spots.withColumn("k", F.row_number().over(w)).where("k <= 2").select("spot")


@add("stu03_proportional", "SELECT spot FROM (SELECT spot, row_number() OVER (PARTITION BY domain ORDER BY md5(CAST(spot AS VARCHAR)), spot) AS k, count(*) OVER (PARTITION BY domain) AS n, count(*) OVER () AS t FROM spot) WHERE k <= greatest(1, (20 * n * 2 + t) // (2 * t))")
def _(v):
    w = Window.partitionBy("domain")
    t = v.spots.agg(F.count("*").alias("t"))
    s = v.spots.withColumn("k", F.row_number().over(w.orderBy(F.md5(F.col("spot").cast("string")), "spot"))).withColumn("n", F.count("*").over(w)).crossJoin(F.broadcast(t))
    return s.where("k <= greatest(1, (20 * n * 2 + t) div (2 * t))").select("spot")


@add("stu11_suite", "SELECT domain, batch, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM obs JOIN spot USING (spot) GROUP BY ALL")
def _(v):
    return v.observed.join(v.spots, "spot").groupBy("domain", "batch").agg(r6(F.avg("value"), "mean"), r6(F.stddev_samp("value"), "std"), F.count("*").alias("n"))


@add("stu12_representative", "SELECT site FROM counts GROUP BY site HAVING count(*) >= 10 ORDER BY round(var_pop(count), 4) DESC, site LIMIT 10")
def _(v):
    g = v.counts.groupBy("site").agg(F.count("*").alias("k"), F.round(F.var_pop("count"), 4).alias("s")).where("k >= 10")
    return g.orderBy(F.desc("s"), "site").limit(10).select("site")


@add("stu13_directed_moran", "SELECT gene, round(n / s0 * c / ss, 6) AS i FROM (SELECT a.gene, count(*) AS s0, sum(a.z * b.z) AS c FROM zz a JOIN knn ON a.spot = knn.src JOIN zz b ON b.gene = a.gene AND b.spot = knn.dst GROUP BY a.gene) JOIN own USING (gene) WHERE n >= 11 AND ss > 1e-12", _MORAN)
def _(v):
    e = _knn(v).select("src", "dst", F.lit(1.0).alias("w"))
    return spatial.autocorrelation(v.observed, e).where("n >= 11 AND morans_i IS NOT NULL").select("gene", r6(F.col("morans_i"), "i"))


@add("stu15_proxy", "SELECT site, spot, round(CASE WHEN hi = lo THEN 1 ELSE (count - lo) / (hi - lo) END, 6) AS proxy FROM (SELECT *, min(count) OVER (PARTITION BY site) AS lo, max(count) OVER (PARTITION BY site) AS hi FROM counts) WHERE CAST('0x' || substr(md5(site || '/' || spot), 1, 2) AS BIGINT) >= 77")
def _(v):
    w = Window.partitionBy("site")
    lo, hi = F.min("count").over(w), F.max("count").over(w)
    p = v.counts.select("site", "spot", r6(F.when(hi == lo, F.lit(1.0)).otherwise((F.col("count") - lo) / (hi - lo)), "proxy"))
    return p.where(F.conv(F.substring(F.md5(F.concat_ws("/", "site", "spot")), 1, 2), 16, 10).cast("bigint") >= 77)


# --- sinks and extensions ----------------------------------------------------------------------


@add("snk02_bed_lines", "SELECT chr || chr(9) || s || chr(9) || e || chr(9) || gene || chr(9) || CAST(floor(support * 1000) AS INTEGER) || chr(9) || strand AS value FROM site")
def _(v):
    from spotloom.sources.tables import bed_lines

    return bed_lines(v.sites)


@add("ext_event_windows", "SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS start_, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(v):
    from spotloom.streaming.windows import hourly

    return hourly(v.table("events"))
