"""Further queries: evaluation suites, weighted statistics, numerics by group, and preparation steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spotloom.operators import cluster, factor, geometry, impute, intervals, quantify, spatial, stats
from spotloom.plans.catalogue import _BH, _CONF, _curve, _FOLD, _GROUPS, _KNN, _LOCAL, _MORAN, _METRICS, _adjusted, _folds, _groups, _knn, _q, add, rounded
from spotloom.plans.views import r6


@add("src05_barcodes", "SELECT DISTINCT 'CB' || user_id AS cb FROM events WHERE user_id IS NOT NULL")
def _(v):
    return v.table("events").where("user_id IS NOT NULL").select(F.concat(F.lit("CB"), F.col("user_id").cast("string")).alias("cb")).distinct()


@add("src06_coverage", "SELECT g.pos, count(p.site) AS depth FROM (SELECT unnest(range(100, 400)) AS pos) g LEFT JOIN site p ON p.chr = 'chr1' AND g.pos >= p.s AND g.pos < p.e GROUP BY g.pos")
def _(v):
    reads = v.sites.where("chr = 'chr1' AND e > 100 AND s < 400").select(F.explode(F.sequence(F.greatest("s", F.lit(100)), F.least(F.col("e") - 1, F.lit(399)))).alias("pos"))
    depth = reads.groupBy("pos").agg(F.count("*").alias("depth"))
    return v.spark.range(100, 400).withColumnRenamed("id", "pos").join(depth, "pos", "left").select("pos", F.coalesce("depth", F.lit(0)).alias("depth"))


@add("src16_registry", "SELECT name, n >= 3 AND bool_has AS ready FROM (SELECT 'sample' || sample AS name, count(*) AS n, bool_or(domain = 0) AS bool_has FROM spot GROUP BY sample)")
def _(v):
    return v.spots.groupBy(F.concat(F.lit("sample"), "sample").alias("name")).agg(((F.count("*") >= 3) & F.bool_or(F.col("domain") == 0)).alias("ready"))


@add("src18_merged_utr", "SELECT gene, min(s) AS s, max(e) AS e FROM (SELECT *, sum(b) OVER (PARTITION BY gene ORDER BY s, e, site) AS isl FROM (SELECT *, CASE WHEN max(e) OVER (PARTITION BY gene ORDER BY s, e, site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS b FROM (SELECT x.gene, x.site, x.s, x.e + 200 AS e FROM site x JOIN (SELECT gene, min(s) AS stop FROM site GROUP BY gene) USING (gene) WHERE (x.strand = '+' AND x.s > stop) OR (x.strand = '-' AND x.e < stop + 3000)))) GROUP BY gene, isl")
def _(v):
    stop = v.sites.groupBy("gene").agg(F.min("s").alias("stop"))
    u = v.sites.join(stop, "gene").where("(strand = '+' AND s > stop) OR (strand = '-' AND e < stop + 3000)").select("gene", "site", "s", (F.col("e") + 200).alias("e"))
    return intervals.islands(u, ["gene"], "s", "e", 0, "site").groupBy("gene", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


@add("src20_simulated")
def _(v):
    from spotloom.sources.simulate import simulated_usage

    return simulated_usage(v.spots, n_genes=40, dropout=0.3, seed=7)


@add("src21_true_differences", "SELECT gene, round(abs(avg(value) FILTER (domain = 1) - avg(value) FILTER (domain = 0)), 6) AS gap FROM obs JOIN spot USING (spot) GROUP BY gene HAVING round(abs(avg(value) FILTER (domain = 1) - avg(value) FILTER (domain = 0)), 6) >= 0.02")
def _(v):
    m = lambda d: F.avg(F.when(F.col("domain") == d, F.col("value")))
    return v.observed.join(v.spots, "spot").groupBy("gene").agg(r6(F.abs(m(1) - m(0)), "gap")).where("gap >= 0.02")


@add("flt11_accessor", "SELECT gene FROM adj WHERE padj < 0.05", _BH)
def _(v):
    return _adjusted(v).where("padj < 0.05").select("gene")


@add("agg16_domain_area")
def _(v):
    return cluster.hull_area(v.spots, "domain")


@add("agg24_best_peak", "SELECT gene, count(*) AS n, arg_max(site, total * 100000000 - site) AS best, CAST(max(total) AS BIGINT) AS total FROM site JOIN metrics USING (site) GROUP BY gene", _METRICS)
def _(v):
    m = quantify.site_metrics(v.counts).select("site", "total")
    return v.sites.join(m, "site").groupBy("gene").agg(F.count("*").alias("n"), F.max_by("site", F.struct("total", -F.col("site"))).alias("best"), F.max("total").alias("total"))


_FOLDS = _FOLD + ", fm AS (SELECT fold, gene, round(avg(value), 9) AS m FROM fo GROUP BY ALL)"


@add("agg28_fold_average", "SELECT gene, round(avg(m), 6) AS mean, count(*) AS n_folds FROM fm GROUP BY gene", _FOLDS)
def _(v):
    return _folds(v).groupBy("fold", "gene").agg(F.round(F.avg("value"), 9).alias("m")).groupBy("gene").agg(r6(F.avg("m"), "mean"), F.count("*").alias("n_folds"))


@add("win16_block_mask", "SELECT spot FROM (SELECT spot, row_number() OVER (PARTITION BY domain ORDER BY (x - 500) * (x - 500) + (y - 500) * (y - 500), spot) AS k, count(*) OVER (PARTITION BY domain) AS n FROM spot) WHERE k <= greatest(1, n // 5)")
def _(v):
    w = Window.partitionBy("domain")
    d = (F.col("x") - 500) * (F.col("x") - 500) + (F.col("y") - 500) * (F.col("y") - 500)
    return v.spots.withColumn("k", F.row_number().over(w.orderBy(d, "spot"))).withColumn("n", F.count("*").over(w)).where("k <= greatest(1, n div 5)").select("spot")


_MARK = """
lg AS (SELECT site, spot, ln(1 + 10000.0 * count / sum(count) OVER (PARTITION BY spot)) AS v FROM counts),
zs AS (SELECT site, spot, round(least(greatest((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), -5), 5), 9) AS z FROM lg WINDOW w AS (PARTITION BY site)),
sc AS (SELECT spot, site % 3 AS label, round(avg(z), 7) AS s FROM zs GROUP BY ALL),
tp AS (SELECT spot, label, s, row_number() OVER (PARTITION BY spot ORDER BY s DESC, label) AS k FROM sc)"""


@add("win18_marker_labels", "SELECT a.spot, CASE WHEN a.s >= 0 AND round(a.s - b.s, 6) >= 0.05 THEN CAST(a.label AS VARCHAR) ELSE 'ambiguous' END AS label, round(1 / (1 + exp(-(a.s - b.s))), 5) AS confidence FROM tp a JOIN tp b ON a.spot = b.spot AND a.k = 1 AND b.k = 2", _MARK)
def _(v):
    w = Window.partitionBy("site")
    lg = v.counts.withColumn("v", F.log1p(10000.0 * F.col("count") / F.sum("count").over(Window.partitionBy("spot"))))
    z = F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w))
    zs = lg.select("site", "spot", F.round(F.least(F.greatest(z, F.lit(-5.0)), F.lit(5.0)), 9).alias("z"), z.isNull().alias("flat")).withColumn("z", F.when(~F.col("flat"), F.col("z")))
    sc = zs.groupBy("spot", (F.col("site") % 3).alias("label")).agg(F.round(F.avg("z"), 7).alias("s"))
    tp = sc.withColumn("k", F.row_number().over(Window.partitionBy("spot").orderBy(F.col("s").desc(), "label")))
    t = tp.groupBy("spot").agg(F.max(F.when(F.col("k") == 1, F.col("s"))).alias("s1"), F.max(F.when(F.col("k") == 2, F.col("s"))).alias("s2"), F.max(F.when(F.col("k") == 1, F.col("label"))).alias("l")).where("s2 IS NOT NULL")
    sure = (F.col("s1") >= 0) & (F.round(F.col("s1") - F.col("s2"), 6) >= 0.05)
    return t.select("spot", F.when(sure, F.col("l").cast("string")).otherwise("ambiguous").alias("label"), F.round(1 / (1 + F.exp(-(F.col("s1") - F.col("s2")))), 5).alias("confidence"))


_METHODS = "mt AS (SELECT 'mean' AS method, truth, pred FROM pred UNION ALL SELECT 'shifted', truth, pred + 0.02 FROM pred UNION ALL SELECT 'half', truth, 0.5 FROM pred)"


def _methods(v):
    p = v.pred.select("truth", "pred")
    part = lambda n, c: p.select(F.lit(n).alias("method"), "truth", c.alias("pred"))
    return part("mean", F.col("pred")).union(part("shifted", F.col("pred") + 0.02)).union(part("half", F.lit(0.5)))


@add("top02_leaderboard", "SELECT method, round(sqrt(avg(pow(pred - truth, 2))), 6) AS rmse FROM mt GROUP BY method ORDER BY rmse", _METHODS)
def _(v):
    return stats.errors(["method"], _methods(v)).select("method", r6(F.col("rmse"), "rmse")).orderBy("rmse", "method")


@add("top06_ordering", "SELECT gene, p FROM diff ORDER BY p ASC NULLS LAST, gene")
def _(v):
    return v.diff.select("gene", "p").orderBy(F.asc_nulls_last("p"), "gene")


@add("spa12_weighted_moran", "SELECT gene, round(n / s0 * c / ss, 6) AS i FROM (SELECT gene, count(*) AS n, sum(al * z * z) AS ss FROM wz GROUP BY gene) JOIN (SELECT a.gene, sum(w) AS s0, sum(w * a.al * b.al * a.z * b.z) AS c FROM wz a JOIN sym ON a.spot = sym.src JOIN wz b ON b.gene = a.gene AND b.spot = sym.dst GROUP BY a.gene) USING (gene) WHERE ss > 1e-12", _MORAN + """,
al AS (SELECT gene, spot, truth, 1 / (std + 1e-8) / (sum(1 / (std + 1e-8)) OVER (PARTITION BY gene) / count(*) OVER (PARTITION BY gene)) AS al FROM pred WHERE std > 0),
wz AS (SELECT gene, spot, al, truth - sum(al * truth) OVER (PARTITION BY gene) / sum(al) OVER (PARTITION BY gene) AS z FROM al)""")
def _(v):
    g = Window.partitionBy("gene")
    a = 1 / (F.col("std") + 1e-8)
    al = v.pred.where("std > 0").select("gene", "spot", "truth", (a / (F.sum(a).over(g) / F.count("*").over(g))).alias("al"))
    wz = al.withColumn("z", F.col("truth") - F.sum(F.col("al") * F.col("truth")).over(g) / F.sum("al").over(g))
    left = wz.select("gene", F.col("spot").alias("src"), (F.col("al") * F.col("z")).alias("zi"))
    right = wz.select("gene", F.col("spot").alias("dst"), (F.col("al") * F.col("z")).alias("zj"))
    c = left.join(spatial.symmetric(_knn(v)), "src").join(right, ["gene", "dst"]).groupBy("gene").agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("c"))
    own = wz.groupBy("gene").agg(F.count("*").alias("n"), F.sum(F.col("al") * F.col("z") * F.col("z")).alias("ss")).where("ss > 1e-12")
    return own.join(c, "gene").select("gene", r6(F.col("n") / F.col("s0") * F.col("c") / F.col("ss"), "i"))


@add("spa11_selected")
def _(v):
    t = impute.permutation_p(v.usage, spatial.symmetric(_knn(v)), 100).withColumn("c", F.lit(1))
    return stats.adjust(t, ["c"]).where("padj < 0.05 AND morans_i > 0").drop("c")


@add("spa15_patterns")
def _(v):
    m = v.usage.select(F.col("spot").alias("gene"), F.col("gene").alias("spot"), "value")
    return cluster.kmeans_domains(m, m.select("spot").distinct(), 4).select(F.col("spot").alias("gene"), F.col("domain").alias("pattern"))


@add("sta02_p_values")
def _(v):
    return stats.welch(_groups(v), ["gene"]).withColumn("p", stats.student_p("t", "df"))


@add("sta03_permutation")
def _(v):
    return stats.permutation_difference(_groups(v), "gene", 1000)


@add("sta08_sample_t", "SELECT gene, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS t FROM (SELECT gene, count(*) FILTER (batch = 0) AS n1, count(*) FILTER (batch = 1) AS n2, avg(m) FILTER (batch = 0) AS m1, avg(m) FILTER (batch = 1) AS m2, var_samp(m) FILTER (batch = 0) AS v1, var_samp(m) FILTER (batch = 1) AS v2 FROM (SELECT gene, sample, batch, avg(value) AS m FROM obs JOIN spot USING (spot) GROUP BY ALL) GROUP BY gene) WHERE n1 > 1 AND n2 > 1")
def _(v):
    m = v.observed.join(v.spots, "spot").groupBy("gene", "sample", "batch").agg(F.avg("value").alias("value")).withColumn("g", F.col("batch") + 1)
    return stats.welch(m, ["gene"]).select("gene", F.round("t", 4).alias("t"))


@add("sta09_fixed_effects")
def _(v):
    j = v.observed.join(v.spots, "spot").join(v.counts.groupBy("spot").agg(F.log1p(F.sum("count")).alias("depth")), "spot")
    return stats.fixed_effects(j, "gene", "depth", "value", "domain").withColumn("p", stats.student_p("t", "dof"))


@add("sta10_paired", "SELECT count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM (SELECT gene, sqrt(avg(pow(pred - truth, 2))) - sqrt(avg(pow(pred + 0.02 - truth, 2))) AS d FROM pred GROUP BY gene)")
def _(v):
    p = v.pred.groupBy("gene").agg((F.sqrt(F.avg(F.pow(F.col("pred") - F.col("truth"), 2))) - F.sqrt(F.avg(F.pow(F.col("pred") + 0.02 - F.col("truth"), 2)))).alias("d"))
    return p.agg(F.count("*").alias("n"), F.round(F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*"))), 4).alias("t"))


@add("imp01_02_exact_gp")
def _(v):
    return impute.exact_gp(v.usage, v.spots, [80.0, 250.0], [0.1, 1.0])


@add("imp10_block_gp")
def _(v):
    return impute.block_gp(v.usage, v.spots, 500.0, [80.0, 250.0], [0.1, 1.0])


@add("imp16_pass", "SELECT u.gene, u.spot, round(coalesce(u.value, m.m, avg(coalesce(u.value, m.m)) OVER (PARTITION BY u.gene)), 6) AS imputed FROM usage u LEFT JOIN (SELECT o.gene, knn.src AS spot, avg(o.value) AS m FROM knn JOIN obs o ON o.spot = knn.dst GROUP BY ALL) m ON u.gene = m.gene AND u.spot = m.spot", _KNN)
def _(v):
    return impute.neighbour_passes(v.usage, _knn(v), 1).select("gene", "spot", r6(F.col("imputed"), "imputed"))


@add("imp09_residual_noise", "SELECT o.gene, o.spot, round(greatest(CASE WHEN count(n.value) >= 2 THEN var_pop(n.value - n.m) END, 1e-6), 6) AS noise FROM obs o JOIN knn ON knn.src = o.spot JOIN (SELECT gene, spot, value, m FROM loc WHERE m IS NOT NULL) n ON n.gene = o.gene AND n.spot = knn.dst GROUP BY o.gene, o.spot HAVING count(*) >= 2", _LOCAL)
def _(v):
    e = _knn(v)
    res = spatial.local_statistics(v.observed, e).where("mean IS NOT NULL").select("gene", "spot", (F.col("value") - F.col("mean")).alias("value"))
    near = res.select("gene", F.col("spot").alias("dst"), F.col("value").alias("r"))
    n = e.join(near, "dst").groupBy("gene", F.col("src").alias("spot")).agg(F.var_pop("r").alias("var"), F.count("*").alias("k")).where("k >= 2")
    return v.observed.select("gene", "spot").join(n, ["gene", "spot"]).select("gene", "spot", r6(F.greatest("var", F.lit(1e-6)), "noise"))


@add("eva05_masked_compare", "SELECT 'mean' AS method, round(sqrt(avg(pow(value - m, 2))), 6) AS rmse FROM (SELECT k.value, t.m FROM fo k JOIN (SELECT gene, avg(value) AS m FROM fo WHERE fold <> 0 GROUP BY gene) t USING (gene) WHERE fold = 0) UNION ALL SELECT 'median', round(sqrt(avg(pow(value - m, 2))), 6) FROM (SELECT k.value, t.m FROM fo k JOIN (SELECT gene, median(value) AS m FROM fo WHERE fold <> 0 GROUP BY gene) t USING (gene) WHERE fold = 0)", _FOLD)
def _(v):
    f = _folds(v)
    t = f.where("fold <> 0").groupBy("gene").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"))
    j = f.where("fold = 0").join(t, "gene").unpivot(["gene", "spot", "value"], ["mean", "median"], "method", "m")
    return j.groupBy("method").agg(r6(F.sqrt(F.avg(F.pow(F.col("value") - F.col("m"), 2))), "rmse"))


@add("eva06_benchmark", "SELECT method, count(*) AS n, round(sqrt(avg(pow(pred - truth, 2))), 6) AS rmse, round(avg(abs(pred - truth)), 6) AS mae FROM mt GROUP BY method", _METHODS)
def _(v):
    return rounded(stats.errors(["method"], _methods(v)).select("method", "n", "rmse", "mae"), "rmse", "mae")


@add("eva08_compactness", "SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz FROM (SELECT count(*) AS n, count(DISTINCT domain) AS k, sum(pow(x - mx, 2) + pow(y - my, 2)) AS w, sum(pow(mx - gx, 2) + pow(my - gy, 2)) AS b FROM (SELECT domain, x, y, avg(x) OVER (PARTITION BY domain) AS mx, avg(y) OVER (PARTITION BY domain) AS my, avg(x) OVER () AS gx, avg(y) OVER () AS gy FROM spot))")
def _(v):
    w = Window.partitionBy("domain")
    g = v.spots.agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"))
    s = v.spots.withColumn("mx", F.avg("x").over(w)).withColumn("my", F.avg("y").over(w)).crossJoin(F.broadcast(g))
    sq = lambda a, b: F.pow(F.col(a) - F.col(b), 2)
    a = s.agg(F.count("*").alias("n"), F.count_distinct("domain").alias("k"), F.sum(sq("x", "mx") + sq("y", "my")).alias("w"), F.sum(sq("mx", "gx") + sq("my", "gy")).alias("b"))
    return a.select(F.round((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))), 4).alias("calinski_harabasz"))


@add("eva11_report", "SELECT (SELECT count(*) FROM site) AS n_sites, (SELECT count(*) FROM spot) AS n_spots, count(*) AS cells, count(value) AS observed, round(avg(value), 6) AS mean FROM usage")
def _(v):
    r = v.usage.agg(F.count("*").alias("cells"), F.count("value").alias("observed"), r6(F.avg("value"), "mean"))
    return v.sites.agg(F.count("*").alias("n_sites")).crossJoin(v.spots.agg(F.count("*").alias("n_spots"))).crossJoin(r)


@add("eva12_parent_rmse", "SELECT round(sqrt(avg(pow(p - t, 2))), 6) AS rmse FROM (SELECT gene, spot // 4 AS parent, avg(pred) AS p, avg(truth) AS t FROM pred GROUP BY ALL)")
def _(v):
    p = v.pred.groupBy("gene", F.floor(F.col("spot") / 4).alias("parent")).agg(F.avg("pred").alias("p"), F.avg("truth").alias("t"))
    return p.agg(r6(F.sqrt(F.avg(F.pow(F.col("p") - F.col("t"), 2))), "rmse"))


@add("dom03_factorize")
def _(v):
    return factor.factorize(v.usage, spatial.rbf_graph(_knn(v)))


@add("dom07_weighted_kmeans")
def _(v):
    w = v.pred.groupBy("spot").agg(F.least(F.greatest(1 / F.avg("std"), F.lit(0.1)), F.lit(10.0)).alias("weight"))
    return cluster.kmeans_domains(v.usage, v.spots, 3, weights=w)


@add("dom04_power_iteration")
def _(v):
    return cluster.power_iteration(spatial.rbf_graph(_knn(v)), 3)


@add("dom17_trends")
def _(v):
    t = impute.likelihood_ratio(v.usage, v.spots, [50.0, 150.0, 400.0]).withColumn("c", F.lit(1))
    return stats.adjust(t, ["c"]).drop("c").withColumn("significant", F.col("padj") < 0.05).orderBy("p", "gene")


@add("stu06_leakage", "SELECT round(avg(abs(a - b)), 6) AS gap FROM (SELECT gene, var_pop(value) AS a, var_pop(value) FILTER (fold <> 0) AS b FROM fo GROUP BY gene)", _FOLD)
def _(v):
    g = _folds(v).groupBy("gene").agg(F.var_pop("value").alias("a"), F.var_pop(F.when(F.col("fold") != 0, F.col("value"))).alias("b"))
    return g.agg(r6(F.avg(F.abs(F.col("a") - F.col("b"))), "gap"))


@add("stu07_width_by_mode", "SELECT 'scaled' AS mode, round(avg(2 * q * greatest(std, floor_)), 6) AS width FROM pred, fl, q WHERE part = 1", _CONF)
def _(v):
    iv = stats.intervals(v.pred.where("part = 1"), _q(v))
    return iv.agg(r6(F.avg(F.col("hi") - F.col("lo")), "width")).select(F.lit("scaled").alias("mode"), "width")


@add("stu08_kept_spots", "SELECT sample, spot FROM (SELECT sample, spot, row_number() OVER (PARTITION BY sample ORDER BY m, spot) AS k, count(*) OVER (PARTITION BY sample) AS n FROM (SELECT sample, spot, round(avg(std), 9) AS m FROM pred JOIN spot USING (spot) GROUP BY ALL)) WHERE k <= ceil(n * 0.8)")
def _(v):
    m = v.pred.join(v.spots, "spot").groupBy("sample", "spot").agg(F.round(F.avg("std"), 9).alias("m"))
    w = Window.partitionBy("sample")
    return m.withColumn("k", F.row_number().over(w.orderBy("m", "spot"))).withColumn("n", F.count("*").over(w)).where(F.col("k") <= F.ceil(F.col("n") * 0.8)).select("sample", "spot")


@add("stu10_counts", "SELECT count(*) FILTER (padj < 0.05) AS n_significant, count(DISTINCT gene) FILTER (padj < 0.05 AND log2fc > 0) AS n_up FROM adj", _BH)
def _(v):
    a = _adjusted(v)
    return a.agg(F.count_if(F.col("padj") < 0.05).alias("n_significant"), F.count_distinct(F.when((F.col("padj") < 0.05) & (F.col("log2fc") > 0), F.col("gene"))).alias("n_up"))


@add("api04_preset", "SELECT CASE WHEN ns >= 1000 OR o < 0.35 OR (ns >= 300 AND p < 0.15 AND mp <= greatest(5, 0.1 * ng)) THEN 'highres_accuracy' ELSE 'standard' END AS preset, CAST(least(500, greatest(100, ns // 100)) AS BIGINT) AS n_inducing FROM (SELECT sum(o) / max(ns * ng) AS o, sum(p) / max(ns * ng) AS p, median(p) AS mp, max(ns) AS ns, max(ng) AS ng FROM (SELECT spot, count(value) AS o, count(*) FILTER (value > 0) AS p FROM usage GROUP BY spot), (SELECT count(*) AS ns FROM spot), (SELECT count(DISTINCT gene) AS ng FROM site))")
def _(v):
    n, g = v.spots.count(), v.sites.select("gene").distinct().count()
    p = quantify.profile(v.usage, n, g)
    return p.select(F.when(F.col("highres"), "highres_accuracy").otherwise("standard").alias("preset"), F.lit(min(500, max(100, n // 100))).cast("bigint").alias("n_inducing"))


@add("api03_workflow")
def _(v):
    from spotloom.plans.workflow import Workflow

    return Workflow(v.counts, v.sites, v.spots, min_parent=200).run()["trends"]


@add("jn11_delaunay")
def _(v):
    return geometry.delaunay_edges(v.spots, "domain")


@add("spa18_smooth_curves")
def _(v):
    return geometry.smooth_curves(_curve(v).withColumn("domain", F.col("domain").cast("int")), 0.6)


@add("sta11_binomial_band")
def _(v):
    return geometry.binomial_band(v.observed.groupBy("gene").agg(F.count("*").alias("n")), "n", 0.9)
