import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.operators import cluster, geometry, graph, impute, intervals, quantify, spatial, stats
from spotloom.sources import tables


def test_gene_index_by_hand(spark):
    sites = spark.createDataFrame([(1, 7, "+", 10), (2, 7, "+", 20), (3, 7, "+", 30), (4, 8, "-", 5), (5, 8, "-", 9), (6, 9, "+", 1)], "site long, gene long, strand string, coord long")
    counts = spark.createDataFrame([(1, 1, 4), (2, 1, 3), (3, 1, 3), (4, 1, 6), (5, 1, 2), (6, 1, 9), (1, 2, 2)], "site long, spot long, count long")
    got = {(r.gene, r.spot): r.value for r in quantify.gene_index(counts, sites, 5).collect()}
    assert got == {(7, 1): 0.6, (8, 1): 0.75, (7, 2): None}


def test_site_metrics_without_counts(spark):
    r = quantify.site_metrics(spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 4)], "site long, spot long, count long")).orderBy("site").collect()
    assert (r[0].total, r[0].n_spots, r[0]["mean"], r[0].cv) == (0, 0, 0.0, None) and r[1].cv == 0.0


def test_cv_at_its_limit_passes_in_any_order(spark):
    r, ties = random.Random(4), []
    while len(ties) < 8:  # n q - s^2 = s^2 / 4: the CV is 0.5
        xs = [r.randint(1, 50) for _ in range(10)]
        if 4 * (10 * sum(x * x for x in xs) - sum(xs) ** 2) == sum(xs) ** 2:
            ties += [r.sample(xs, 10) for _ in range(4)]
    rows = [(i, j, x) for i, xs in enumerate(ties) for j, x in enumerate(xs)] + [(99, 0, 1), (99, 1, 2 * 10**9)]
    counts = spark.createDataFrame(rows, "site long, spot long, count long")
    got = {x.site: x for x in quantify.site_report(counts, max_cv=0.5).collect()}
    assert all(got[i].cv == 0.5 and got[i].pass_cv for i in range(len(ties)))
    assert got[99].cv == pytest.approx((2e9 - 1) / (2e9 + 1))


@pytest.mark.parametrize("k", [1, 3, 50])
def test_knn_equals_all_pairs(spark, k):
    r = random.Random(k)
    pts = [(i, r.randint(0, 40), r.choice([r.randint(0, 40), 2000])) for i in range(80)]
    got = spatial.knn_edges(spark.createDataFrame(pts, "spot long, x long, y long"), k).collect()
    want = {(a, b) for a, x, y in pts for _, b in sorted(((x - u) ** 2 + (y - v) ** 2, b) for b, u, v in pts if b != a)[:k]}
    assert {(e.src, e.dst) for e in got} == want


def test_knn_of_one_and_of_equal_spots(spark):
    one = spark.createDataFrame([(1, 5, 5)], "spot long, x long, y long")
    assert spatial.knn_edges(one, 3).count() == 0
    same = spark.createDataFrame([(i, 5, 5) for i in range(4)], "spot long, x long, y long")
    assert spatial.knn_edges(same, 2).count() == 8


def test_moran_of_gradient_and_checkerboard(spark):
    grid = [(10 * i + j, i, j) for i in range(10) for j in range(10)]
    spots = spark.createDataFrame(grid, "spot long, x long, y long")
    values = spark.createDataFrame([(g, s, float(x if g == 0 else (x + y) % 2)) for s, x, y in grid for g in (0, 1)], "gene long, spot long, value double")
    w = spatial.symmetric(spatial.radius_edges(spots, 1))
    got = {r.gene: r for r in spatial.autocorrelation(values, w).collect()}
    assert got[0].morans_i > 0.5 and got[1].morans_i == pytest.approx(-1.0)
    assert got[0].gearys_c < 0.5 < 1.5 < got[1].gearys_c
    p = {r.gene: r.p for r in impute.permutation_p(values, w, 99).collect()}
    assert p[0] <= 0.05 < p[1]


def test_overlap_counts_each_pair_once(spark):
    r = random.Random(2)
    a = [("c", i, (s := r.randint(0, 3000)), s + r.randint(1, 1500)) for i in range(60)]
    df = spark.createDataFrame(a, "chr string, site long, s long, e long")
    other = df.select("chr", F.col("site").alias("o"), F.col("s").alias("bs"), F.col("e").alias("be"))
    got = [(x.site, x.o) for x in intervals.overlaps(df, other, ["chr"], 128).collect()]
    assert sorted(got) == sorted((i, j) for _, i, s, e in a for _, j, t, f in a if s < f and t < e)


def test_nearest_and_annotate_scan_no_frame_anew(spark):
    r = random.Random(5)
    at = [(r.choice("ab"), "+", r.randint(0, 400), i) for i in range(120)]
    ends = [(r.choice("abc"), "+", r.randint(0, 400), i) for i in range(30)]
    a = spark.createDataFrame(at, "chr string, strand string, pos long, id long")
    b = spark.createDataFrame(ends, "chr string, strand string, pos long, id long")
    found = intervals.nearest(a, b, ["chr", "strand"])
    want = {i: min((abs(p - q) for d, _, q, _ in ends if d == c), default=None) for c, _, p, i in at}
    assert {x.id: x.distance for x in found.collect()} == want
    genes = b.select("chr", "strand", F.col("id").alias("gid"), F.col("pos").alias("gs"), (F.col("pos") + 3).alias("ge"))
    told = intervals.annotate(a.withColumnRenamed("id", "site"), genes)
    gaps = {i: min((max(q - p, p - q - 3, 0) for d, _, q, _ in ends if d == c), default=None) for c, _, p, i in at}
    assert {x.site: x.gap for x in told.collect()} == gaps
    # Spark reads a frame up to the end of its partition again for every row
    for df in (found, told):
        assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_islands_of_nested_intervals(spark):
    df = spark.createDataFrame([("c", "+", 1, 0, 100, 0.5, 3, 7), ("c", "+", 2, 10, 20, None, None, 8), ("c", "+", 3, 105, 110, 0.9, 1, 9), ("c", "+", 4, 121, 130, 0.1, 1, 9)], "chr string, strand string, site long, s long, e long, support double, reads long, gene long")
    rows = [(r.s, r.e, r.support, r.reads, r.gene) for r in intervals.merge(df, 10).orderBy("s").collect()]
    assert rows == [(0, 110, 0.9, 4, 7), (121, 130, 0.1, 1, 9)]


def test_rank_sum_and_adjustment(spark):
    rows = [(1, 1, v) for v in (1.0, 2.0, 3.0, 9.0)] + [(1, 2, v) for v in (4.0, 5.0, 3.0, 8.0, 7.0)] + [(2, 1, 1.0)]
    r = stats.rank_sum(spark.createDataFrame(rows, "gene long, g int, value double"), ["gene"]).collect()
    assert len(r) == 1 and r[0].u == 5.5
    p = spark.createDataFrame([(1, 0.01, 1), (2, 0.04, 1), (3, 0.03, 1), (4, None, 1)], "gene long, p double, c int")
    assert {x.gene: x.padj and round(x.padj, 6) for x in stats.adjust(p, ["c"]).collect()} == {1: 0.03, 2: 0.04, 3: 0.04, 4: None}
    z = stats.normal_p("z")
    assert spark.createDataFrame([(1.959964,)], "z double").select(z.alias("p")).first().p == pytest.approx(0.05, abs=1e-6)


def test_conformal_coverage(spark):
    r = np.random.default_rng(3)
    std = r.uniform(0.5, 2, 8000)
    rows = [(i % 2, float(e), 0.0, float(s)) for i, (e, s) in enumerate(zip(r.normal(0, std), std))]
    df = spark.createDataFrame(rows, "part int, truth double, pred double, std double")
    for alpha in (0.05, 0.1, 0.2):
        q = stats.conformal(df.where("part = 0"), alpha)
        got = stats.coverage(stats.intervals(df.where("part = 1"), q), alpha, []).first().coverage
        assert abs(got - (1 - alpha)) < 0.03


def test_sparse_gp_keeps_observed_and_follows_a_smooth_field(spark):
    grid = [(10 * i + j, float(i), float(j)) for i in range(10) for j in range(10)]
    spots = spark.createDataFrame(grid, "spot long, x double, y double")
    truth = {s: 0.5 + 0.4 * math.sin(x / 3) for s, x, _ in grid}
    usage = spark.createDataFrame([(1, s, None if s % 4 == 0 else truth[s]) for s, _, _ in grid], "gene long, spot long, value double")
    z = np.array([(x, y) for x in (0, 3, 6, 9) for y in (0, 3, 6, 9)], float)
    out = {r.spot: r for r in impute.sparse_gp(usage, spots, z, 3.0, 0.05).collect()}
    assert all(out[s].imputed == truth[s] and out[s]["std"] == 0 for s in truth if s % 4)
    assert max(abs(out[s].imputed - truth[s]) for s in truth if s % 4 == 0) < 0.15


def test_quantile_normalise_removes_a_shift(spark):
    r = random.Random(5)
    rows = [(1, i, i % 2, r.random() + (i % 2) * 0.5) for i in range(200)]
    q = impute.quantile_normalize(spark.createDataFrame(rows, "gene long, spot long, batch int, value double"))
    m = {x.batch: x.m for x in q.groupBy("batch").agg(F.avg("normalized").alias("m")).collect()}
    assert abs(m[0] - m[1]) < 0.01


def test_shortest_path(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 25), (3, 4, 1)], "src long, dst long, d2 long")
    assert [r.spot for r in graph.shortest_path(e, 1, 4).orderBy("seq").collect()] == [1, 2, 3, 4]
    assert graph.shortest_path(e, 4, 1).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("barcode,x,y\na,1,2\nb,3,4.5\n")
    assert [tuple(r) for r in tables.coordinates(spark, str(tmp_path / "c.csv")).orderBy("spot").collect()] == [("a", 1, 2), ("b", 3, 4.5)]
    (tmp_path / "bad.csv").write_text("barcode,x\na,1\n")
    with pytest.raises(ValueError):
        tables.coordinates(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError):
        tables.coordinates(spark, "x.json")
    (tmp_path / "p.csv").write_text("AA-1,1,0,0,5,6\nBB-1,0,0,1,7,8\n")
    assert [r.core for r in tables.tissue_positions(spark, str(tmp_path / "p.csv")).collect()] == ["AA"]
    (tmp_path / "s.bed").write_text("# c\nchr1\t5\t9\tg\t500\t-\nchr2\t1\t2\th\t0\n")
    assert {(r.chr, r.strand, r.support) for r in tables.bed(spark, str(tmp_path / "s.bed")).collect()} == {("chr1", "-", 0.5), ("chr2", "+", 0.0)}
    (tmp_path / "g.gtf").write_text('chr1\tx\tgene\t10\t19\t.\t+\t.\tgene_id "E1.4"; gene_name "A";\nchr1\tx\texon\t1\t2\t.\t+\t.\tgene_id "E1.4";\nchr1\tx\tgene\t1\t2\t.\t-\t.\tgene_id "E2";\n')
    assert {(r.gene_id, r.gene_name, r.width) for r in tables.gtf_genes(spark, str(tmp_path / "g.gtf")).collect()} == {("E1", "A", 10), ("E2", "E2", 2)}
    (tmp_path / "m.csv").write_text("gene,s1,s2\ng1,0.5,\ng2,NaN,1\n")
    long = tables.matrix(spark, str(tmp_path / "m.csv"))
    assert {(r.gene, r.spot): r.value for r in long.collect()} == {("g1", "s1"): 0.5, ("g1", "s2"): None, ("g2", "s1"): None, ("g2", "s2"): 1.0}
    with pytest.raises(ValueError, match="s2"):
        tables.assemble(long, spark.createDataFrame([("s1", 0.0, 0.0)], "spot string, x double, y double"))
    (tmp_path / "t.csv").write_text("peak_id,spot_id,count\np,C3_14,2\n")
    assert tables.triples(spark, str(tmp_path / "t.csv")).select("x", "y").first() == (3, 14)
    peaks = spark.createDataFrame([("a:b:chr1:5-9:-1",), ("a:b:chr1:15-19:1",), ("z:chr1:1-2:1",), ("junk",)], "name string")
    assert {(r.gene, r.coord) for r in tables.named_peaks(peaks).collect()} == {("a:b", 5), ("a:b", 19)}
    (tmp_path / "h.txt").write_text(">>x\n>m1\tg1\t150\t-20\nother\n")
    assert tables.motif_hits(spark, str(tmp_path / "h.txt")).select("regulator", "score").first() == ("m1", 150.0)
    out = str(tmp_path / "out")
    tables.write_results({"usage": long}, out)
    assert spark.read.parquet(f"{out}/usage").count() == 4


def test_stream_equals_table(spark, sf_dir, tmp_path):
    from spotloom.streaming.windows import hourly, stream

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    q = stream(spark, str(tmp_path / "in"), events.schema).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, hourly(events).collect()))


def test_delaunay_circles_are_empty():
    pts = np.random.default_rng(4).uniform(0, 100, (60, 2))
    tri = geometry.triangles(pts)
    assert 2 * 60 - 2 - 40 <= len(tri) <= 2 * 60 - 5
    for a, b, c in tri:
        m = np.array([pts[b] - pts[a], pts[c] - pts[a]]) * 2
        o = np.linalg.solve(m, [(pts[b] ** 2).sum() - (pts[a] ** 2).sum(), (pts[c] ** 2).sum() - (pts[a] ** 2).sum()])
        r = ((pts[a] - o) ** 2).sum()
        assert (((pts - o) ** 2).sum(1) > r * (1 - 1e-9)).all()


def test_lowess_keeps_a_line():
    x = np.arange(10.0)
    assert np.allclose(geometry.lowess(x, 2 * x + 1), 2 * x + 1)


def test_student_p(spark):
    p = stats.student_p("t", "df")
    got = spark.createDataFrame([(2.228139, 10.0), (0.0, 5.0), (12.7062, 1.0)], "t double, df double").select(p.alias("p")).collect()
    assert [round(r.p, 4) for r in got] == [0.05, 1.0, 0.05]


def test_binomial_band(spark):
    r = geometry.binomial_band(spark.createDataFrame([(100,)], "n long"), "n", 0.9).first()
    assert (r.lo, r.hi) == (0.84, 0.95)


def test_delaunay_forgets_triangles_that_are_done():
    """4,000 points took 17.8 CPU seconds when each looked at all triangles."""
    import time

    pts = np.random.default_rng(6).uniform(0, 100, (4000, 2))
    began = time.process_time()
    tri = geometry.triangles(pts)
    assert time.process_time() - began < 10
    assert 2 * 4000 - 2 - 120 <= len(tri) <= 2 * 4000 - 5
    assert len({v for t in tri for v in t}) == 4000


def test_many_pairs_of_few_rows_are_dealt_over_tasks(spark, monkeypatch):
    r = np.random.default_rng(2)
    at = [(i, int(x), int(y)) for i, (x, y) in enumerate(r.integers(0, 40, (300, 2)))]
    spots = spark.createDataFrame(at, "spot long, x long, y long").coalesce(1)
    monkeypatch.setattr(spatial, "PAIRS", 1000, raising=False)
    e = spatial.radius_edges(spots, 30).withColumn("task", F.spark_partition_id()).collect()
    want = {(i, j, (x - a) ** 2 + (y - b) ** 2) for i, x, y in at for j, a, b in at if i != j and (x - a) ** 2 + (y - b) ** 2 <= 900}
    assert {(x.src, x.dst, x.d2) for x in e} == want and len(e) == len(want)
    assert max(sum(x.task == t for x in e) for t in {x.task for x in e}) < len(e) / 4
    kids = spark.createDataFrame([(i, i % 2) for i in range(300)], "spot long, parent long").coalesce(1)
    lifted = spatial.lift_graph(spark.createDataFrame([(0, 1, 3.0)], "a long, b long, w double"), kids).withColumn("task", F.spark_partition_id()).collect()
    assert {(x.i, x.j, round(x.w, 9)) for x in lifted} == {(i, j, round(3 / 150, 9)) for i in range(0, 300, 2) for j in range(1, 300, 2)} and len(lifted) == 150 * 150
    assert max(sum(x.task == t for x in lifted) for t in {x.task for x in lifted}) < len(lifted) / 4


def test_nearest_in_a_plane_looks_around_only():
    r = np.random.default_rng(3)
    for side in (3, 40):
        at = r.integers(0, side, (400, 2)).astype(float)
        at[-1] += 10_000
        d = ((at[:, None] - at[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        assert (impute.nearest(at, 8, 500) == np.argsort(d, axis=1, kind="stable")[:, :8]).all()


def test_pair_correlations_equal_numpy_without_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(stats, "PAIR_BLOCK", 8)
    monkeypatch.setattr(stats, "GENES", 5)
    r = np.random.default_rng(7)
    v = {(s, g): float(r.normal()) for s in range(30) for g in range(14) if r.random() < 0.8}
    v |= {(4, g): 0.5 for g in range(14)}
    rows = [(s % 2, g, s, x) for (s, g), x in v.items()] + [(0, 1, 99, None)]
    got = {x.k: x for x in stats.pair_correlations(spark.createDataFrame(rows, "k long, gene long, spot long, value double"), ["k"], 8).groupBy("k").agg(*[F.sum(c).alias(c) for c in ("pairs", "flat", "total")]).collect()}
    for k in (0, 1):
        n = flat = total = 0
        for a in range(k, 30, 2):
            for b in range(a + 2, 30, 2):
                both = [g for g in range(14) if (a, g) in v and (b, g) in v]
                if len(both) >= 8:
                    n += 1
                    if 4 in (a, b):
                        flat += 1
                    else:
                        total += np.corrcoef([v[a, g] for g in both], [v[b, g] for g in both])[0, 1]
        assert (got[k].pairs, got[k].flat) == (n, flat) and got[k].total == pytest.approx(total)


def test_permutation_keeps_no_object_an_edge(spark):
    """edges came as a Python object each, some 400 bytes."""
    from pyspark.sql import functions as F

    n = 20_000
    values = spark.range(n).select(F.lit(1).cast("bigint").alias("gene"), F.col("id").alias("spot"), F.rand(1).alias("value"))
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k")).select("src", ((F.col("src") + F.col("k")) % n).alias("dst"), F.lit(1.0).alias("w"))
    edges = edges.union(edges.select(F.col("src"), (F.col("dst") + 10 * n).alias("dst"), "w"))  # to spots without a value
    made = impute.permutation_p(values, edges, 3)
    r = made.first()
    assert r.n == n and abs(r.morans_i) < 0.01 and 0.25 <= r.p <= 1
    assert "FlatMapGroupsInArrow" in made._jdf.queryExecution().toString()
