import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotloom.operators import batch, expression, impute, likelihood, masks, patterns, recover, spatial, stats, trajectory
from spotloom.sources import reads


def _spots(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, r.randrange(50), r.randrange(50), i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "spot long, x long, y long, domain long")


def _usage(spark, rows, genes, seed=2, share=0.7):
    r = random.Random(seed)
    cells = [(g, s[0], min(1.0, max(0.0, 0.5 + 0.3 * math.sin(s[1] / 9 + g) + r.gauss(0, 0.05))) if r.random() < share else None) for g in range(genes) for s in rows]
    return cells, spark.createDataFrame(cells, "gene long, spot long, value double")


# ---- reads


def plain_introns(start, cigar):
    at, out = start, []
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
        if op == "N":
            out.append((at, at + int(n)))
        if op in "MDN=X":
            at += int(n)
    return out


def test_junctions_equal_a_walk_over_reads(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        ops = "".join(f"{r.choice([1, 5, 30])}{r.choice('MIDNS=XHP')}" for _ in range(r.randint(0, 7)))
        rows.append((r.choice(["chr1", "chr2", "chrM", "chrEBV", "chr1_alt", "chr3.1", "scaffold", None]), r.randrange(6) * 10, r.choice([ops, "*", None]), r.choice([0, 16, 4, 256, 2048, None]), "x"))
    df = spark.createDataFrame(rows, "chr string, start long, cigar string, flag int, e string")
    want = {}
    for c, start, cigar, flag, _ in rows:
        if c in ("chr1", "chr2") and not (flag or 0) & 0x904:
            for s, e in plain_introns(start, cigar):
                want[c, s, e] = want.get((c, s, e), 0) + 1
    assert {(x.chr, x.s, x.e): x["count"] for x in reads.junctions(df).collect()} == want
    assert {(x.chr, x.s, x.e) for x in reads.junctions(df, 3).collect()} == {k for k, n in want.items() if n >= 3}
    assert reads.junctions(df.limit(0)).count() == 0
    line = reads.junction_lines(spark.createDataFrame([("chr1", 100, 300, 7)], "chr string, s long, e long, count long")).first().line
    assert line == "chr1\t90\t310\tjunc\t7\t.\t90\t310\t0\t2\t10,10\t0,210"


def test_coverage_counts_aligned_bases_only(spark):
    rows = [("chr1", 995, "10M5N10M", 0, "a"), ("chr1", 1000, "3S4=1D2X", 16, "b"), ("chr1", 1000, "50M", 256, "a"), ("chr2", 1000, "5M", 0, "a")]
    df = spark.createDataFrame(rows, "chr string, start long, cigar string, flag int, cb string")
    region = spark.createDataFrame([(1, "chr1", 990, 1025), (2, "chr1", 1003, 1006), (3, "chr1", 5, 5)], "region int, chr string, s long, e long")
    got = {(x.region, x.pos): x.depth for x in reads.coverage(df, region).collect()}
    deep = [*range(995, 1005), *range(1010, 1020), *range(1000, 1004), *range(1005, 1007)]
    assert got == {(1, p): deep.count(p) for p in range(990, 1025)} | {(2, p): deep.count(p) for p in range(1003, 1006)}
    only = reads.coverage(df, region, spark.createDataFrame([("b",), ("b",)], "cb string"))
    assert {x.pos for x in only.where("region = 1 AND depth > 0").collect()} == {1000, 1001, 1002, 1003, 1005, 1006}


# ---- batches


def plain_correct(values, b, keep):
    """values: genes x spots with nan; the definition with dense matrices."""
    b_levels, k_levels = sorted(set(b)), sorted(set(keep))
    kept = np.column_stack([np.ones(len(b)), *[(np.array(keep) == x).astype(float) for x in k_levels[1:]]])
    own = np.column_stack([(np.array(b) == x).astype(float) for x in b_levels[1:]])
    q, _ = np.linalg.qr(kept)
    free = own - q @ (q.T @ own)
    free[np.abs(free) < 1e-9] = 0
    out = values.copy()
    for row in out:
        seen = ~np.isnan(row)
        if seen.sum() < max(3, kept.shape[1] + own.shape[1] + 1):
            continue
        rest = row[seen] - q[seen] @ (q[seen].T @ row[seen])
        gamma = np.linalg.lstsq(free[seen], rest, rcond=1e-8)[0]
        row[seen] -= (own @ gamma)[seen]
    return out


@pytest.mark.parametrize("collinear", [False, True])
def test_batches_equal_dense_least_squares(spark, collinear):
    r = np.random.default_rng(5)
    n, genes = 60, 12
    b = [f"b{x}" for x in r.integers(0, 4, n)]
    keep = [x if collinear else int(y) for x, y in zip(b, r.integers(0, 2, n))]
    values = r.random((genes, n)) + np.array([int(x[1]) * 0.3 for x in b])
    values[r.random((genes, n)) < 0.5] = np.nan
    values[0, 4:] = np.nan
    values[1] = np.nan
    kind = "string" if collinear else "int"
    spots = spark.createDataFrame([(i, b[i], keep[i]) for i in range(n)], f"spot long, batch string, condition {kind}")
    usage = spark.createDataFrame([(g, i, None if np.isnan(values[g, i]) else float(values[g, i])) for g in range(genes) for i in range(n)], "gene long, spot long, value double")
    got = np.full((genes, n), np.nan)
    for x in batch.correct(usage, spots, "batch", "condition").collect():
        got[x.gene, x.spot] = np.nan if x.corrected is None else x.corrected
    assert np.allclose(got, plain_correct(values, b, keep), equal_nan=True, atol=1e-8)


def test_batches_of_one_level_and_without_condition(spark):
    spots = spark.createDataFrame([(i, "a" if i < 5 else "b", "only") for i in range(10)], "spot long, batch string, one string")
    usage = spark.createDataFrame([(1, i, 1.0 + (i >= 5)) for i in range(10)], "gene long, spot long, value double")
    assert {x.corrected for x in batch.correct(usage, spots, "one").collect()} == {1.0, 2.0}
    assert {round(x.corrected, 9) for x in batch.correct(usage, spots).collect()} == {1.0}
    assert batch.correct(usage.limit(0), spots).count() == 0


# ---- patterns


def plain_ward(x, k):
    clusters = {i: [i] for i in range(len(x))}

    def gap(a, b):
        p, q = x[clusters[a]], x[clusters[b]]
        return 2 * len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum()

    while len(clusters) > k:
        a, b = min(((a, b) for a in clusters for b in clusters if a < b), key=lambda p: (gap(*p), p))
        clusters[a] += clusters.pop(b)
    return sorted(sorted(c) for c in clusters.values())


@pytest.mark.parametrize("k", [1, 5])
def test_ward_equals_one_merge_after_the_other(spark, k):
    r = np.random.default_rng(6)
    x = r.normal(size=(26, 6)) + 3 * r.integers(0, 3, 26)[:, None]
    values = spark.createDataFrame([(g, s, float(x[g, s])) for g in range(26) for s in range(6)], "gene long, spot long, value double")
    got = {}
    for row in patterns.ward(values, k, block=16).collect():
        got.setdefault(row.pattern, []).append(row.gene)
    z = (x - x.mean(0)) / x.std(0)
    assert sorted(sorted(c) for c in got.values()) == plain_ward(z, k)


def test_ward_of_few_and_equal_genes(spark):
    same = spark.createDataFrame([(g, s, 1.0) for g in range(5) for s in range(3)], "gene long, spot long, value double")
    assert {x.pattern for x in patterns.ward(same, 1).collect()} == {0}
    assert len({x.pattern for x in patterns.ward(same, 2).collect()}) == 2
    assert [tuple(x) for x in patterns.ward(same.where("gene = 3"), 4).collect()] == [(3, 0)]
    assert patterns.ward(same.limit(0), 2).count() == 0


def test_ward_of_genes_without_a_row_for_some_spots(spark, monkeypatch):
    monkeypatch.setattr(patterns, "STRETCH", 4)
    r = np.random.default_rng(8)
    x = r.normal(size=(12, 9)) + 3 * r.integers(0, 3, 12)[:, None]
    x[r.random(x.shape) < 0.2] = np.nan
    values = spark.createDataFrame([(g, s, float(x[g, s])) for g in range(12) for s in range(9) if np.isfinite(x[g, s])], "gene long, spot long, value double")
    got = {}
    for row in patterns.ward(values, 3).collect():
        got.setdefault(row.pattern, []).append(row.gene)
    z = np.nan_to_num((x - np.nanmean(x, 0)) / np.nanstd(x, 0))
    assert sorted(sorted(c) for c in got.values()) == plain_ward(z, 3)


def test_descriptions_of_patterns(spark):
    rows, spots = _spots(spark, 30)
    cells, usage = _usage(spark, rows, 4)
    of = spark.createDataFrame([(g, g % 2) for g in range(4)], "gene long, pattern int")
    edges = spatial.knn_edges(spots, 4)
    got = {x.pattern: x for x in patterns.describe(usage, of, edges).collect()}
    profile = {}
    for g, s, v in cells:
        if v is not None:
            profile.setdefault((g % 2, s), []).append(v)
    near = {}
    for e in edges.collect():
        near.setdefault(e.src, []).append(e.dst)
    for k in (0, 1):
        p = {s: sum(v) / len(v) for (q, s), v in profile.items() if q == k}
        mean = sum(p.values()) / len(p)
        links = [(a, b, 1 / len(bs)) for a, bs in near.items() for b in bs if a in p and b in p]
        moran = len(p) / sum(w for *_, w in links) * sum(w * (p[a] - mean) * (p[b] - mean) for a, b, w in links) / sum((v - mean) ** 2 for v in p.values())
        assert got[k].n_genes == 2 and math.isclose(got[k]["mean"], mean) and math.isclose(got[k].morans_i, moran)


def test_dunn_and_silhouette_equal_all_pairs(spark):
    r = random.Random(4)
    pts = [(i, 5 * (i % 3) + r.gauss(0, 1), r.gauss(0, 1), i % 3) for i in range(70)] + [(70, 40.0, 0.0, 9), (71, 40.0, 0.0, None)]
    df = spark.createDataFrame(pts, "id long, x double, y double, k long")
    d = lambda a, b: math.dist(a[1:3], b[1:3])
    p = [q for q in pts if q[3] is not None]
    closest = min(d(a, b) for a in p for b in p if a[3] < b[3])
    widest = max(d(a, b) for a in p for b in p if a[3] == b[3])
    got = patterns.dunn(df, "k").first()
    assert math.isclose(got.closest, closest) and math.isclose(got.widest, widest) and math.isclose(got.dunn, closest / widest)
    for block in (1024, 16):
        s = {x.k: (x.n, x.silhouette) for x in patterns.silhouette(df, "k", ["x", "y"], block).collect()}
        for k in {q[3] for q in p}:
            own, parts = [q for q in p if q[3] == k], []
            for q in own:
                a = sum(d(q, o) for o in own) / (len(own) - 1) if len(own) > 1 else None
                b = min(sum(d(q, o) for o in p if o[3] == j) / sum(o[3] == j for o in p) for j in {o[3] for o in p} - {k})
                parts.append(0.0 if a is None else (b - a) / max(a, b))
            assert s[k][0] == len(own) and math.isclose(s[k][1], sum(parts) / len(parts), abs_tol=1e-9)
    one = df.where("k = 0")
    assert patterns.dunn(one, "k").first().dunn is None and patterns.dunn(df.limit(0), "k").first().dunn is None
    assert patterns.silhouette(one, "k", ["x", "y"]).first().silhouette is None


# ---- masks and benchmarks


def test_least_takes_rows_until_their_weights_are_enough(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, r.choice([r.random() ** 3, 0.25, 0.5]), r.randint(0, 4)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, key double, n long")
    for few in (4096, 5):
        monkeypatch.setattr(masks, "FEW", few)
        for target, weight in ((1, None), (333, None), (10_000, None), (400, "n"), (9999, "n")):
            want, got_so_far = [], 0
            for i, k, n in sorted(rows, key=lambda x: (x[1], x[0])):
                if got_so_far >= target:
                    break
                want.append(i)
                got_so_far += n if weight else 1
            assert sorted(x.id for x in masks.least(df, "key", ["id"], target, weight).collect()) == sorted(want), (few, target, weight)


def test_masks_take_the_share_from_where_they_should(spark):
    rows, spots = _spots(spark, 60)
    cells, usage = _usage(spark, rows, 8)
    seen = {(g, s) for g, s, v in cells if v is not None}
    at = {s[0]: s for s in rows}
    for kind in masks.KINDS:
        got = {tuple(x) for x in masks.mask(kind, usage, spots, 0.2, 3).collect()}
        assert got <= seen and len(got) == int(0.2 * len(seen)), kind
        assert got == {tuple(x) for x in masks.mask(kind, usage, spots, 0.2, 3).collect()}
        assert got != {tuple(x) for x in masks.mask(kind, usage, spots, 0.2, 4).collect()}
        of = {s for _, s in got}
        if kind == "spatial_block":
            assert len(of) < 30 and max(math.dist(at[a][1:3], at[b][1:3]) for a in of for b in of) < 45
        if kind == "layer_aware":
            assert len({at[s][3] for s in of}) < 3
    rare = usage.where("value IS NOT NULL AND (gene > 0 OR spot < 12)")
    often = [sum(x.gene == 0 for x in masks.mask("low_coverage", rare, spots, 0.1, s).collect()) for s in range(4)]
    assert sum(often) / 4 > 0.25 * rare.where("gene = 0").count()
    assert masks.mask("random", usage.where("value IS NULL"), spots, 0.2).count() == 0
    with pytest.raises(ValueError, match="kind"):
        masks.mask("none", usage, spots, 0.2)


def test_benchmark_equals_plain_errors(spark):
    rows, spots = _spots(spark, 40)
    cells, usage = _usage(spark, rows, 5)
    got = {(x.scenario, x.method): x for x in recover.benchmark(usage, spots, ["gene_mean", "spatial_knn", "gp"], {"a": ("random", 0.3), "b": ("spatial_block", 0.2)}, 2).collect()}
    assert set(got) == {(s, m) for s in "ab" for m in ("gene_mean", "spatial_knn", "gp")}
    value = {(g, s): v for g, s, v in cells if v is not None}
    rmse, bias = [], []
    for seed in (42, 43):
        out = {tuple(x) for x in masks.mask("random", usage, spots, 0.3, seed).collect()}
        mean = {g: np.mean([v for (h, s), v in value.items() if h == g and (h, s) not in out]) for g in range(5)}
        off = np.array([mean[c[0]] - value[c] for c in sorted(out)])
        rmse.append(np.sqrt((off**2).mean()))
        bias.append(off.mean())
    x = got["a", "gene_mean"]
    assert x.repeats == 2 and math.isclose(x.rmse, np.mean(rmse)) and math.isclose(x.bias, np.mean(bias), abs_tol=1e-12)
    assert got["a", "gp"].rmse < x.rmse and got["a", "gp"].pearson > 0.5
    with pytest.raises(ValueError, match="imputer"):
        recover.benchmark(usage, spots, [], {"a": ("random", 0.3)})


# ---- noise


def test_residuals_equal_refits_without_the_spot(spark):
    rows, spots = _spots(spark, 25)
    cells, usage = _usage(spark, rows, 2)
    at = {s[0]: np.array(s[1:3], float) for s in rows}
    for x in impute.loo_residuals(usage, spots, 12.0, 0.2).collect():
        own = [(s, v) for g, s, v in cells if g == x.gene and v is not None]
        mean = np.mean([v for _, v in own])
        rest = [(s, v) for s, v in own if s != x.spot]
        k = lambda a, b: np.exp(-((at[a] - at[b]) ** 2).sum() / (2 * 144.0))
        gram = np.array([[k(a, b) for b, _ in rest] for a, _ in rest]) + 0.2 * np.eye(len(rest))
        guess = mean + np.array([k(x.spot, a) for a, _ in rest]) @ np.linalg.solve(gram, np.array([v - mean for _, v in rest]))
        assert math.isclose(x.residual, x.value - guess, abs_tol=1e-9)


def test_noise_falls_back(spark):
    res = spark.createDataFrame([(1, 1, 0.2, 0.1), (1, 2, 0.4, -0.1), (1, 3, 0.3, 0.3), (2, 1, 0.5, 0.0), (2, 2, 0.7, 0.0)], "gene long, spot long, value double, residual double")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "src long, dst long")
    cells = spark.createDataFrame([(g, s) for g in (1, 2, 3) for s in (1, 2)], "gene long, spot long")
    got = {(x.gene, x.spot): x.noise for x in impute.residual_noise(res, edges, cells, 10.0).collect()}
    want = {(1, 1): 0.04, (1, 2): float(np.var([0.1, -0.1, 0.3])), (2, 1): 0.005, (2, 2): 0.005, (3, 1): 0.01, (3, 2): 0.01}
    assert all(math.isclose(got[k], 10 * v) for k, v in want.items()) and got.keys() == want.keys()


# ---- likelihoods and curves


@pytest.mark.parametrize("nu", [None, 0.5, 1.5, 2.5])
def test_likelihood_and_its_slope(nu):
    r = np.random.default_rng(3)
    at = r.random((20, 2)) * 10
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    y = r.normal(size=20)
    y -= y.mean()
    ll, slope = likelihood.profiled(d, y, 2.0, 0.3, nu)
    k = likelihood.shape(d, 2.0, nu)[0] + 0.3 * np.eye(20)
    a = y @ np.linalg.solve(k, y) / 20
    assert math.isclose(ll, -0.5 * (y @ np.linalg.solve(a * k, y) + np.linalg.slogdet(a * k)[1] + 20 * math.log(2 * math.pi)))
    h = 1e-5
    for i, (e, s) in enumerate([(math.exp(h), 1), (1, math.exp(h))]):
        up, down = (likelihood.profiled(d, y, 2.0 * e**q, 0.3 * s**q, nu)[0] for q in (1, -1))
        assert math.isclose(slope[i], (up - down) / (2 * h), rel_tol=1e-4, abs_tol=1e-5)


def test_search_is_never_below_a_grid():
    for seed in range(6):
        r = np.random.default_rng(seed)
        at = r.random((40, 2)) * 10
        d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
        y = np.sin(at[:, 0] * (0.3 + seed / 4)) + r.normal(size=40) * (0.05 + 0.3 * (seed % 3))
        y -= y.mean()
        ll, ell, noise = likelihood.search(d, y, [1.0, 4.0], [0.1, 1.0])
        fine = max(likelihood.profiled(d, y, e, s)[0] for e in np.geomspace(0.3, 20, 14) for s in np.geomspace(1e-3, 10, 12))
        assert ll >= fine - 0.05 and math.isclose(ll, likelihood.profiled(d, y, ell, noise)[0], rel_tol=1e-9)


def test_variance_parts_report_what_was_found(spark):
    rows, spots = _spots(spark, 40)
    _, usage = _usage(spark, rows, 2, share=1.0)
    for x in impute.variance_parts(usage, spots, [5.0, 20.0], [0.1, 1.0]).collect():
        y = np.array([r.value for r in usage.where(F.col("gene") == x.gene).orderBy("spot").collect()])
        at = np.array([s[1:3] for s in sorted(rows)], float)
        d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
        k = likelihood.shape(d, x.length, None)[0]
        fitted = k @ np.linalg.solve(k + x.noise * np.eye(40), y - y.mean())
        assert math.isclose(x.spatial, fitted.var(), rel_tol=1e-6) and math.isclose(x.total, y.var(), rel_tol=1e-9)
        assert likelihood.profiled(d, y - y.mean(), x.length, x.noise)[0] >= max(likelihood.profiled(d, y - y.mean(), e, s)[0] for e in (5.0, 20.0) for s in (0.1, 1.0)) - 1e-9


def test_splines_are_as_near_as_asked_and_no_rougher():
    r = np.random.default_rng(1)
    x = (np.arange(20) + 0.5) / 20
    assert np.allclose(trajectory.basis(x, 20).sum(1), 1)
    y = np.stack([0.5 + 0.4 * np.sin(6 * x) + r.normal(size=20) * s for s in (0.02, 0.2, 0.3)] + [0.2 + 0.5 * x])
    y[1, [3, 4, 19]] = np.nan
    got = trajectory.penalised(y, 0.1)
    off = np.nansum((got - y) ** 2, axis=1)
    assert (off <= 0.1 + 1e-6).all() and abs(off[1] - 0.1) < 1e-4 and abs(off[2] - 0.1) < 1e-4
    assert np.allclose(got[3], y[3], atol=1e-4)
    # the same spline by a dense solve with the penalty's weight that gives that miss
    b, seen = trajectory.basis(x, 20), np.isfinite(y[1])
    p = np.diff(np.eye(b.shape[1]), 2, axis=0)
    solve = lambda w: b @ np.linalg.solve(b[seen].T @ b[seen] + w * p.T @ p, b[seen].T @ y[1][seen])
    best = min(np.geomspace(1e-6, 1e6, 2400), key=lambda w: abs(((solve(w) - y[1])[seen] ** 2).sum() - 0.1))
    assert np.allclose(got[1], solve(best), atol=2e-3)


@pytest.mark.parametrize("method", ["spline", "lowess"])
def test_smoothed_curves_fill_and_stay_within_bounds(spark, method):
    rows = [(1, b, 0.1 * b) for b in range(10) if b != 4] + [(2, 0, 0.5), (2, 9, 0.7)]
    got = {(x.gene, x.bin): x.m for x in trajectory.smoothed(spark.createDataFrame(rows, "gene long, bin long, m double"), 12, method).collect()}
    assert {b for g, b in got if g == 1} == set(range(12)) and {b for g, b in got if g == 2} == {0, 9}
    assert all(0 <= v <= 1 for v in got.values()) and abs(got[1, 4] - 0.4) < 0.05 and got[2, 9] == 0.7


# ---- coverage, levels of certainty, parents


def test_quantile_bins_equal_numpy(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.random(40), [0.5] * 20])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(999, None)], "id long, x double")
    got = {t.id: t.bin for t in stats.quantile_bin(df, "x", 5).collect()}
    edges = np.quantile(x, [0.2, 0.4, 0.6, 0.8])
    assert got == {i: int(np.digitize(v, edges)) for i, v in enumerate(x)} | {999: None}


def test_blocks_calibrate_for_other_blocks(spark):
    import zlib

    r = random.Random(6)
    rows = [(f"b{i % 12}", 0.5, 0.5 + r.gauss(0, 0.1), 0.1 + 0.01 * (i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "block string, truth double, pred double, std double")
    got = stats.block_coverage(df, "block", 0.2).first()
    side = lambda b: zlib.crc32(b.encode()) % 5 < 3
    cal = sorted(abs(t - p) / s for b, t, p, s in rows if side(b))
    n = len(cal)
    q = cal[math.ceil(min(1.0, math.ceil((n + 1) * 0.8) / n) * (n - 1))]
    test = [abs(t - p) / s <= q for b, t, p, s in rows if not side(b)]
    assert math.isclose(got.q, q) and (got.n_calibration, got.n_test) == (n, len(test)) and math.isclose(got.coverage, sum(test) / len(test))
    one = stats.block_coverage(df.where("block = 'b1'"), "block", 0.2).first()
    assert one is None or one.n_calibration + one.n_test == 34  # one block has nothing to be rated on


def test_levels_keep_the_surest_spots_and_test_again(spark):
    rows = [("s", i, g, None if (i + g) % 3 == 0 else 0.1 * i, 0.01 * ((i * 7) % 10) + (5 if (i + g) % 3 else 0), 1 + (i >= 5)) for i in range(10) for g in (1, 2)]
    cells = spark.createDataFrame(rows, "sample string, spot long, gene long, value double, half double, g int")
    u = {}
    for _, i, g, v, h, _ in rows:
        u.setdefault(i, []).append((v is None, h))
    score = {i: np.mean([h for none, h in x if none] or [h for _, h in x]) for i, x in u.items()}
    order = sorted(score, key=lambda i: (round(score[i], 12), i))
    kept = stats.confident_spots(cells, {"all": 0.0, "less": 0.25})
    got = {}
    for x in kept.collect():
        got.setdefault(x.level, set()).add(x.spot)
    assert got == {"all": set(range(10)), "less": set(order[:8])}
    tests = stats.retest(cells, kept, "g").collect()
    assert {(x.level, x.gene) for x in tests} == {(k, g) for k in ("all", "less") for g in (1, 2)}
    for x in tests:
        own = [(v, g) for _, i, gene, v, _, g in rows if gene == x.gene and v is not None and i in got[x.level]]
        a, b = [v for v, g in own if g == 1], [v for v, g in own if g == 2]
        assert x.u == sum((p > q) + (p == q) / 2 for p in a for q in b) and (x.n1, x.n2) == (len(a), len(b))


def test_parents_pass_their_edges_on(spark):
    at = [(i, float(10 * (i // 3) + i % 3), 0.0, i // 3) for i in range(12)]
    spots = spark.createDataFrame([x[:3] for x in at], "spot long, x double, y double")
    parents = spark.createDataFrame([(x[0], x[3]) for x in at], "spot long, parent long")
    own = spark.createDataFrame([(0, 1, 1.0), (0, 3, 0.5)], "a long, b long, w double")
    got = {(x.a, x.b): x.w for x in recover.with_parents(own, spots, parents, None, 0.4, 1).collect()}
    near = math.exp(-0.5)  # parents 10 apart, the median distance
    want = {(a, b): 0.4 * near / 3 for a in range(12) for b in range(a + 1, 12) if b // 3 - a // 3 == 1}
    want[0, 1] = want.get((0, 1), 0) + 0.6
    want[0, 3] += 0.3
    linked = {(a // 3, b // 3) for a, b in got if a // 3 != b // 3}
    assert linked <= {(0, 1), (1, 2), (2, 3)} and all(math.isclose(w, want[k]) for k, w in got.items())
    assert {tuple(x) for x in recover.with_parents(own, spots, parents, None, 0.0).collect()} == {(0, 1, 1.0), (0, 3, 0.5)}


def test_a_parents_pair_is_not_shuffled_again(spark):
    spots = spark.createDataFrame([(i, float(10 * (i // 3) + i % 3), 0.0) for i in range(12)], "spot long, x double, y double")
    parents = spark.createDataFrame([(i, i // 3) for i in range(11)], "spot long, parent long")  # spot 11 has none
    own = spark.createDataFrame([(0, 1, 1.0), (3, 0, 0.5), (0, 9, 0.25), (2, 11, 0.125), (3, 0, 0.5)], "a long, b long, w double")
    out = recover.with_parents(own, spots, parents, None, 0.4, 1)
    got = {(x.a, x.b): x.w for x in out.collect()}
    assert math.isclose(got[0, 1], 0.6) and math.isclose(got[0, 9], 0.15) and math.isclose(got[2, 11], 0.075)
    assert math.isclose(got[0, 3] - got[1, 3], 0.6) and out.count() == len(got)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_residuals_of_many_spots_without_the_matrix_of_all_pairs(spark):
    """100,000 spots' distances would take 80 GB."""
    n = 100_000
    spots = spark.range(n).select(F.col("id").alias("spot"), (F.col("id") * 7919 % 1009).alias("x"), (F.col("id") * 104729 % 1013).alias("y"))
    usage = spots.select(F.lit(1).cast("bigint").alias("gene"), "spot", (F.col("x") / 1009 + F.pmod(F.xxhash64("spot"), F.lit(100)) / 1000).alias("value"))
    r = impute.loo_residuals(usage, spots, 400.0, 0.3).agg(F.count("*").alias("n"), F.stddev_pop("residual").alias("s")).first()
    assert r.n == n and 0.0285 < r.s < 0.0295  # the hash's own deviation is 0.0289


def test_columns_give_the_residuals_of_the_dense_matrix():
    rng = np.random.default_rng(3)
    at, y = rng.random((2500, 2)) * [900, 700], rng.random(2500) - 0.5
    f = likelihood.columns(at, 150.0)
    want = np.exp(-(likelihood.apart(at, at) ** 2) / (2 * 150.0**2))
    assert np.abs(f(at) @ f(at).T - want).max() < 1e-11
    inverse = np.linalg.inv(want + 0.3 * np.eye(2500))
    assert np.abs(likelihood.left_out(f, at, y, 0.3) - inverse @ y / np.diag(inverse)).max() < 1e-9
    assert likelihood.columns(at, 1.0) is None and likelihood.columns(at[:500], 150.0) is None
    line = likelihood.columns(np.column_stack([np.arange(600.0), np.zeros(600)]), 100.0)  # all of one y
    assert line is not None


def _counted(df):
    """df, and a count of its rows as they are computed."""
    n = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), n


@pytest.mark.parametrize("name", ["win16_masks", "eva05_repeated_masks"])
def test_masks_compute_the_values_once(spark, sf_dir, monkeypatch, name):
    """every pass over the keys computed them anew."""
    import __spark_entry__
    from spotloom.plans.views import Views

    usage, n = _counted(spark.read.schema("gene bigint, spot bigint, value double").parquet(_written(Views(spark, sf_dir).usage)))
    monkeypatch.setattr(Views, "usage", usage)
    __spark_entry__.queries()[name](spark, sf_dir).collect()
    assert n.value == usage.count()


def _written(df):
    from spotloom.operators.lineage import cut

    return cut(df)._written


def test_workflow_and_recipes_compute_the_values_once(spark, sf_dir, monkeypatch):
    """each recipe, and each of the workflow's results, computed them anew."""
    import __spark_entry__
    from spotloom.operators import cluster
    from spotloom.plans.views import Views
    from spotloom.plans.workflow import Workflow

    made = spark.read.schema("gene bigint, spot bigint, value double").parquet(_written(Views(spark, sf_dir).usage))
    usage, n = _counted(made)
    Workflow.of_usage(usage, Views(spark, sf_dir).spots, imputer="gene_mean").run()["trends"].collect()
    assert n.value == made.count()
    usage, n = _counted(made)
    monkeypatch.setattr(Views, "usage", usage)
    monkeypatch.setattr(cluster, "RECIPES", ("variable_genes", "places"))
    __spark_entry__.queries()["stu09_recipes"](spark, sf_dir).collect()
    assert n.value == made.count()


def test_spot_vectors_do_not_search_for_each_gene(spark):
    """A map of a spot's genes was searched from its start for every gene: quadratic in the genes."""
    r = np.random.default_rng(5)
    rows = [(g, s, None if r.random() < 0.2 else float(r.normal())) for g in range(0, 600, 2) for s in range(7) if r.random() < 0.8]
    got = expression.spot_vectors(spark.createDataFrame(rows, "gene long, spot long, value double"))
    assert "map_from_entries" not in got._jdf.queryExecution().toString()
    wide = pd.DataFrame(rows, columns=["gene", "spot", "value"]).pivot(index="spot", columns="gene", values="value").astype(float)
    want = ((wide - wide.mean()) / wide.std(ddof=0).where(lambda x: x > 0)).fillna(0.0)
    for row in got.collect():
        assert np.allclose(row.features.toArray(), want.loc[row.spot].to_numpy(), atol=1e-9)


def test_likelihood_by_columns_equals_that_of_all_pairs():
    r = np.random.default_rng(7)
    at, y = r.uniform(0, 900, (700, 2)), r.normal(size=700)
    y -= y.mean()
    few, all_ = likelihood.Places(at, y), likelihood.Pairs(likelihood.apart(at, at), y)
    for ell, noise, dense in ((30.0, 0.5, True), (200.0, 0.01, False), (500.0, 2.0, False), (30000.0, 100.0, False)):
        assert (few._sums(ell) is None) == dense
        assert few.value(ell, noise) == pytest.approx(all_.value(ell, noise), abs=1e-8)
        assert np.allclose(few.slope(ell, noise), all_.slope(ell, noise), rtol=1e-6, atol=1e-7)
        assert np.allclose(few.fitted(ell, noise), all_.fitted(ell, noise), atol=1e-9)


def test_likelihood_of_many_spots_without_the_matrix_of_all_pairs():
    import tracemalloc

    at = np.random.default_rng(2).uniform(0, 1000, (12000, 2))
    y = np.sin(at[:, 0] / 150) + np.random.default_rng(3).normal(size=12000)
    tracemalloc.start()
    try:
        process = likelihood.Places(at, y - y.mean())
        assert np.isfinite([process.value(150.0, 1.0), *process.slope(150.0, 1.0), *process.fitted(150.0, 1.0)]).all()
        assert tracemalloc.get_traced_memory()[1] < 2e8  # one matrix of all pairs has 1.2e9
    finally:
        tracemalloc.stop()


def test_recovery_reads_the_embedding_once(spark):
    """each view of the graph, and each pass of the fit, computed it anew."""
    n = spark.sparkContext.accumulator(0)
    r = random.Random(4)
    spots = spark.createDataFrame([(i, r.randrange(90), r.randrange(90)) for i in range(40)], "spot long, x long, y long")
    usage = spark.createDataFrame([(g, i, r.random()) for g in range(6) for i in range(40)], "gene long, spot long, value double")
    told = F.udf(lambda i: n.add(1) or [float(i % 7), float(i % 5)], "array<double>").asNondeterministic()
    got = recover.recover(usage, spots, 3, spots.select("spot", told("spot").alias("embedding")), k=5, method="kmeans")
    assert got["graph"].count() > 40 and n.value == 40
