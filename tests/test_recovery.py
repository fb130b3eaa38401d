import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.operators import cluster, expression, graph, impute, recover, spatial, trajectory


def _field(spark, missing=0.3, side=6):
    rng = np.random.default_rng(4)
    spots = [(i * side + j, i, j) for i in range(side) for j in range(side)]
    cells = [(g, s, None if rng.random() < missing else float(0.5 + 0.4 * np.sin((x + g * y) / 3))) for s, x, y in spots for g in (0, 1)]
    return spark.createDataFrame(cells, "gene long, spot long, value double"), spark.createDataFrame(spots, "spot long, x long, y long")


def test_knn_in_five_dimensions_equals_all_pairs(spark):
    r = random.Random(3)
    pts = [(i, [float(r.randint(0, 9)) for _ in range(5)]) for i in range(70)]
    got = {(e.src, e.dst) for e in spatial.knn_in(spark.createDataFrame(pts, "spot long, at array<double>"), "at", 4).collect()}
    want = {(a, b) for a, p in pts for _, b in sorted((sum((u - w) ** 2 for u, w in zip(p, q)), b) for b, q in pts if b != a)[:4]}
    assert got == want


@pytest.mark.parametrize("variant", expression.VARIANTS)
def test_expression_gp_recovers_a_smooth_field(spark, variant):
    usage, spots = _field(spark)
    e = spots.select("spot", F.array(F.col("x").cast("double"), (F.col("x") - F.col("y")).cast("double")).alias("embedding"))
    got = expression.expression_gp(usage, spots, e, variant).join(usage, ["gene", "spot"]).collect()
    assert len(got) == 72
    for r in got:
        x, y = divmod(r.spot, 6)
        if r.value is not None:
            assert r.imputed == r.value and r["std"] == 0
        else:
            assert abs(r.imputed - (0.5 + 0.4 * np.sin((x + r.gene * y) / 3))) < 0.15 and r["std"] >= 0


def test_expression_gp_without_values_or_embedding(spark):
    usage, spots = _field(spark)
    with pytest.raises(ValueError, match="embedding"):
        expression.expression_gp(usage, spots)
    none = usage.withColumn("value", F.lit(None).cast("double"))
    assert expression.expression_gp(none, spots, variant="spatial_radial").where("imputed IS NOT NULL").count() == 0


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1.0) for c in (0, 10) for a in range(c, c + 5) for b in range(a + 1, c + 5)] + [(4, 10, 0.1)]
    spots = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15), 99]], "spot long")
    got = {r.spot: r.domain for r in graph.leiden(spark.createDataFrame(edges, "a long, b long, w double"), spots).collect()}
    assert [got[i] for i in range(5)] == [0] * 5 and [got[i] for i in range(10, 15)] == [1] * 5 and got[99] == 2


def test_subset_gp_uses_few_spots_and_keeps_values(spark):
    usage, spots = _field(spark)
    got = recover.subset_gp(usage, spots, 8, [2.0, 4.0]).join(usage, ["gene", "spot"]).collect()
    assert len(got) == 72 and all(0 <= r.imputed <= 1 for r in got) and all(r.imputed == r.value for r in got if r.value is not None)


def test_variance_parts_tell_smooth_from_noise(spark):
    rng = np.random.default_rng(0)
    usage, spots = _field(spark, missing=0)
    noise = usage.where("gene = 0").select(F.lit(7).cast("long").alias("gene"), "spot", F.element_at(F.array(*[F.lit(float(v)) for v in rng.uniform(size=36)]), (F.col("spot") + 1).cast("int")).alias("value"))
    got = {r.gene: r for r in impute.variance_parts(usage.union(noise), spots, [1.0, 3.0], [0.1, 1.0, 3.0]).collect()}
    assert got[0].r2 > 0.9 and got[7].r2 < 0.7


def test_passes_fill_step_by_step(spark):
    usage = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, None), (1, 9, None)], "gene long, spot long, value double")
    chain = spark.createDataFrame([(1, 0), (2, 1)], "src long, dst long")
    assert {r.spot: r.imputed for r in impute.neighbour_passes(usage, chain, 10).collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 9: 1.0}


def test_recover_says_what_it_lacks(spark):
    usage, spots = _field(spark)
    got = recover.recover(usage, spots, 2, k=4)
    assert got["notes"].count() == 2 and got["domains"].count() == 36
    seen = got["recovered"].join(usage, ["gene", "spot"]).where("value IS NOT NULL AND imputed <> value").count()
    assert got["recovered"].count() == 72 and seen == 0


def test_trajectory_along_a_line(spark):
    spots = spark.createDataFrame([(i, i, 0) for i in range(10)], "spot long, x long, y long")
    usage = spark.createDataFrame([(g, i, i / 10 if g else 0.5) for g in (0, 1) for i in range(10)], "gene long, spot long, value double")
    got = trajectory.analyse(usage, spots, spatial.knn_edges(spots, 2), (0, 0), (9, 0), 5)
    path = got["path"].orderBy("seq").collect()
    assert path[0].spot == 0 and path[-1].spot == 9 and path[0].p == 0 and path[-1].p == pytest.approx(1)
    assert {r.gene: r["class"] for r in got["classes"].collect()} == {0: "stable", 1: "increasing"}
    assert got["ranked"].orderBy("rank").first().gene == 1


def test_a_new_imputer_is_validated(spark):
    usage, spots = _field(spark)
    recover.add_imputer("half", lambda u, s: u.select("gene", "spot", F.lit(0.5).alias("imputed")))
    try:
        got = {r.method: r for r in recover.cross_validate(usage, spots, ["half", "gene_mean"], 2).collect()}
        assert got["half"].folds == 2 and got["gene_mean"].rmse > 0
        with pytest.raises(ValueError, match="half"):
            recover.add_imputer("half", lambda u, s: u)
    finally:
        del recover.IMPUTERS["half"]


def test_knn_in_compares_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 16)
    r = random.Random(12)
    pts = [(i, [0.0, 0.0, float(r.randint(0, 4)), float(r.randint(0, 4))]) for i in range(70)]
    edges = spatial.knn_in(spark.createDataFrame(pts, "spot long, at array<double>"), "at", 5)
    d2 = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    want = {(i, j, d, k + 1) for i, a in pts for k, (d, j) in enumerate(sorted((d2(a, b), j) for j, b in pts if j != i)[:5])}
    assert {(e.src, e.dst, e.d2, e.rank) for e in edges.collect()} == want
    assert "zip_with" not in edges._jdf.queryExecution().optimizedPlan().toString()  # no row for each pair
    few = spatial.knn_in(spark.createDataFrame(pts[:3], "spot long, at array<double>"), "at", 5)
    assert few.count() == 6 and spatial.knn_in(spark.createDataFrame(pts[:1], "spot long, at array<double>"), "at", 5).count() == 0


def test_recovered_values_alone_make_no_graph(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a graph was made")

    spots = spark.createDataFrame([(i, i % 4, i // 4) for i in range(12)], "spot long, x long, y long")
    usage = spark.createDataFrame([(g, s, None if (g + s) % 5 == 0 else (g + s) / 20) for g in range(3) for s in range(12)], "gene long, spot long, value double")
    whole = recover.recover(usage, spots, 2, source="none", k=3)["recovered"].collect()
    monkeypatch.setattr(spatial, "knn_edges", never)
    assert sorted(recover.recover(usage, spots, 2, source="none", k=3, only="recovered")["recovered"].collect()) == sorted(whole)


def test_likelihood_ratio_equals_eigenvalues_by_gene_and_length(spark):
    from spotloom.operators import impute

    r = np.random.default_rng(3)
    at = r.integers(0, 60, (300, 2))
    y = np.sin(at[:, 0] / 9) + r.normal(size=300) * 0.4
    spots = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(at)], "spot long, x long, y long")
    usage = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)] + [(2, i, 0.5) for i in range(300)], "gene long, spot long, value double")
    found = impute.likelihood_ratio(usage, spots, [5.0, 15.0])
    got = {x.gene: x for x in found.collect()}
    z, best = (y - y.mean()) / y.std(), (0.0, None, None)
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    for ell in (5.0, 15.0):
        w, v = np.linalg.eigh(np.exp(-d2 / (2 * ell * ell)))
        for s in (0.1, 0.25, 0.5, 0.75, 0.9):
            lam = s * np.maximum(w, 0) + 1 - s
            best = max(best, (-300 * np.log((((v.T @ z) ** 2) / lam).mean()) - np.log(lam).sum(), s, ell), key=lambda b: b[0])
    assert got[1].lr == pytest.approx(best[0]) and (got[1].share, got[1].length, got[1].n) == (*best[1:], 300)
    assert tuple(got[2]) == (2, 300, 0.0, 1.0, 0.0, None)
    assert "k#" in found._jdf.queryExecution().optimizedPlan().toString()  # a group is a gene and a length


def test_expression_gp_spreads_genes_and_solves_by_the_triangle(spark):
    from spotloom.operators import likelihood

    r = np.random.default_rng(5)
    a = r.normal(size=(600, 600))
    low, b = np.linalg.cholesky(a @ a.T + 600 * np.eye(600)), r.normal(size=(600, 3))
    assert np.allclose(likelihood.forward(low, b), np.linalg.solve(low, b)) and np.allclose(likelihood.forward(low, b[:, 0]), np.linalg.solve(low, b[:, 0]))
    spots = spark.createDataFrame([(i, i % 4, i // 4) for i in range(12)], "spot long, x long, y long")
    usage = spark.createDataFrame([(1, s, None if s % 5 == 0 else s / 20) for s in range(12)], "gene long, spot long, value double")
    plan = expression.expression_gp(usage, spots, None, "spatial_radial")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_a_gene_seen_at_few_of_many_spots_needs_little_memory(spark):
    """All pairs of the spots would take 160 GB."""
    n = 100_000
    spots = spark.range(n).select(F.col("id").alias("spot"), (F.col("id") % 300).alias("x"), F.floor(F.col("id") / 300).alias("y"))
    usage = spots.select(F.lit(1).cast("long").alias("gene"), "spot", F.when(F.col("spot") % 20_000 == 0, (F.col("spot") % 7) / 10).cast("double").alias("value"))
    got = impute.exact_gp(usage, spots, [80.0], [0.1]).agg(F.count("imputed").alias("n"), F.count_if(F.col("std") == 0).alias("seen"), F.max("std").alias("most")).first()
    assert (got.n, got.seen) == (n, 5) and 0 < got.most < 1
