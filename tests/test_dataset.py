import math
import random

import pytest
from pyspark.sql import functions as F

from spotloom import __main__ as cli
from spotloom.dataset import Dataset
from spotloom.plans.workflow import Workflow, differential
from spotloom.sources import tables


@pytest.fixture(scope="module")
def small(spark):
    r = random.Random(1)
    spots = [(i, float(i % 8), float(i // 8)) for i in range(64)]
    cells = [(g, s, min(1.0, max(0.0, (0.2 + 0.6 * (x > 3.5) if g % 2 else 0.5) + r.gauss(0, 0.05))) if r.random() < 0.8 else None) for g in range(8) for s, x, _ in spots]
    return spark.createDataFrame(cells, "gene long, spot long, value double"), spark.createDataFrame(spots, "spot long, x double, y double")


def test_accessors(spark, small, tmp_path):
    d = Dataset(*small)
    assert d.layers == [] and d.labels == []
    full = d.with_layer("imputed", small[0].where("gene < 4").fillna(0.5)).with_labels("domain", small[1].select("spot", (F.col("spot") % 3).alias("domain")))
    assert full.has("imputed") and full.has("domain") and not d.has("imputed")
    assert full.get("imputed").where("value IS NOT NULL").count() == 4 * 64 and full.get("domain").where("label = 1").count() == 21
    row = full.status().first()
    assert (row.n_genes, row.n_spots, row.n_cells, row.n_imputed) == (8, 64, 512, 256)
    part = full.with_genes(spark.createDataFrame([(1,), (2,), (99,)], "gene long")).with_spots(small[1].where("spot < 10"))
    assert part.status().first().n_cells == 20 and part.spots.count() == 10
    with pytest.raises(ValueError, match="unknown"):
        d.with_layer("bad", spark.createDataFrame([(1, 777, 0.5)], "gene long, spot long, value double"))
    with pytest.raises(ValueError, match="more than once"):
        d.with_labels("bad", small[1].select("spot", F.lit(1).alias("domain")).union(small[1].select("spot", F.lit(2))))
    with pytest.raises(KeyError):
        d.get("nothing")
    full.with_sites(spark.createDataFrame([(1, 2)], "site long, gene long")).save(str(tmp_path / "d"))
    back = Dataset.load(spark, str(tmp_path / "d"))
    assert back.layers == ["imputed"] and back.labels == ["domain"] and back.sites.count() == 1
    both = Dataset.pooled({"a": d, "b": full})
    assert both.spots.select("sample").distinct().count() == 2 and both.status().first().n_cells == 1024 and both.layers == ["imputed"]


def test_workflow_from_values(spark, small):
    out = Workflow.of_usage(*small, n_domains=2, neighbours=4, imputer="gene_mean").run()
    assert out["imputed"].where("imputed IS NULL").count() == 0
    trends = out["trends"].orderBy("rank").collect()
    assert {x.gene for x in trends[:4]} == {1, 3, 5, 7}
    assert 0 < out["calibration"].first().q < 0.6
    got = out["differential"].where("half = 1 AND padj < 0.01")
    assert out["differential"].select("gene", "half").distinct().groupBy("gene").count().where("count > 1").count() == 0
    assert {x.gene % 2 for x in got.collect()} <= {1}
    with pytest.raises(ValueError, match="imputer"):
        Workflow.of_usage(*small, imputer="none")


def test_differential_leaves_small_sides_out(spark):
    rows = [(1, v, "a") for v in (0.1, 0.2, 0.3)] + [(1, v, "b") for v in (0.7, 0.8, 0.9)] + [(1, 0.5, "c"), (1, 0.4, None)]
    got = {x.label: x for x in differential(spark.createDataFrame(rows, "gene long, value double, label string"), "label").collect()}
    assert set(got) == {"a", "b"} and got["a"].n1 == 3 and got["a"].n2 == 4
    assert math.isclose(got["b"].log2fc, math.log2((0.8 + 1e-6) / ((0.6 + 0.5) / 4 + 1e-6)))


def test_command_line(spark, small, tmp_path):
    usage, spots = (df.toPandas() for df in small)
    wide = usage.pivot(index="gene", columns="spot", values="value")
    wide.columns = [f"s{c}" for c in wide.columns]
    wide.index = [f"g{i}" for i in wide.index]
    wide.to_csv(tmp_path / "usage.csv")
    spots.assign(barcode="s" + spots.spot.astype(str))[["barcode", "x", "y"]].to_csv(tmp_path / "at.csv", index=False)
    spots.assign(barcode="s" + spots.spot.astype(str), label=(spots.x > 3.5).map({True: "right", False: "left"}))[["barcode", "label"]].to_csv(tmp_path / "labels.csv", index=False)
    common = ["--usage", str(tmp_path / "usage.csv"), "--coordinates", str(tmp_path / "at.csv")]
    a = cli.arguments(["diff", *common, "--labels", str(tmp_path / "labels.csv"), "--output", str(tmp_path / "out")])
    tables.write_results(cli.results(spark, a), a.output)
    found = spark.read.parquet(str(tmp_path / "out" / "significant")).collect()
    assert {x.gene for x in found} == {"g1", "g3", "g5", "g7"} and {x.label for x in found} == {"left", "right"}
    a = cli.arguments(["impute", *common, "--imputer", "spatial_knn", "--output", str(tmp_path / "filled")])
    filled = cli.results(spark, a)["imputed"]
    assert filled.count() == 512 and filled.where("imputed IS NULL OR gene IS NULL OR spot IS NULL").count() == 0
    a = cli.arguments(["run", *common, "--domains", "2", "--output", "x"])
    assert set(cli.results(spark, a)) == {"edges", "usage", "imputed", "calibration", "domains", "differential", "trends", "report"}
    with pytest.raises(SystemExit):
        cli.arguments(["plot"])


def test_loaders_and_writers(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("x,y\n" + "".join(f"{i},0\n" for i in range(50)))
    at = tables.coordinates(spark, str(tmp_path / "plain.csv")).collect()
    assert {(int(r.spot), r.x) for r in at} == {(i, float(i)) for i in range(50)}
    many = tables.numbered_rows(spark.range(0, 100, 1, 7), "n")
    assert all(r.id == r.n for r in many.collect())
    (tmp_path / "apa_matrix.csv").write_text("spot,g1,g2\na,0.1,\nb,0.3,0.4\nz,1,1\n")
    (tmp_path / "coordinates.csv").write_text("spot_id,x,y\na,1,2\nb,3,4\nq,0,0\n")
    usage, spots = tables.published(spark, str(tmp_path))
    assert {tuple(r) for r in usage.collect()} == {("g1", "a", 0.1), ("g2", "a", None), ("g1", "b", 0.3), ("g2", "b", 0.4)} and {r.spot for r in spots.collect()} == {"a", "b"}
    (tmp_path / "metadata.csv").write_text("spot_id,layer\na,L1\n")
    assert {(r.spot, r.layer) for r in tables.published(spark, str(tmp_path))[1].collect()} == {("a", "L1"), ("b", None)}
    usage.join(spots, "spot").write.parquet(str(tmp_path / "m.parquet"))
    places, values = tables.two_way(spark, str(tmp_path / "plain.csv"), str(tmp_path / "m.parquet"))
    assert {r.spot for r in places.collect()} == {"a", "b"} and values.count() == 4
    assert tables.two_way(spark, str(tmp_path / "plain.csv"))[1] is None
    sites = spark.createDataFrame([("chr1", 1, 9, 7, 0.5, "+")], "chr string, s long, e long, gene long, support double, strand string")
    tables.write_sites(sites, str(tmp_path / "bed"))
    assert spark.read.text(str(tmp_path / "bed")).first().value == "chr1\t1\t9\t7\t500\t+"
    tables.write_sites(sites, str(tmp_path / "tsv"), "tsv")
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).first().asDict()["support"] == "0.5"
    page = tables.report({"sites": sites}, "Run")
    assert page.startswith("# Run\n\n## sites\n\n1 rows\n") and "| chr1 | 1 | 9 | 7 | 0.5 | + |" in page
    rated = spark.createDataFrame([("a", 0.2, 0.9), ("b", 0.1, 0.5), ("c", 0.1, None)], "method string, rmse double, pearson double")
    assert {tuple(r) for r in tables.best_methods(rated).collect()} == {("rmse", "b", 0.1), ("pearson", "a", 0.9)}
