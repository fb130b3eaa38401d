import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.llm import fm_quality as Q
from spotloom.llm.common import remainder


def test_linear_time_identity():
    m, r = Q.Machine(50, 4), np.random.default_rng(1)
    m.w[:] = r.normal(size=50)
    m.v[:] = r.normal(size=(50, 4))
    col, val = np.array([3, 9, 20, 41]), np.array([1, 0.5, 2, 0.25], np.float32)
    pairs = sum(float(m.v[a] @ m.v[b]) * va * vb for i, (a, va) in enumerate(zip(col, val)) for b, vb in list(zip(col, val))[i + 1 :])
    assert m.raw(col, val) == pytest.approx(m.bias + float(m.w[col] @ val) + pairs, rel=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = (got.predicted == got.quality).mean()
    assert hit > 0.97, hit
    assert got.score.between(0, 1).all()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", 3, 1), (2, "", 3, 1), (3, "good words here", 15, 1)], "doc_id long, text string, n_chars long, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = Q.train(docs, none, "quality", F.lit(True))
    assert [(r.score, r.score_) for r in Q.scores(docs, m).collect()] == [(1, 0.5)] * 4
    one = spark.createDataFrame([(3, 1), (3, None), (None, 0), (1, 1)], "doc_id long, quality int")
    m = Q.train(docs, one, "quality", F.lit(True))
    assert all(r.score_ > 0.99 for r in Q.scores(docs, m).collect())
    assert Q.scores(docs.limit(0), m).count() == 0


def test_the_query_equals_plain_scores(spark, sf_dir):
    """Each row's score is the pairwise sum over its features, by definition."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    m = Q.train(docs, labels, "quality", remainder(F.col("doc_id"), 3) != 1)
    rows = {r.doc_id: r for r in docs.collect()}
    for x in Q.op10_quality(spark, sf_dir).limit(40).collect():
        col, val = Q.features(rows[x.doc_id].text.encode(), rows[x.doc_id].n_chars)
        v = m.v[col].astype(float) * val[:, None]
        gram = v @ v.T
        raw = m.bias + float(m.w[col].astype(float) @ val) + gram[np.triu_indices(len(col), 1)].sum()
        assert x.score == pytest.approx(1 / (1 + np.exp(-np.clip(raw, -30, 30))), abs=1e-4) and x.predicted == (x.score >= 0.5)


def test_a_very_long_text_and_a_repeated_id(spark):
    long = "some words to read " * 60_000
    docs = spark.createDataFrame([(1, long, len(long)), (2, "x", 1), (2, "y", 1), (2, "y", 1)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = Q.scores(docs, Q.train(docs, labels, "quality", F.lit(True))).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
