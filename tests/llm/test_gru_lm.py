import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.llm import gru_lm as G
from spotloom.llm.common import remainder


def slow_score(g, text):
    """One step after another, with the plain definitions."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    n, h, x, out = g.hidden, np.zeros(g.hidden), g.size, 0.0
    for y in text:
        a, q = g.p["emb"][x], h @ g.p["u"]
        z, r = sigmoid(a[:n] + q[:n]), sigmoid(a[n : 2 * n] + q[n : 2 * n])
        h = h + z * (np.tanh(a[2 * n :] + r * q[2 * n :]) - h)
        c = h @ g.p["cw"] + g.p["cb"]
        k = y // g.width
        w = h @ g.p["ww"][k].T + g.p["wb"][k]
        out += float(c[k] - np.log(np.exp(c).sum()) + w[y % g.width] - np.log(np.exp(w).sum()))
        x = y
    return out


def test_lanes_and_windows_carry_the_state():
    r, g = np.random.default_rng(1), G.Gru(30, hidden=6, width=8)
    texts = [r.integers(0, 30, n) for n in (1, 3, 33, 70, 64, 2)]
    want = [slow_score(g, t) for t in texts]
    for lanes, window in ((512, 32), (2, 5), (3, 1), (1, 64)):
        assert np.allclose(g.score(texts, lanes, window), want, rtol=1e-4)
    assert len(g.score([])) == 0


def test_lanes_hold_each_text_once():
    r = np.random.default_rng(5)
    texts = [r.integers(0, 9, n) for n in (5, 1, 4, 4, 9, 2, 1)]
    x, y, first, text, live = G.in_lanes(texts, 3, 9)
    at = [(t, j) for j in range(x.shape[1]) for t in range(len(x)) if j < live[t]]
    for i, want in enumerate(texts):
        own = [p for p in at if text[p] == i]
        assert [y[p] for p in own] == want.tolist() and [bool(first[p]) for p in own] == [True] + [False] * (len(want) - 1)
        assert [x[p] for p in own] == [9, *want[:-1].tolist()]
    assert live == sorted(live, reverse=True)


def test_probabilities_sum_to_one():
    g = G.Gru(30, hidden=6, width=8)
    h = np.random.default_rng(2).normal(size=(6, 1)).astype(np.float32)
    assert np.exp(g.log_probs(np.repeat(h, 30, 1), np.arange(30))).sum() == pytest.approx(1, abs=1e-5)


def test_gradients_equal_differences():
    r, g = np.random.default_rng(3), G.Gru(12, hidden=4, width=5, dtype=np.float64)
    x, y, first = r.integers(0, 13, (6, 3)), r.integers(0, 12, (6, 3)), r.random((6, 3)) < 0.2
    live, h0, grad, other = [3, 3, 2, 2, 2, 1], r.normal(size=(4, 3)), np.empty_like(g.vector), np.empty_like(g.vector)
    g.gradients(x, y, first, live, h0, grad)
    for i in r.choice(len(grad), 60, replace=False):
        old, e = g.vector[i], 1e-5
        if old < -50:
            continue
        g.vector[i] = old + e
        up = g.gradients(x, y, first, live, h0, other)[0]
        g.vector[i] = old - e
        down = g.gradients(x, y, first, live, h0, other)[0]
        g.vector[i] = old
        assert grad[i] == pytest.approx((up - down) / (2 * e), abs=1e-6), i


def test_training_helps():
    texts = [np.array([2, 3, 4, 5] * 10 + [1]) for _ in range(60)]
    g = G.Gru(12, hidden=8, width=4)
    adam = G.Adam(g)
    assert sum(adam.read(texts, 8) for _ in range(4)) == 4 * 60 * 41
    assert g.score(texts[:1])[0] / 41 > math.log(1 / 12) / 3


def test_rounds_read_every_training_document(spark, monkeypatch):
    """With one document a task the average must hang on each of them; the held-out one has no say."""
    monkeypatch.setattr(G, "TRAIN_TOKENS", 100)
    texts = [f"a{i} b a{i} b a{i} b" for i in range(12)]
    index = {w.encode(): i + 2 for i, w in enumerate(["b", *(f"a{i}" for i in range(12))])}

    def vector(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(4, "doc_id")
        return G.fitted(df, G.Gru(15, hidden=4, width=4), index, 84).vector.copy()

    rows = [(i, t, i != 3) for i, t in enumerate(texts)]
    full = vector(rows)
    assert np.array_equal(full, vector([(i, "b b" if i == 3 else t, ok) for i, t, ok in rows]))
    for i in (0, 5, 11):
        assert not np.array_equal(full, vector([r for r in rows if r[0] != i]))


def test_spelling_sums_to_one():
    words = [b"ab", b"ba", b"aab"]
    counts = [np.zeros((c, 257), np.int64) for c in G.CONTEXTS]
    for w in words:
        b = np.concatenate([[256], np.frombuffer(w, np.uint8), [256]]).astype(np.int64)
        for n, c in zip(counts, G._contexts(b)):
            np.add.at(n, (c, b[1:]), 1)
    s = G.Spelling(counts)
    assert np.allclose(s.all(words), [s(w) for w in words])
    assert sum(math.exp(s(bytes([c]))) for c in range(256)) <= 1
    assert s(b"ab") > s(b"bb") > s(b"zz")


def test_base_columns_equal_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", "The\x0bTHE the", "é É"] + [" ".join(f"W{int(r.random() ** 3 * 60)}" for _ in range(r.randint(0, 50))) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(2, texts[2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train int")
    crc = {r.doc_id: r.m for r in df.select("doc_id", remainder(F.col("doc_id"), 7).alias("m")).collect()}
    split = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i, t, _ in rows if crc[i] != 2 for w in split(t))
    n, v = sum(c.values()), len(c)
    for most in (G.FREQUENT, 20):  # with and without tokens to look up
        got = G.scored(df, remainder(F.col("doc_id"), 7) != 2, n_words=20, most=most).collect()
        assert len(got) == len(rows)
        for x in got:
            t = split(texts[x.doc_id])
            assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(t), sum(c[w] > 0 for w in t), n, crc[x.doc_id] == 2)
            assert x.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
            assert x.score < 0


def test_a_very_long_text_and_odd_columns(spark):
    long = "one two three " * 60_000
    df = spark.createDataFrame([(1, long, 1.0, "x"), (1, long, 2.0, "y"), (None, "four", None, None)], "doc_id long, text string, row double, token string")
    got = G.scored(df, F.lit(True)).orderBy("n_tokens").collect()
    assert [r.n_tokens for r in got] == [2, 180_001, 180_001] and got[1].score == pytest.approx(got[2].score) and got[1].score < 0


def test_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert len(G.scored(df, F.lit(False)).collect()) == 2
    assert G.scored(df.limit(0), F.lit(True)).count() == 0


def test_beats_the_base_on_held_out_documents(spark):
    got = G.op2_gru_lm(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b
