import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spotloom.llm import toxicity as X
from spotloom.llm.common import remainder


def made(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        y = i % 2
        words = [f"w{int(r.random() ** 2 * 40)}" for _ in range(r.randint(0, 30))] + [f"{'bad' if y else 'fine'}{r.randint(0, 6)}" for _ in range(r.randint(0, 5))]
        out.append((i, y, Counter(w.encode() for w in words)))
    return out


def test_block_max_gives_the_exact_nearest():
    ex = made(400)
    for block in (8, 64):
        index = X.Index(ex, block=block)
        assert len(index.vocab) == len(set().union(*(w for _, _, w in ex)))
        vec = [dict(zip(*map(list, index.vector(w)))) for _, _, w in ex]
        place = {int(i): j for j, i in enumerate(index.ids)}
        for _, _, words in made(80, seed=9):
            q = dict(zip(*map(list, index.vector(words))))
            sims = sorted(((-round(sum(q[t] * v.get(t, 0) for t in q), 10), i) for (i, _, _), v in zip(ex, vec) if set(q) & set(v)))[: X.K]
            at, sim = index.nearest(words)
            assert np.allclose(sorted(sim), sorted(-s for s, _ in sims))
            clear = [i for s, i in sims if -s > sim[-1] + 1e-9] if len(sim) else []
            assert {place[i] for i in clear} <= set(at.tolist())


def test_isotonic():
    x, y = X.isotonic(np.array([0.1, 0.2, 0.2, 0.3]), np.array([0.0, 1.0, 0.0, 0.25]), np.ones(4))
    assert np.allclose(x, [0.1, 0.7 / 3]) and np.allclose(y, [0, 1.25 / 3])


def test_document_frequencies(spark):
    texts = [None, "", "A a b", "b, c", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    n, seen = X.document_frequencies(df, [b"a", b"b", "é".encode(), b"zz"])
    assert n == 5 and seen == {b"a": 1, b"b": 2, "é".encode(): 1}


def test_held_out(spark):
    """Some labels of 1 can't be learnt: shouting texts without an insult, and a language with 22 toxic examples."""
    sf = "/root/testdata/sf0.1"
    got = X.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got[got.toxic == 1].predicted.mean() > 0.85
    toxic, clean = (got[got.toxic == y].score.to_numpy() for y in (1, 0))
    assert np.mean([(t > clean).mean() + (t == clean).mean() / 2 for t in toxic]) > 0.95
    assert got.score.between(0, 1).all()
    assert math.isclose(got.score.mean(), got.toxic.mean(), abs_tol=0.03)


def test_the_query_equals_plain_nearest_neighbours(spark, sf_dir):
    """Scores from all similarities, by definition, and the same calibration."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    m = X.train(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    df = Counter()
    for t in texts.values():
        df.update(X.counted(t.encode()).keys())
    index = m.index

    def vector(words):
        v = {w: (1 + math.log(c)) * index.weight[index.vocab[w]] for w, c in words.items() if w in index.vocab}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()} if length else {}

    for w, i in index.vocab.items():
        assert X.LEAST_SHARE * 0.999 <= index.weight[i] / math.log1p(len(texts) / (1 + df[w])) <= 1
    ex = [(int(i), y, vector(X.counted(texts[int(i)].encode()))) for i, y in zip(index.ids, index.labels)]
    for x in X.op1_toxicity(spark, sf_dir).limit(30).collect():
        q = vector(X.counted(texts[x.doc_id].encode()))
        sims = sorted(((sum(q[w] * v[w] for w in q.keys() & v.keys()), -i, y) for i, y, v in ex), reverse=True)[: X.K]
        sims = [s for s in sims if s[0] > 0]
        vote = sum(s * y for s, _, y in sims) / sum(s for s, _, _ in sims) if sims else None
        want = m.alone if vote is None else np.interp(vote, *m.steps)
        assert math.isclose(x.score, want, abs_tol=1e-6) and x.predicted == (x.score >= X.THRESHOLD)


def test_a_very_long_text_and_a_tie(spark):
    rows = [(i, "bad bad thing", 1) for i in range(20)] + [(i, "fine day", 0) for i in range(20, 60)] + [(99, "bad " * 400_000, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    m = X.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows[:60]], "doc_id long, toxic int"), F.lit(True))
    got = {r.doc_id: r for r in X.scores(docs, ["doc_id"], m).collect()}
    assert got[99].score > 0.9 > 0.1 > got[30].score and got[99].evidence == [0, 1, 2, 3, 4]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "bad words", 1), (3, "bad words", 1)], "doc_id long, text string, evidence int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = X.train(docs, none, F.lit(True))
    assert [r.score for r in X.scores(docs, ["doc_id"], m).collect()] == [0.0] * 4
    one = spark.createDataFrame([(3, 1), (1, 0), (2, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    m = X.train(docs, one, F.lit(True))
    assert all(0 <= r.score <= 1 for r in X.scores(docs, ["doc_id"], m).collect())
    assert X.scores(docs.limit(0), ["doc_id"], m).count() == 0
