import hashlib
import random
from collections import Counter

from spotloom.llm import exact_substrings as X
from spotloom.llm.suffix_array import suffix_array


def test_suffix_array_equals_sorting():
    r = random.Random(1)
    for _ in range(2000):
        s = [r.randint(0, r.choice([0, 1, 2, 5])) for _ in range(r.randint(0, 40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    passage = [" ".join(word() for _ in range(k)) for k in (30, 45, 60, 200)]
    out = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, passage[2] * 2]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passage)
            a = r.randint(0, len(p) // 3)
            parts += [p[a : a + r.randint(100, 900)], " ".join(word() for _ in range(r.randint(0, 30)))]
        out.append(" ".join(parts))
    return out + out[8:12]


def test_against_brute_force_with_and_without_crowds(spark):
    for seed, crowd in ((1, X.CROWD), (2, 2)):
        t = texts(seed)
        df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(t)], "doc_id long, text string, n_bytes int")
        got = {r.doc_id: tuple(r)[1:] for r in X.digest(df, ["doc_id"], crowd=crowd).collect()}
        want = brute(t)
        assert [got[i] for i in range(len(t))] == want


def test_long_text_in_chunks(monkeypatch):
    data = random.Random(4).randbytes(5000)
    whole = X.runs(data)
    monkeypatch.setattr(X, "CHUNK", 700)
    cut = X.runs(data)
    assert sum(cut[1]) == sum(whole[1]) == len(data) - X.LENGTH + 1
    anchor = lambda r: {s + i: m for s, n, m in zip(*(x.tolist() for x in r[:3])) for i in range(n)}
    assert anchor(cut) == anchor(whole)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r.doc_id: tuple(r)[1:] for r in X.op7_exact_substrings(spark, sf_dir).collect()}
    assert [got[i] for i in docs.doc_id] == brute(docs.text.tolist())


def test_empty_table(spark):
    assert X.digest(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_rows_without_id_and_a_very_long_text(spark):
    r = random.Random(8)
    long = "".join(chr(r.randint(97, 122)) for _ in range(300_000))
    rows = [(None, long, 1), (None, long[1000:1300], 2), (5, "é" * 99, 3), (5, None, 4)]
    got = X.digest(spark.createDataFrame(rows, "doc_id long, text string, g int"), ["doc_id"]).collect()
    assert sorted((x.n_bytes, x.n_removed, x.n_spans) for x in got) == [(0, 0, 0), (198, 0, 0), (300, 300, 1), (300_000, 300, 1)]
