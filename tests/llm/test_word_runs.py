import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spotloom.llm import word_runs as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) by definition: stretches by period, of which it has to be the smallest."""
    n, out = len(words), []
    for q in range(1, n // W.TIMES + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(W.LEAST, W.TIMES * q) and not any(all(words[i] == words[i - p] for i in range(s + p, e)) for p in range(1, q)):
                out.append((s, e - s, q))
            s = max(s + 1, e - q + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def made(r, letters, n):
    out = []
    while len(out) < n:
        piece = [r.choice(letters) for _ in range(r.randint(1, 7))]
        out += piece * r.choice([1, 1, 2, 4, 5, 9])
    return out[: r.randint(0, n)]


def test_runs_equal_brute_force_for_many_texts_at_once():
    r = random.Random(3)
    for letters in (b"a", b"ab", b"abc", bytes(range(97, 120))):
        texts = [[bytes([c]) for c in made(r, letters, r.choice([5, 30, 90, 200]))] for _ in range(60)]
        for words, got in zip(texts, W._found(texts)):
            assert got == brute(words), words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=40), min_size=1, max_size=4))
def test_runs_of_any_texts(texts):
    assert W._found(texts) == [brute(w) for w in texts]


def test_many_different_words_fall_back_to_ranks():
    ids = np.concatenate([np.arange(1, 40), np.tile([7, 1 << 29, 9], 5), [0]])
    assert W.runs_of(ids, np.zeros(len(ids), np.int64), np.zeros(1, np.int64)) == [(39, 54, 3)]


def test_a_small_listing_block_gives_the_same(monkeypatch):
    r = random.Random(5)
    texts = [[bytes([c]) for c in made(r, b"ab", 120)] for _ in range(20)]
    want = W._found(texts)
    monkeypatch.setattr(W, "LISTED", 7)
    assert W._found(texts) == want


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen = 0
    for x in W.op13_word_runs(spark, sf_dir).collect():
        if len(docs[x.doc_id] or "") < 8000:
            assert tuple(x)[1:] == digest(x.doc_id, docs[x.doc_id]), x.doc_id
            seen += 1
    assert seen > 0.9 * len(docs)


def test_odd_rows(spark):
    rows = [(1, None, 5), (1, "", 5), (2, " \n\t ", 5), (None, "a a a a a a a b", 5), (3, "x y x y x y x y", 5), (3, "x y x y x y x y", 5), (4, "é\x85ö é\x85ö é\x85ö é\x85ö é\x85ö é\x85ö", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, body int")
    got = [tuple(x) for x in W.word_runs(df, ["doc_id", "body"]).collect()]
    assert [(x[0], x[2], [tuple(r) for r in x[3]], x[4]) for x in got] == [
        (1, 0, [], ""),
        (1, 0, [], ""),
        (2, 0, [], ""),
        (None, 8, [(0, 7, 1)], "a b"),
        (3, 8, [(0, 8, 2)], "x y"),
        (3, 8, [(0, 8, 2)], "x y"),
        (4, 6, [(0, 6, 1)], "é\x85ö"),
    ]
    assert W.word_runs(df.limit(0), ["doc_id"]).count() == 0


def test_a_very_long_text(spark):
    head = [f"w{i}" for i in range(50_000)]
    text = " ".join(head + ["a", "b", "c"] * 20_000 + head[:40_000])
    x = W.word_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert x.n_words == 150_000 and [tuple(r) for r in x.runs] == [(50_000, 60_000, 3)]
    assert x.collapsed.split() == head + ["a", "b", "c"] + head[:40_000]
