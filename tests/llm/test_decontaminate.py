import hashlib
import random
import re

from spotloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        wins = {tuple(v[i : i + n]) for i in range(max(1, len(v) - 9))} if v else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(item if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest(), bool(hit)


def test_pieces_have_the_windows_of_the_whole():
    w = [b"w%d" % i for i in range(100)]
    for most in (1, 20, 60, 10_000):
        got = D.pieces_of(w, most)
        assert {x for p in got for x in D.windows_of(p)} == set(D.windows_of(w)) and (most > 1000 or len(got) > 3)
    assert D.pieces_of([], 5) == [] and D.pieces_of(w[:3], 1) == [w[:3]]


def test_an_item_without_id(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (1, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "beta gamma"), (7, "gamma")], "item_id long, text string")
    got = D.digest(docs, bench, ["doc_id"]).orderBy("n_words").collect()
    assert [(x.n_hit, x.n_items, x.contaminated) for x in got] == [(0, 0, False), (2, 2, True)]
    assert got[1].items_sha256 == hashlib.sha256(b"7").hexdigest()


def test_a_very_long_text(spark):
    long = "x y z " * 100_000 + "one two three four five six seven eight nine ten"
    docs, bench = spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame([(3, "One two three four five six seven eight nine ten")], "item_id long, text string")
    x = D.digest(docs, bench, ["doc_id"]).first()
    assert (x.n_words, x.n_hit, x.n_items) == (300_010, 10, 1)


def test_against_brute_force_and_blocks(spark):
    r = random.Random(1)
    voc = ["a", "Bé", "c3", "ö", "x"]
    items = [(i, " ".join(r.choice(voc) for _ in range(r.choice([0, 1, 3, 9, 10, 14])))) for i in range(9)] + [(2, None), (None, "x x")]
    texts = [None, "", "  ,,  ", "a " * 4000] + ["-".join(r.choice(voc) for _ in range(r.randint(0, 60))) + "." for _ in range(40)]
    docs = spark.createDataFrame([(i, 7, t) for i, t in enumerate(texts)] + [(1, 7, "")], "doc_id long, marks int, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (D.AUTOMATON_BYTES, 300):
        got = D.mark(docs, bench, most=most).collect()
        assert len(got) == len(texts) + 1 and all(x.marks == 7 for x in got)
    out = D.digest(docs, bench, ["doc_id"]).collect()
    for x in out:
        assert tuple(x)[1:] == brute(texts[x.doc_id], items), x.doc_id
    blocked = {(x.doc_id, tuple(x.marks_["ranges"]), tuple(x.marks_["items"])) for x in D.mark(docs, bench, most=300).collect()}
    assert blocked == {(x.doc_id, tuple(x.marks_["ranges"]), tuple(x.marks_["items"])) for x in D.mark(docs, bench).collect()}


def test_offsets_point_into_the_original():
    data = "Ünd: A--b (C) d".encode()
    spans = D.byte_spans(data, [(1, 4)])
    assert data[spans[0][0] : spans[0][1]] == b"A--b (C"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.digest(docs, none, ["doc_id"]).first().n_hit == 0
    assert D.digest(docs.limit(0), none, ["doc_id"]).count() == 0
