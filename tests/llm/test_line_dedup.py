import hashlib
import random
from collections import defaultdict

import duckdb

from spotloom.llm import line_dedup as L
from spotloom.llm.common import Scratch

WS = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, documents=10, code_points=1):
    where = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            where[low(x.strip(WS))].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(low(x.strip(WS))) >= code_points and len(where[low(x.strip(WS))]) >= documents)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_equals_brute_force(spark):
    r = random.Random(4)
    pool = ["", " ", "Ä b", "ä B", "x", " X\t", "\x85", "long line " * 9, " y", "İ", "a\rb"] + [f"line {i}" for i in range(8)]
    rows = [(i % 70 if i % 9 else None, "\n".join(r.choice(pool) for _ in range(r.choice([0, 1, 3, 70, 200])))) for i in range(90)] + [(500, None), (501, "")]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, h string, f int")
    for documents, points in ((10, 1), (3, 1), (4, 5)):
        got = L.without_common_lines(df, ["doc_id", "h"], documents=documents, code_points=points)
        key = lambda x: tuple(map(repr, x))
        assert sorted(((x.doc_id, x.n_lines, x.n_dropped, x.kept) for x in got.collect()), key=key) == sorted(brute(rows, documents, points), key=key)


def test_ranges_split_a_line_that_all_have(spark):
    """One range holds no more than its share of a line that stands in every document, and the sort serves the window."""
    df = spark.range(4000).selectExpr("id AS doc_id", "'same' AS text")
    hashed = L.line_hashes(df).repartitionByRange(8, "h", "g", "d")
    sizes = [len(p) for p in hashed.rdd.glom().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500
    assert L.without_common_lines(df, ["doc_id"]).agg({"n_dropped": "sum"}).first()[0] == 4000


def test_bitmaps_hold_the_kept_lines(spark):
    rows = [(i, "\n".join(["a"] * 2 + [f"own {i} {k}" for k in range(100)] + ["b"])) for i in range(10)]
    got = L.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    assert len(got) == 10
    for x in got:
        dropped = [w.place * 64 + b for w in x.words for b in range(64) if not w.keep >> b & 1]
        assert dropped == [0, 1, 102]


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.without_common_lines(df, ["doc_id"]).count() == 0
    same = spark.createDataFrame([(1, "x")] * 30 + [(None, "x")] * 30, "doc_id long, text string")
    assert {x.n_dropped for x in L.without_common_lines(same, ["doc_id"]).collect()} == {0}
    long = spark.createDataFrame([(i, "x\n" * 100_000 + str(i)) for i in range(10)], "doc_id long, text string")
    assert {(x.n_lines, x.n_dropped, x.kept) for x in L.without_common_lines(long, ["doc_id"]).collect()} == {(100_001, 100_000, str(i)) for i in range(10)}


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    rows = con.execute("select doc_id, text from documents").fetchall()
    want = sorted(con.execute(L.SQL["op11_line_dedup"]).fetchall())
    got = sorted(map(tuple, L.op11_line_dedup(spark, sf_dir).collect()))
    assert got == want == sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows))
    assert any(x[2] for x in got)
