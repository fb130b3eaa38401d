import random
import re
from fractions import Fraction

import duckdb
import pytest

from spotloom.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_base_measures(spark):
    r = random.Random(2)
    texts = [None, "", " \n\n\t", "a " * 8, "a " * 9, "x\ny\nx\n\nx\r", "🙂 é # |\x1c\x85 b\x0bc"]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(30)]
    block = " ".join(str(i) for i in range(11))
    texts += [block + " - " + block, block + "\n" + block + "\n" + block]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for x in R.measured(df, ["doc_id"]).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(texts[x.doc_id]), texts[x.doc_id]


def test_odd_tables(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None, None, None), (1, None, "en", "a"), (2, good, None, "a"), (2, good, None, "a"), (3, good.replace(" ", "### "), "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sorted((r.doc_id, r.base_failed, r.kept) for r in R.judged(df, ["doc_id"]).collect())
    assert out[:4] == [(1, True, False), (1, True, False), (2, False, True), (2, False, True)]
    assert R.judged(df.limit(0), ["doc_id"]).count() == 0


def cell(values, prior):
    """Quantile buckets of a cell by definition: own rows, and the prior's share of PRIOR rows."""
    weight = {}
    for v in values:
        weight[v] = weight.get(v, Fraction(0)) + 1
    for v, share in prior.items():
        weight[v] = weight.get(v, Fraction(0)) + R.PRIOR * share
    return weight


def ends(weight):
    total, upto, lo, hi = sum(weight.values()), 0, None, None
    for v in sorted(weight):
        upto += weight[v]
        lo = v if lo is None and upto * 1000 >= total * R.TAIL else lo
        hi = v if hi is None and upto * 1000 >= total * (1000 - R.TAIL) else hi
    return lo, hi


def shares(weight):
    total = sum(weight.values())
    return {v: w / total for v, w in weight.items()}


def test_thresholds_of_each_source(spark):
    r = random.Random(3)
    sizes = {("en", "a"): 900, ("en", "b"): 700, ("de", "a"): 30, ("de", "c"): 1}
    rows = [(lang, source, 100 * i, int(r.random() ** 3 * 60 * (1 + 4 * (source == "a"))), 400, 0, 0, 100, 10) for (lang, source), n in sizes.items() for i in range(n)]
    m = spark.createDataFrame(rows, "lang string, source string, doc_id long, n_symbols long, word_chars long, n_dup_lines long, n_repeat_words long, n_words long, n_lines long")
    bucket = lambda n: (lambda v: v >> max(v.bit_length() - 6, 0) << max(v.bit_length() - 6, 0))(1_000_000 * n // 400)
    values = {k: [bucket(x[3]) for x in rows if x[:2] == k] for k in sizes}
    everything = shares(cell([v for k in values for v in values[k]], {}))
    got = {(x.lang, x.source): (x.lo_symbols, x.hi_symbols) for x in R.thresholds(R.sketches(m)).collect()}
    for (lang, source), own in values.items():
        of_lang = shares(cell([v for k in values if k[0] == lang for v in values[k]], everything))
        assert got[lang, source] == ends(cell(own, of_lang)), (lang, source)
    assert len({v[1] for v in got.values()}) > 1


def test_a_very_long_text(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    x = R.judged(spark.createDataFrame([(1, long, "en", "a")], "doc_id long, text string, lang string, source string"), ["doc_id"]).first()
    assert (x.n_words, x.n_repeat_words, x.base_failed, x.kept) == (200_000, 0, False, True)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(R.SQL["op9_quality_rules"]).df()
    got = R.op9_quality_rules(spark, sf_dir).toPandas()
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    got = R.op9_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    clean, junk = got[got.quality == 1], got[got.quality == 0]
    assert clean.kept.mean() > 0.97
    assert junk.kept.mean() < clean.kept.mean()
