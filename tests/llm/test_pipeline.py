"""run() against a plain version of each stage, on the smallest tables and on odd rows."""

import hashlib
import re

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from spotloom.llm import byte_bpe, decontaminate, fm_quality, secret_scan
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_secret_scan import brute as base_spans
from tests.llm.test_similar import kept


def masked(text):
    out, at = [], 0
    for a, kind, b in base_spans(text):
        if a >= at:
            out.append(text[at:a] + f"[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def expected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = fm_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", F.lit(True))
    rows = [r for r in docs.collect() if machine.score(*fm_quality.features(r.text.encode(), r.n_chars)) >= 0.5]
    stay = {i for i, _ in kept([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if r.doc_id in stay]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if not contaminated(r.text, items)[4]]
    with open(P.path(byte_bpe.RANKS), "rb") as f:
        lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(f.read()), special_tokens={})
    return {r.doc_id: np.array(lib.encode_ordinary(masked(r.text)), "<u4").tobytes() for r in rows}


def test_run_equals_plain_stages(spark, sf_dir):
    got = C.run(spark, sf_dir).collect()
    want = expected(spark, sf_dir)
    assert {r.doc_id: bytes(r.ids) for r in got} == want
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.n_tokens * 4 == len(r.ids)


def test_stages_on_odd_rows(spark, sf_dir):
    good = "words that were never seen before by any of the classifiers here and there."
    rows = [(1, None, None, None, None, 1), (1, "", "en", "a", 0, 1), (None, good, "en", "a", 9, 1), (2, good, "en", "a", len(good), 1), (2, good, "en", "a", len(good), 1), (3, good + " token=abcdefgh", "en", None, 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, marks int").withColumn("extra", F.lit(7))
    for name, stage in C.STAGES[:-1]:
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, sf_dir)
            assert set(out.columns) == set(docs.columns), name
            out.collect()
    rest = C.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id or 0 for r in rest) == [0, 1, 2]  # 3 is like 2: 10 of 11 shingles
    assert all(r.marks == 1 and r.extra == 7 for r in rest)
    texts = [r.text for r in C.without_secrets(spark, docs, sf_dir).collect()]
    assert any(t and t.endswith("[ASSIGN]") for t in texts) and texts.count(None) == 1
    assert len(C.encoded(spark, docs, sf_dir).collect()) == len(rows) and C.encoded(spark, docs.limit(0), sf_dir).count() == 0


def test_imports():
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontaminated", "without_secrets", "encoded"]
    assert re.match("[a-z]", secret_scan.BASE_KINDS[0]) and decontaminate.WINDOW == 10
