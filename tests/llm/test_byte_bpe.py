import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from spotloom.llm import byte_bpe as B


@pytest.fixture(scope="module")
def pair():
    with open(P.path(B.RANKS), "rb") as f:
        ranks = B.read_ranks(f.read())
    return B.Encoder(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = ["a", "aa", " ", "  ", "\n", "é", "’", "'s", "1", "23", "!", "…", "　", "\x1c", "\x85", "中", "🙂", "e", "th", "the", "ing", "---", "====", "\t", "ß", "x", "\x00"]


def test_equals_the_library_on_random_texts(pair):
    enc, lib = pair
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30)))
        ids = enc.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)
        for block in (1, 3, B.DECODE_BLOCK):
            parts = list(B.decode_stream(ids, enc.fst.tokens, block))
            assert b"".join(parts) == text.encode()
            for part in parts:
                part.decode()  # no character is cut


def test_pairs_equal_the_definition(pair):
    fst, r = pair[0].fst, random.Random(6)
    ids = list(fst.tokens)
    for _ in range(5000):
        a, b = r.choice(ids), r.choice(ids)
        assert fst.fits(a, b) == (fst.merged(fst.tokens[a] + fst.tokens[b]) == [a, b])


def test_tables_at_their_bounds(pair, monkeypatch):
    monkeypatch.setattr(B, "MOST_STATES", 20)
    monkeypatch.setattr(B, "MOST_PAIRS", 5)
    enc = B.Encoder(pair[0].fst.ranks)
    enc.chunks.most = enc.pieces.most = 3
    text = "reading the thandble ontion of unhappiness " * 20
    assert enc.encode(text) == pair[0].encode(text)


def test_query_against_the_library(spark, sf_dir, pair):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")
    got = B.op6_byte_bpe(spark, sf_dir).toPandas()
    assert len(got) == len(docs)
    for x in got.itertuples():
        ids = pair[1].encode_ordinary(docs.text[x.doc_id])
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(docs.text[x.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 2), (1, "", 2), (2, " " * 5000 + "a" * 5000, 2)], "doc_id long, text string, n_tokens int")
    rows = B.encode(df, ["doc_id"]).collect()
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0] and len(rows) == 3
    assert B.encode(df.limit(0), ["doc_id"]).count() == 0
