import random

import numpy as np
import xxhash

from spotloom.llm import simhash as H
from spotloom.llm.common import Scratch
from spotloom.llm.components import components


def classes(ids, fps, bits=4):
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    u = np.array(fps, np.int64).view(np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= bits):
            a, b = find(ids[i]), find(ids[j])
            if a != b:
                par[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_classes_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    got = H.op4_simhash(spark, sf_dir).toPandas().set_index("doc_id")
    want = {i: plain(t) for i, t in zip(docs.doc_id, docs.text)}
    assert {i: int(f, 16) for i, f in got.fingerprint.items()} == want
    assert all(len(f) == 16 for f in got.fingerprint)
    signed = [int(np.uint64(v).astype(np.int64)) for v in want.values()]
    assert got.component_id.to_dict() == classes(list(want), signed)


def test_links_of_crowded_fingerprints(spark):
    """Chains, dense groups, blocks smaller than a group, and no link lost or made up."""
    r = random.Random(3)
    fps = {0}
    for _ in range(4):
        x = r.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
    x = r.getrandbits(64)
    fps |= {x ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    fps = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for block in (H.BLOCK, 16):
        edges = H.links(table, Scratch(spark), block=block)
        comp = {r.node: r.root for r in components(edges, Scratch(spark)).collect()}
        assert {f: comp.get(f, f) for f in fps} == classes(fps, fps)


def test_long_chain_components(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(900, 901), (901, 900), (5, 5)], "a long, b long"))
    comp = {r.node: r.root for r in components(edges, Scratch(spark)).collect()}
    assert comp == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}


def test_odd_tables(spark):
    df = spark.createDataFrame([(3, None, 1), (2, "", 1), (None, "a b", 1), (7, "A  b", 1), (7, "A  b", 1), (8, "x " * 30000, 1)], "doc_id long, text string, fp int")
    rows = sorted((r.doc_id or 0, r.component_id) for r in H.near_duplicates(df).collect())
    assert rows == [(0, 7), (2, 2), (3, 2), (7, 7), (7, 7), (8, 8)]
    assert H.near_duplicates(df.limit(0)).count() == 0
