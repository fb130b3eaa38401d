import random

import corpus_pipeline as C
from spotloom.llm import similar as S


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def kept(rows):
    """By all pairs: the smallest id of each component."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both / len(sets[i] | sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for (doc_id, text), r in zip(rows, root):
        least[r] = min(least.get(r, (doc_id, text or "")), (doc_id, text or ""))
    return sorted(least.values())


def made(groups, seed=4):
    """Texts with edits so that similarities lie around 0.8, and a passage that unlike texts share."""
    r = random.Random(seed)
    words = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    passage, out = words(40), []
    for size in groups:
        base = words(r.randint(20, 120))
        base[5:5] = passage * r.randint(0, 1)
        for _ in range(size):
            w = list(base)
            for at in r.sample(range(len(w)), min(len(w), r.randint(0, 4))):
                w[at] = f"e{r.randint(0, 10**6)}"
            out.append(" ".join(w))
    r.shuffle(out)
    return list(enumerate(out))


def test_all_pairs_from_four_fifths_on(spark, monkeypatch):
    monkeypatch.setattr(S, "SEEN", 2)
    rows = made([1] * 20 + [2] * 30 + [5] * 8 + [60])
    rows += [(900, None), (901, ""), (902, "Two Words"), (903, "two  words")]
    got = C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == kept(rows)


def test_pairs_that_fingerprints_miss(spark):
    """Similarity 0.8 to the shingle: 100 shingles, of which two edits in the middle and one at the end change eleven."""
    base = [f"w{i}" for i in range(104)]
    near = list(base)
    for at in (30, 60, 103):
        near[at] = f"e{at}"
    far = list(near)
    far[90] = "e90"
    texts = [" ".join(w) for w in (base, near, far)]
    one, two, three = map(shingles, texts)
    assert len(one & two) / len(one | two) >= 0.8 > len(one & three) / len(one | three)
    for pick, want in ((texts[:2], [0]), ([texts[0], texts[2]], [0, 1])):
        docs = spark.createDataFrame(list(enumerate(pick)), "doc_id long, text string")
        assert sorted(r.doc_id for r in C.near_duplicates(spark, docs, "").collect()) == want


def test_rows_of_one_id_with_different_texts(spark):
    """Each row stands for its own text: neither unlike text of id 1 goes, and the copy of its second text does."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in C.near_duplicates(spark, docs, "").collect()) == [(1, a), (1, b)]


def test_parities_let_all_alike_pass(spark):
    rows = made([1] * 10 + [4] * 8)
    sets = [shingles(t) for _, t in rows]
    got = S.items(spark.createDataFrame(rows, "doc_id long, text string"), "text", 5, 0.8).select("doc_id", "__size", "__odd")
    a, b = (got.toDF(*(f"{c}{side}" for c in ("id", "n", "odd"))) for side in "ab")
    near = {(r.ida, r.idb) for r in a.join(b, a.ida < b.idb).where(S._near("odda", "oddb", "na", "nb", 0.8)).select("ida", "idb").collect()}
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)]
    alike = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike and alike <= near and len(near) < len(pairs) / 2


def test_fingerprints_link_first(spark, monkeypatch):
    """The pipeline's copies come by SimHash and its anchors, and only pairs alike by their whole sets are links."""
    from spotloom.llm import simhash
    from spotloom.llm.common import Scratch

    calls, given, links = [], [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, scratch: calls.append(fps.count()) or links(fps, scratch))
    real = S.by_fingerprint
    monkeypatch.setattr(S, "by_fingerprint", lambda *a: given.append(real(*a)) or given[-1])
    r = random.Random(8)
    long = [[f"w{r.randint(0, 10**6)}" for _ in range(600)] for _ in range(6)]
    near = [" ".join(w[:300] + ["edit"] + w[301:]) for w in long]
    texts = [*(" ".join(w) for w in long), *near, "a b c d e f", "a b c d e f a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in C.near_duplicates(spark, docs, "").collect()) == kept(list(enumerate(texts)))
    (pairs, found), = given
    assert calls and 0 < found.count() <= pairs.count()
    name = {x["__item"]: shingles(x.text) for x in S.items(docs, "text", 5, 0.8).collect()}
    for x in found.collect():
        assert len(name[x.a] & name[x.b]) >= 0.8 * len(name[x.a] | name[x.b])
