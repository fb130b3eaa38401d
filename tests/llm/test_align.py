import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spotloom.llm import align as A


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(P.path(A.A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path(A.B))


def spelt(libraries, text):
    """Ids and byte ends by both libraries on the whole text; none where they don't spell it."""
    a, b = libraries
    if not text:
        return [], [], [], []
    want = (" " + text).encode()
    byte_of = A._byte_level()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], [], [], []
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    return ids_a, ends(bytes_a), ids_b, ends(bytes_b)


def brute(libraries, rows):
    links, out = {}, []
    for r, (_, text) in enumerate(rows):
        a, ae, b, be = spelt(libraries, text)
        sa, sb = [0, *ae[:-1]], [0, *be[:-1]]
        links[r] = [(x, y) for x, s, e in zip(a, sa, ae) for y, t, f in zip(b, sb, be) if s < f and t < e]
    count = Counter(x for ls in links.values() for x in ls)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    for r, (d, text) in enumerate(rows):
        a, ae, b, be = spelt(libraries, text)
        groups, s = [], 0
        for cut in sorted(set(ae) & set(be)):
            groups.append(",".join(str(i) for i, e in zip(a, ae) if s < e <= cut) + "|" + ",".join(str(i) for i, e in zip(b, be) if s < e <= cut))
            s = cut
        own = links[r]
        out.append((d, len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "", sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own)))
    return out


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b\nc \nd", "\t x", "it's <|endoftext|> <s> </s> <unk> <0x41>", "a▁b c", "▁", "é ö́ ﬁ", "日本語 テキスト  です", "🙂🙃 \U0010ffff", "x y 　 z", "\x00 \x1c \x85 q", "1234567 89,0", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 3, "ſ ß İ", "\r\n \r\n", " ́x"]


def made(n, seed=1):
    r = random.Random(seed)
    parts = [*ODD, "the", "of", "Ünicode", "word", "and", "\n", " ", "  ", "don't", "naïve", "…"]
    return ["".join(r.choice(parts) + r.choice(["", " ", " ", " ", "\n"]) for _ in range(r.randint(1, 12))) for _ in range(n)]


def test_tokens_equal_the_libraries(libraries):
    pair = A.Pair(A._read(A.A, None), A._read(A.B, None))
    assert pair.apart
    texts = ODD + made(400)
    for part in (texts[:50], texts[50:], texts[::3]):
        stretches, (n_a, n_b, places) = pair.encode([t.encode() for t in part])
        for i, t in enumerate(part):
            got = []
            for ids, ends in (stretches[:2], stretches[2:]):
                at, all_ids, all_ends = 0, [], []
                for p in places[i].as_py():
                    all_ids += ids[p].as_py()
                    all_ends += [at + e for e in ends[p].as_py()]
                    at = all_ends[-1]
                got += [all_ids, all_ends]
            assert tuple(got) == spelt(libraries, t) and (n_a[i].as_py(), n_b[i].as_py()) == (len(got[0]), len(got[2])), t


def test_query_columns_equal_brute_force(spark, libraries):
    rows = [(i % 60, t) for i, t in enumerate([None, *ODD, *made(80, 2), *made(20, 2)])]
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, links string, a int")
    want = sorted(brute(libraries, rows))
    for sent in (A.SENT, 0):  # counts sent to the tasks, and joined by shuffle
        got = A.align(df, ["doc_id"], sent=sent, digest=True)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
        assert sorted(map(tuple, got.collect())) == want


def test_query_equals_brute_force(spark, sf_dir, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {x.doc_id: tuple(x) for x in A.op12_align(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, text in docs[:40]:
        if len(text) < 6000:
            a, _, b, _ = spelt(libraries, text)
            assert got[d][1:3] == (len(a), len(b))
    # links of all texts by the number of stretches, and sums over the pairs of the corpus
    count, links = Counter(), {}
    for d, text in docs:
        a, ae, b, be = spelt(libraries, text)
        i = j = 0
        links[d] = []
        while i < len(a):
            links[d].append((a[i], b[j]))
            e, f = ae[i], be[j]
            i, j = i + (e <= f), j + (f <= e)
        count.update(links[d])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    for d, ls in links.items():
        assert (got[d][4], got[d][6], got[d][7]) == (len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls))


def test_empty_table_and_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "word and\nother things " * 40_000)], "doc_id long, text string")
    x = A.align(df, ["doc_id"]).first()
    assert x.n_a > 100_000 and x.n_links == x.n_a + x.n_b - x.n_groups and x.groups.count(";") == x.n_groups - 1
    assert A.align(df.limit(0), ["doc_id"]).count() == 0


def test_long_and_short_stretches_give_the_same(spark, monkeypatch):
    """Stretches are read off short lists or, beyond a length, in one walk over all ends."""
    rows = [(i, t) for i, t in enumerate([*ODD, *made(60, 5), "x" * 50 + "日本語" * 60])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, A.align(df, ["doc_id"]).collect()))
    monkeypatch.setattr(A, "SHORT", 0)
    assert sorted(map(tuple, A.align(df, ["doc_id"]).collect())) == want
