"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are at most EXAMPLES labelled rows, half of each label (those of least hash of the id).  All their
words (ASCII letters lower-cased, split at what is neither letter nor digit in ASCII) form the vocabulary.
A text's vector has (1 + log count) * log(1 + texts / (1 + texts with the word)) * damping, of unit length;
texts with the word are counted over all documents.  The damping, chi / (chi + HALF_CHI) and LEAST_SHARE at
least, chi being the word's chi-square against the label, lets words that go with neither label weigh less;
no word is left out.

The index holds the postings in blocks of BLOCK examples, and for each word and block the greatest weight.
For a text the greatest weights bound every block's similarities; blocks are scored in the order of their
bounds, a few more at each turn, until the bound falls below the K-th similarity found, which leaves exactly
the K nearest (ties: the smaller example).  Their votes are weighted by similarity.  The share of toxic votes becomes a probability
by isotonic regression on each example's vote among the others, weighted by the labels' true shares, with straight
lines between the centres of its blocks, so that scores have no coarse steps.

Every row is scored over its whole text, however long.  Defined results: null and empty texts, and texts
without a word of the vocabulary, get the share of toxic rows among examples without neighbours; without labels of both
kinds the score is the share of toxic labels (0 without any); documents with several label rows have the
label of the majority (ties: 1), and an id with several texts is learnt from by the text of least hash;
repeated rows give a row each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.llm.common import ALNUM, map_texts, remainder, ship, slices, table
from spotloom.llm.fm_quality import majority

EXAMPLES = 3000
#: a word of that chi-square counts half; the least that a word counts
HALF_CHI, LEAST_SHARE = 27.0, 0.05
BLOCK = 64
#: blocks scored at the first turn
FIRST_BLOCKS = 4
K = 15
THRESHOLD = 0.3
EVIDENCE = 5


def counted(data: bytes | None) -> Counter:
    return Counter(data.translate(ALNUM).split()) if data else Counter()


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then from start[1] on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class Index:
    """Examples as (id, label, word counts); texts: how many texts there are, and seen: in how many of them each word stands (None: count the examples)."""

    def __init__(self, examples: list[tuple[int, int, dict[bytes, int]]], texts: int | None = None, seen: dict[bytes, int] | None = None, block: int = BLOCK):
        self.block = block
        n, pos = len(examples), sum(y for _, y, _ in examples)
        met = [Counter(), Counter()]
        for _, y, words in examples:
            met[y].update(words.keys())
        words = sorted(met[0].keys() | met[1].keys())
        self.vocab = {w: i for i, w in enumerate(words)}
        a, b = (np.array([met[y][w] for w in words], np.float64) for y in (1, 0))
        df = a + b
        chi = n * (a * (n - pos) - b * pos) ** 2 / np.maximum(1, pos * (n - pos) * df * (n - df))
        often = df if seen is None else np.array([seen.get(w, 0) for w in words], np.float64)
        idf = np.log1p((n if texts is None else texts) / (1 + often))
        self.weight = idf * np.maximum(LEAST_SHARE, chi / (chi + HALF_CHI))
        # similar examples side by side, so that bounds are tight
        vectors = [self.vector(words) for _, _, words in examples]
        order = sorted(range(n), key=lambda i: (examples[i][1], int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, examples[i][0]))
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.labels = np.array([examples[i][1] for i in order], np.float64)
        self.rank = self.ids.argsort(kind="stable").argsort(kind="stable")
        self.blocks = max(1, -(-n // block))
        term = np.concatenate([vectors[i][0] for i in order] or [np.empty(0, np.int64)])
        place = np.repeat(np.arange(n), [len(vectors[i][0]) for i in order])
        weight = np.concatenate([vectors[i][1] for i in order] or [np.empty(0)])
        by_term = np.lexsort((place, term))
        term, self.place, self.posting = term[by_term], place[by_term].astype(np.int32), weight[by_term]
        # entries: one for each word and block of examples, with the greatest weight in it
        key = term * self.blocks + self.place // block
        self.at = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]]) if len(key) else np.zeros(1, np.int64)
        self.entry_block = (key[self.at[:-1]] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.posting, self.at[:-1]) if len(key) else np.empty(0)
        self.entries = np.searchsorted(key[self.at[:-1]], np.arange(len(words) + 1) * self.blocks)

    def vector(self, words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order, and their weights; of unit length."""
        term = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        count = np.fromiter(words.values(), np.float64, len(words))[term >= 0]
        term = term[term >= 0]
        if not len(term):
            return term, count
        order = np.argsort(term)
        term, weight = term[order], (1 + np.log(count[order])) * self.weight[term[order]]
        return term, weight / math.sqrt(float(weight @ weight))

    def nearest(self, words: dict[bytes, int], k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the k nearest examples that share a word, nearest first."""
        term, weight = self.vector(words)
        at, sim = np.empty(0, np.int64), np.empty(0)
        if not len(term):
            return at, sim
        first = self.entries[term]
        size = self.entries[term + 1] - first
        entry, own = ranges(first, size), np.repeat(weight, size)
        block = self.entry_block[entry]
        bound = np.bincount(block, own * self.most[entry], self.blocks) + 1e-9
        order, done, step = np.argsort(-bound, kind="stable"), 0, FIRST_BLOCKS
        order = order[bound[order] > 1e-9]
        while done < len(order) and (len(sim) < k or bound[order[done]] >= sim[-1]):
            wanted = np.zeros(self.blocks, bool)
            wanted[order[done : done + step]] = True
            done, step = done + step, 2 * step
            here = wanted[block]
            e = entry[here]
            n = self.at[e + 1] - self.at[e]
            posting = ranges(self.at[e], n)
            s = np.bincount(self.place[posting], np.repeat(own[here], n) * self.posting[posting], len(self.ids))
            got = np.flatnonzero(s > (sim[-1] - 1e-12 if len(sim) == k else 0))
            at, sim = np.concatenate([at, got]), np.concatenate([sim, s[got]])
            best = np.lexsort((self.rank[at], -sim))[:k]
            at, sim = at[best], sim[best]
        return at, sim

    def vote(self, at: np.ndarray, sim: np.ndarray) -> float:
        return float(sim @ self.labels[at] / sim.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (weighted mean of x, value) of the weighted non-decreasing fit; between them the fit is read off straight lines."""
    places, at = np.unique(x, return_inverse=True)
    total = np.bincount(at, w)
    out: list[list[float]] = []
    for cur in np.stack([places, np.bincount(at, w * y) / total, total], axis=1).tolist():
        while out and out[-1][1] >= cur[1]:
            p = out.pop()
            whole = p[2] + cur[2]
            cur = [(p[0] * p[2] + cur[0] * cur[2]) / whole, (p[1] * p[2] + cur[1] * cur[2]) / whole, whole]
        out.append(cur)
    return np.array([o[0] for o in out]), np.array([o[1] for o in out])


class Model:
    """shares: how many labelled rows there are of each label, from which the examples were taken."""

    def __init__(self, examples: list[tuple[int, int, dict[bytes, int]]], shares: tuple[int, int], texts: int | None = None, seen: dict[bytes, int] | None = None):
        total = sum(shares)
        self.prior = shares[1] / total if total else 0.0
        self.index = None
        if {y for _, y, _ in examples} != {0, 1}:
            return
        self.index = Index(examples, texts, seen)
        n = Counter(y for _, y, _ in examples)
        each = {y: shares[y] / n[y] for y in n}
        by_id = {int(i): j for j, i in enumerate(self.index.ids)}
        votes, labels, weights, lone = [], [], [], [0.0, 0.0]
        for doc_id, y, words in examples:
            at, sim = self.index.nearest(words, K + 1)
            others = at != by_id[doc_id]
            at, sim = at[others][:K], sim[others][:K]
            if len(at):
                votes.append(self.index.vote(at, sim))
                labels.append(y)
                weights.append(each[y])
            else:
                lone[y] += each[y]
        self.alone = lone[1] / sum(lone) if sum(lone) else self.prior
        self.steps = isotonic(np.array(votes), np.array(labels, float), np.array(weights)) if votes else (np.array([0.0]), np.array([self.prior]))

    def score(self, words: dict[bytes, int]) -> tuple[float, list[int]]:
        """Probability of label 1, and the ids of the nearest examples as evidence."""
        if self.index is None:
            return self.prior, []
        at, sim = self.index.nearest(words)
        if not len(at):
            return self.alone, []
        return float(np.interp(self.index.vote(at, sim), *self.steps)), self.index.ids[at[:EVIDENCE]].tolist()


COUNTS = T.StructType([T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


SEEN = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("n", T.LongType())])


def document_frequencies(docs: DataFrame, words: list[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """How many texts there are, and in how many of them each of the words stands; each task adds up its own texts."""
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches):
        place, n = sent.value, np.zeros(len(sent.value) + 1, np.int64)
        for batch in batches:
            for b in slices(batch, 0):
                met = [set(t.translate(ALNUM).split()) if t else () for t in b.column(0).to_pylist()]
                at = [np.fromiter(map(place.get, own, repeat(-1)), np.int64, len(own)) for own in met]
                n += np.roll(np.bincount(np.concatenate(at) + 1, minlength=len(n)), -1) if at else 0  # -1: other words
        n[-1] = 0
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=SEEN.fieldNames())

    got = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, SEEN).groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    return docs.count(), {words[i]: int(n) for i, n in zip(got["place"], got["n"])}


def train(docs: DataFrame, labels: DataFrame, allowed: Column, column: str = "toxic", most: int = EXAMPLES) -> Model:
    ship(docs.sparkSession)
    known = majority(labels.where(allowed), column)
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for y in (0, 1)]

    def make():
        def fn(texts):
            got = [counted(t) for t in texts]
            return {"words": [list(c) for c in got], "counts": [list(c.values()) for c in got]}

        return fn

    # the examples have a fixed number of rows at most, so they are sent to each task
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))  # an id may have any number of rows
    got = map_texts(one.select("doc_id", "label", "one.text"), ["doc_id", "label"], "text", make, COUNTS).collect()
    examples = sorted(((r.doc_id, r.label, dict(zip(map(bytes, r.words), r.counts))) for r in got), key=lambda x: x[0])
    words = sorted(set().union(*(w for _, _, w in examples)))
    return Model(examples, (n.get(0, 0), n.get(1, 0)), *document_frequencies(docs, words))


SCORES = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])


def scores(docs: DataFrame, keys: list[str], model: Model, text: str = "text") -> DataFrame:
    """keys, score and evidence (ids of the nearest examples) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def fn(texts):
            got = [sent.value.score(counted(t)) for t in texts]
            return {"score": [s for s, _ in got], "evidence": [e for _, e in got]}

        return fn

    return map_texts(docs, keys, text, make, SCORES)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    return scores(docs, ["doc_id"], model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
