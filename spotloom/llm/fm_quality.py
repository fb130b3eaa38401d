"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its distinct words, hashed into WORD_BUCKETS columns with weights log(1 + count) scaled
to unit length; structure statistics of the whole text, each as one of a few bins; and as metadata the bin
of the stored character count.  Label, language, source and id are never features.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]), so all pairwise
interactions cost time linear in the number of features.

Fitted by AdaGrad on at most TRAIN_ROWS labelled rows (those of least hash of the id), whose feature rows
alone come to the driver; every row is scored.

Defined results: null and empty texts have the bins of an empty text and get a score; a document with
several label rows has the label of the majority (ties: 1); null labels don't count; without any label, or
with labels of one kind only, the score is that share (0.5 without any); repeated rows give a row each, and
where an id that is learnt from has several texts, that of least hash is; texts may be of any length; other
columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.llm.common import LOWER, forget, fresh, remainder, ship, table

WORD_BUCKETS = 1 << 15
FACTORS = 8
TRAIN_ROWS = 4000
EPOCHS = 6
BATCH = 32
RATE = 0.08
DECAY = 1e-4
THRESHOLD = 0.5
SEED = 20

#: upper edges of the bins of each statistic
SHARES = (0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95)
EDGES = {
    "upper": SHARES,
    "digit": SHARES,
    "symbol": SHARES,
    "bang": SHARES,
    "pipe": SHARES,
    "stop": SHARES,
    "beyond_ascii": SHARES,
    "words_alike": SHARES,
    "next_alike": SHARES,
    "triples_alike": SHARES,
    "lines_alike": SHARES,
    "most_common": SHARES,
    "short_words": SHARES,
    "word_length": (1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 20, 40),
    "line_words": (1, 2, 4, 8, 12, 16, 24, 40, 80, 200),
    "words": tuple(2**i for i in range(0, 18)),
    "stored_chars": tuple(4**i for i in range(0, 14)),
}
_START, _n = {}, WORD_BUCKETS
for _name, _edges in EDGES.items():
    _START[_name] = _n
    _n += len(_edges) + 2
SIZE = _n

_UPPER, _DIGIT, _SYMBOL = bytes(range(65, 91)), b"0123456789", b"#*$%&<>@\\^_~=+{}[]"
_STOP = b".,;:?"
_ASCII = bytes(range(128))


def _bin(name: str, value: float) -> int:
    edges = EDGES[name]
    for i, e in enumerate(edges):
        if value <= e:
            return _START[name] + i
    return _START[name] + len(edges)


def statistics(data: bytes, words: list[bytes], counts: Counter) -> dict[str, float]:
    n, m, dropped = max(1, len(words)), max(1, len(data)), data.translate
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    triples = max(1, len(words) - 2)
    return {
        "upper": 1 - len(dropped(None, _UPPER)) / m if data else 0.0,
        "digit": 1 - len(dropped(None, _DIGIT)) / m if data else 0.0,
        "symbol": 1 - len(dropped(None, _SYMBOL)) / m if data else 0.0,
        "bang": data.count(b"!") / m,
        "pipe": data.count(b"|") / m,
        "stop": 1 - len(dropped(None, _STOP)) / m if data else 0.0,
        "beyond_ascii": len(dropped(None, _ASCII)) / m,
        "words_alike": 1 - len(counts) / n if words else 0.0,
        "next_alike": sum(map(operator.eq, words, words[1:])) / n,
        "triples_alike": 1 - len(set(zip(words, words[1:], words[2:]))) / triples if len(words) > 2 else 0.0,
        "lines_alike": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "most_common": max(counts.values(), default=0) / n,
        "short_words": sum(map((3).__gt__, map(len, words))) / n,
        "word_length": sum(map(len, words)) / n,
        "line_words": n / max(1, len(lines)),
        "words": len(words),
    }


def features(data: bytes | None, chars: float | None, buckets: int = WORD_BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns, and their weights."""
    words = data.split() if data else []
    counts = Counter(words)
    bins = [_bin(k, v) for k, v in statistics(data or b"", words, counts).items()]
    bins.append(_START["stored_chars"] + len(EDGES["stored_chars"]) + 1 if chars is None or chars != chars else _bin("stored_chars", chars))
    col = np.fromiter(map(crc32, map(bytes.translate, counts, [LOWER] * len(counts))), np.int64, len(counts)) & (buckets - 1)
    weight = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(col):
        sums = np.bincount(col, weight, minlength=1)
        col = np.flatnonzero(sums)
        weight = sums[col]
        weight /= math.sqrt(float(weight @ weight))
    return np.concatenate([np.array(bins, np.int64), col]), np.concatenate([np.ones(len(bins)), weight]).astype(np.float32)


class Machine:
    def __init__(self, size: int = SIZE, factors: int = FACTORS, seed: int = SEED):
        self.bias = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (size, factors)).astype(np.float32)

    def raw(self, col: np.ndarray, val: np.ndarray) -> float:
        xv = self.v[col] * val[:, None]
        s = xv.sum(0)
        return float(self.bias + self.w[col] @ val + 0.5 * (s @ s - np.einsum("ij,ij->", xv, xv)))

    def score(self, col: np.ndarray, val: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.raw(col, val)))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> "Machine":
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
        self.bias = math.log(share / (1 - share))
        if not len(labels) or labels.min() == labels.max():
            self.v[:] = 0
            return self
        rng, gw, gv, gb = np.random.default_rng(seed), np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                part = [rows[j] for j in order[i : i + batch]]
                size = np.array([len(c) for c, _ in part])
                col, val = np.concatenate([c for c, _ in part]), np.concatenate([x for _, x in part])
                start, row = np.concatenate([[0], np.cumsum(size)[:-1]]), np.repeat(np.arange(len(part)), size)
                v = self.v[col]
                xv = v * val[:, None]
                s = np.add.reduceat(xv, start)
                raw = self.bias + np.add.reduceat(self.w[col] * val, start) + 0.5 * ((s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), start))
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[order[i : i + batch]]) / len(part)
                used, at = np.unique(col, return_inverse=True)
                pull = (err[row] * val).astype(np.float32)
                dw = np.bincount(at, pull, len(used)).astype(np.float32) + decay * self.w[used]
                each = pull[:, None] * (s[row] - xv)
                dv = np.stack([np.bincount(at, each[:, f], len(used)) for f in range(v.shape[1])], 1).astype(np.float32) + decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                db = float(err.sum())
                gb += db * db
                self.bias -= rate * db / math.sqrt(gb)
        return self


def majority(labels: DataFrame, column: str) -> DataFrame:
    """One row for each labelled document: (doc_id, label 0 or 1)."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("label"))


def sample_of(labels: DataFrame, column: str, allowed: Column, rows: int) -> DataFrame:
    """At most `rows` labelled documents that may be learnt from, by hash of the id."""
    return majority(labels.where(allowed), column).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _chars(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


FEATURES = T.StructType([T.StructField("col", T.ArrayType(T.IntegerType())), T.StructField("val", T.ArrayType(T.FloatType()))])


def train(docs: DataFrame, labels: DataFrame, column: str, allowed: Column, rows: int = TRAIN_ROWS) -> Machine:
    ship(docs.sparkSession)

    @F.pandas_udf(FEATURES)
    def featured(text: pd.Series, chars: pd.Series) -> pd.DataFrame:
        got = [features(t, c) for t, c in zip(text, chars)]
        return pd.DataFrame({"col": [c.astype(np.int32) for c, _ in got], "val": [v for _, v in got]})

    # the sample has a fixed number of rows at most, so it is sent to each task
    picked = docs.select("doc_id", F.col("text").cast("binary").alias("text"), _chars(docs).alias("chars")).join(F.broadcast(sample_of(labels, column, allowed, rows)), "doc_id")
    one = F.min(F.struct(F.xxhash64("text", "chars").alias("h"), "text", "chars")).alias("one")  # an id may have any number of rows
    picked = picked.groupBy("doc_id", "label").agg(one).select("doc_id", "label", "one.text", "one.chars")
    got = picked.select("doc_id", "label", featured("text", "chars").alias("x")).toPandas().sort_values("doc_id")
    data = [(np.asarray(x["col"], np.int64), np.asarray(x["val"], np.float32)) for x in got.x]
    return Machine().fit(data, got.label.to_numpy(np.float64))


def scorer(spark: SparkSession, machine: Machine):
    """A function of (text as binary, stored characters or null) that gives the score."""
    ship(spark)
    sent = spark.sparkContext.broadcast(machine)

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series, chars: pd.Series) -> pd.Series:
        forget()
        m = sent.value
        return pd.Series([m.score(*features(t, c)) for t, c in zip(text, chars)], dtype="float64")

    return score


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with a last column `score`, or fresh(docs, "score") where there is one."""
    return docs.withColumn(fresh(docs, "score"), scorer(docs.sparkSession, machine)(F.col("text").cast("binary"), _chars(docs)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = train(docs, table(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), 3) != 1)
    return scores(docs, machine).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
