"""LM scoring by a gated recurrent language model.

Counts of all tokens of all documents are gathered by one aggregation.  The WORDS most frequent training
tokens are the model's vocabulary; the rest share one symbol, and what stands behind it is told by
P(w | other) = (1 - e) * count(w) / count(other) + e * spelling(w), with e the share of tokens seen once
(Good-Turing) and spelling an interpolated byte model of the distinct training tokens.  So every text has a
probability, and all these statistics cover the whole corpus.

The recurrent part is one GRU layer with a class-factored softmax: P(w | h) = P(class | h) P(w | class, h),
classes being runs of frequency ranks.  It is fitted by truncated backpropagation in numpy on every token of
every training document: each task reads its own documents in LANES lanes side by side, steps by Adam from
the common start, and the tasks' parameters are averaged, weighted by their tokens (ROUNDS: a first part of
the documents, then the rest from the average).  Where there are fewer than TRAIN_TOKENS training tokens, each
document is read several times.  In training, documents are cut into pieces of PIECE tokens, so that lanes
are equally long; the first symbol before a piece is the one that stands there.

Scoring runs many documents in step and carries each one's state from window to window, to the end of the
document.

Tokens that make up 1/FREQUENT of all tokens or more, FREQUENT at most, are sent to the tasks; the others
are looked up by a join in which no key can be hot for that very reason.

Defined results: null is the empty text (one end token); texts may be of any length; repeated rows give a
row each; without training tokens the probabilities come from the spelling model and an even GRU; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.llm.common import LOWER, Scratch, remainder, ship, slices, table

WORDS = 1022
CLASS = 32
HIDDEN = 24
FREQUENT = 1_000_000
#: the least number of tokens to step through, by reading documents MOST_PASSES times at most
TRAIN_TOKENS = 600_000
MOST_PASSES = 6
#: sixteenths of the documents that each round of averaging begins and ends with
ROUNDS = ((0, 2), (2, 16))
PIECE = 1024
#: lanes of a task: one for so many training tokens, between the two bounds
TOKENS_A_LANE, LANES = 10_000, (32, 512)
TRAIN_WINDOW = 16
#: numbers of the parameter vector in a row that is averaged
CHUNK = 8192
WINDOW = 64
STEP = 512
#: bytes of text scored at a time
SCORED = 8 << 20
RATE = 0.01
BOUND = 72 / HIDDEN
SEED = 11
OTHER, END = 0, 1  # symbols before the words; the start of a text is the state's zero input


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(LOWER).split() if data else []


class Gru:
    """Symbols 0 .. size - 1; `emb` has a further row for the start of a text.

    z, r = sigmoid(x + h u), c = tanh(x + r * (h u)), h <- h + z (c - h); x is the symbol's row of `emb`,
    which holds all three parts.  Parameters are views of one vector, so that models are averaged as vectors.
    """

    def __init__(self, size: int, hidden: int = HIDDEN, width: int = CLASS, seed: int = SEED, dtype=np.float32):
        r, h = np.random.default_rng(seed), hidden
        self.size, self.hidden, self.width = size, h, width
        self.classes = -(-size // width)
        shapes = {"emb": (size + 1, 3 * h), "u": (h, 3 * h), "cw": (h, self.classes), "cb": (self.classes,), "ww": (self.classes, width, h), "wb": (self.classes, width)}
        spread = {"emb": 0.1, "u": 1 / math.sqrt(h), "cw": 1 / math.sqrt(h), "ww": 1 / math.sqrt(h)}
        self.vector, self.p, at = np.zeros(sum(map(math.prod, shapes.values())), dtype), {}, 0
        for k, s in shapes.items():
            self.p[k] = self.vector[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)
            if k in spread:
                self.p[k][:] = r.normal(0, spread[k], s)
        self._close()

    def _close(self) -> None:
        """No probability for places of the last class beyond the symbols."""
        self.p["wb"].reshape(-1)[self.size :] = -60.0

    def start_from(self, counts: np.ndarray) -> None:
        """Output biases from the symbols' frequencies."""
        n = np.full(self.classes * self.width, 1e-30)
        n[: self.size] = counts[: self.size] + 0.5
        by = n.reshape(self.classes, self.width)
        self.p["cb"][:] = np.log(by.sum(1) / by.sum())
        self.p["wb"][:] = np.log(by / by.sum(1, keepdims=True))
        self._close()

    def step(self, x: np.ndarray, h: np.ndarray):
        """One step: x are symbols, h is (hidden, lanes).  Returns update gate, reset gate, candidate, the candidate's recurrent part, and the new state."""
        n, a, g = self.hidden, np.take(self.p["emb"], x, 0).T, self.p["u"].T @ h
        zr = a[: 2 * n] + g[: 2 * n]
        np.negative(zr, zr)
        np.exp(zr, zr)
        zr += 1
        np.reciprocal(zr, zr)
        z, r, q = zr[:n], zr[n:], g[2 * n :]
        c = r * q
        c += a[2 * n :]
        np.tanh(c, c)
        new = c - h
        new *= z
        new += h
        return z, r, c, q, new

    def _classes(self, y: np.ndarray):
        """Rows sorted by symbol, the symbols in that order, their classes, and (class, from, to) of each run."""
        order = np.argsort(y.astype(np.int16 if self.size < 1 << 15 else np.int64), kind="stable")
        ys = y[order]
        ks = ys // self.width
        cuts = [0, *(np.flatnonzero(np.diff(ks)) + 1).tolist(), len(ks)]
        return order, ys, ks, [(int(ks[a]), a, b) for a, b in zip(cuts, cuts[1:]) if a < b]

    def log_probs(self, hs: np.ndarray, y: np.ndarray, backward: dict | None = None):
        """Natural log probability of symbol y after each state (a column of hs); with `backward`, gradients of the mean loss go there and that of the states is returned too."""
        p, one = self.p, np.ones(max(len(y), self.classes, self.width), hs.dtype)
        order, ys, ks, parts = self._classes(y)
        h, at = np.take(hs.T, order, 0), np.arange(len(y))
        e = h @ p["cw"]
        e += p["cb"]
        out = e[at, ks].astype(np.float64)
        np.exp(e, e)
        total = e @ one[: self.classes]
        out -= np.log(total)
        if backward is not None:
            e *= (1 / (len(y) * total))[:, None]
            e[at, ks] -= one[0] / len(y)
            backward["cw"] += h.T @ e
            backward["cb"] += one[: len(y)] @ e
            dh = e @ p["cw"].T
        for c, a, b in parts:
            part, pick, own = h[a:b], ys[a:b] - c * self.width, at[: b - a]
            e = part @ p["ww"][c].T
            e += p["wb"][c]
            out[a:b] += e[own, pick]
            np.exp(e, e)
            total = e @ one[: self.width]
            out[a:b] -= np.log(total)
            if backward is not None:
                e *= (1 / (len(y) * total))[:, None]
                e[own, pick] -= one[0] / len(y)
                backward["ww"][c] += e.T @ part
                backward["wb"][c] += one[: b - a] @ e
                dh[a:b] += e @ p["ww"][c]
        back = np.empty_like(out)
        back[order] = out
        if backward is None:
            return back
        d = np.empty_like(dh)
        d[order] = dh
        return back, d

    def gradients(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, live: list[int], h0: np.ndarray, grad: np.ndarray):
        """Mean loss over a window and the state after it; the gradient goes to `grad`.

        x, y, first: (time, lanes).  At step t the first live[t] lanes have a symbol (never more than at t - 1);
        where `first` holds, the state starts from zero.
        """
        grad[:] = 0
        g, n, steps, at = {}, self.hidden, len(x), 0
        for k, v in self.p.items():
            g[k] = grad[at : at + v.size].reshape(v.shape)
            at += v.size
        h, kept = h0, []
        for t in range(steps):
            h = h[:, : live[t]]
            if first[t, : live[t]].any():
                h = h * ~first[t, : live[t]]
            kept.append((h, *self.step(x[t, : live[t]], h)))
            h = kept[-1][-1]
        hs = np.concatenate([k[-1] for k in kept], 1)
        logs, out = self.log_probs(hs, np.concatenate([y[t, : live[t]] for t in range(steps)]), g)
        out = np.ascontiguousarray(out.T)
        ends = np.cumsum([0, *live[:steps]])
        da, dg = np.empty((3 * n, hs.shape[1]), hs.dtype), np.empty((3 * n, hs.shape[1]), hs.dtype)
        dh = np.zeros((n, live[steps - 1]), hs.dtype)
        for t in range(steps - 1, -1, -1):
            prev, z, r, c, q, _ = kept[t]
            cut = slice(ends[t], ends[t + 1])
            total = out[:, cut].copy()
            total[:, : dh.shape[1]] += dh
            tz = total * z
            dc = 1 - c * c
            dc *= tz
            dz = c - prev
            dz *= tz
            dz *= 1 - z
            dr = dc * r
            dg[2 * n :, cut] = dr
            dr *= q
            dr *= 1 - r
            da[:n, cut], da[n : 2 * n, cut], da[2 * n :, cut] = dz, dr, dc
            dg[: 2 * n, cut] = da[: 2 * n, cut]
            total -= tz
            dh = self.p["u"] @ dg[:, cut]
            dh += total
            if first[t, : live[t]].any():
                dh *= ~first[t, : live[t]]
        g["u"][:] = np.concatenate([k[0] for k in kept], 1) @ dg.T
        xs = np.concatenate([x[t, : live[t]] for t in range(steps)])
        for j in range(3 * n):
            g["emb"][:, j] = np.bincount(xs, da[j], self.size + 1)
        g["wb"].reshape(-1)[self.size :] = 0
        return -float(logs.mean()), h

    def score(self, texts: list[np.ndarray], lanes: int = STEP, window: int = WINDOW) -> np.ndarray:
        """Natural log probability of each text's symbols; every text has one at least."""
        out = np.zeros(len(texts))
        if not texts:
            return out
        x, y, first, text, live = in_lanes(texts, lanes, self.size)
        h = np.zeros((self.hidden, x.shape[1]), self.vector.dtype)
        for a in range(0, len(x), window):
            hs, cuts = [], live[a : a + window]
            for t, n in enumerate(cuts, a):
                h = h[:, :n]
                if first[t, :n].any():
                    h = h * ~first[t, :n]
                h = self.step(x[t, :n], h)[-1]
                hs.append(h)
            flat = lambda v: np.concatenate([v[t, :n] for t, n in enumerate(cuts, a)])
            out += np.bincount(flat(text), self.log_probs(np.concatenate(hs, 1), flat(y)), len(texts))
        return out


class Adam:
    def __init__(self, gru: Gru, rate: float = RATE):
        self.gru, self.rate, self.count = gru, rate, 0
        self.m1, self.m2, self.grad = (np.zeros_like(gru.vector) for _ in range(3))

    def read(self, texts: list[np.ndarray], lanes: int, window: int = TRAIN_WINDOW, piece: int = PIECE) -> int:
        """One pass over the texts, a step for each window; returns the number of symbols."""
        gru, grad = self.gru, self.grad
        pieces = [s[i : i + piece] for s in texts for i in range(0, len(s), piece)]
        before = np.array([gru.size if i == 0 else s[i - 1] for s in texts for i in range(0, len(s), piece)], np.int32)
        if not pieces:
            return 0
        x, y, first, text, live = in_lanes(pieces, lanes, gru.size)
        x[first] = before[text[first]]
        h = np.zeros((gru.hidden, x.shape[1]), gru.vector.dtype)
        for a in range(0, len(x), window):
            cut, n = slice(a, a + window), live[a]
            _, h = gru.gradients(x[cut, :n], y[cut, :n], first[cut, :n], live[cut], h[:, :n], grad)
            self.count += 1
            grad *= min(1.0, 1.0 / (math.sqrt(float(grad @ grad)) + 1e-9))
            self.m1 += 0.1 * (grad - self.m1)
            grad *= grad
            self.m2 += 0.005 * (grad - self.m2)
            pace = self.rate / math.sqrt(1 + self.count / 100)
            root = np.sqrt(self.m2)
            root *= 1 / math.sqrt(1 - 0.995**self.count)
            root += 1e-6
            np.divide(self.m1, root, root)
            root *= pace / (1 - 0.9**self.count)
            gru.vector -= root
            for k in ("cw", "ww"):  # so that no logit overflows: states lie between -1 and 1
                np.clip(gru.p[k], -BOUND, BOUND, gru.p[k])
        return sum(map(len, pieces))


def in_lanes(texts: list[np.ndarray], lanes: int, start: int):
    """Texts one after another in at most that many lanes, the longest lane first.

    (x, y, first, text, live): symbols before and at each place, whether a text starts there, which one it
    is, and how many lanes go on at each step.
    """
    load = [(0, i) for i in range(min(lanes, len(texts)))]
    where: list[list[int]] = [[] for _ in load]
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        n, lane = load[0]
        where[lane].append(i)
        heapq.heapreplace(load, (n + len(texts[i]), lane))
    size = dict((lane, n) for n, lane in load)
    where = [where[lane] for lane in sorted(size, key=lambda lane: (-size[lane], lane))]
    long = np.array(sorted(size.values(), reverse=True), np.int64)
    steps = int(long.max(initial=0))
    y, text = np.zeros((len(where), steps), np.int32), np.zeros((len(where), steps), np.int32)
    first = np.zeros((len(where), steps), bool)
    for j, own in enumerate(where):
        n = int(long[j])
        y[j, :n] = np.concatenate([texts[i] for i in own])
        sizes = [len(texts[i]) for i in own]
        text[j, :n] = np.repeat(own, sizes)
        first[j, np.cumsum([0, *sizes[:-1]])] = True
    x = np.empty_like(y)
    x[:, 1:] = y[:, :-1]
    x[first] = start
    live = np.searchsorted(-long, -np.arange(steps), "left").tolist()
    return *(np.ascontiguousarray(v.T) for v in (x, y, first, text)), live


#: buckets of the contexts of one, two and three bytes; 256 stands for the borders of a token
CONTEXTS = (257, 1 << 12, 1 << 14)


def _contexts(b: np.ndarray) -> list[np.ndarray]:
    """For each place from the second on of tokens between border bytes, the bucket of each context; contexts end at a border."""
    border = b[:-1] == 256
    one = b[:-1]
    two = np.where(border, 256, np.concatenate([[256], b[:-2]]))
    three = np.where(border | np.concatenate([[True], border[:-1]]), 256, np.concatenate([[256, 256], b[:-3]])[: len(one)])
    return [one, (one * 61 + two * 17) % CONTEXTS[1], (one * 1021 + two * 61 + three * 7) % CONTEXTS[2]]


def _bordered(words: list[bytes]) -> np.ndarray:
    """The words' bytes with a border before, between and after; no token holds a zero byte's place but a zero byte itself."""
    b = np.frombuffer(b"\x00".join([b"", *words, b""]), np.uint8).astype(np.int64)
    b[np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype(np.int64)] = 256
    return b


class Spelling:
    """Bytes of a token after up to three bytes before them, by Witten-Bell interpolation; natural logs."""

    def __init__(self, counts: list[np.ndarray]):
        self.tables = [(n.astype(np.float32), n.sum(1).astype(np.float32), np.maximum((n > 0).sum(1), 1).astype(np.float32)) for n in counts]
        self.even = 1 / 257

    def all(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0)
        b = _bordered(words)
        p = np.full(len(b) - 1, self.even)
        for (n, total, kinds), c in zip(self.tables, _contexts(b)):
            p = (n[c, b[1:]] + kinds[c] * p) / (total[c] + kinds[c])
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.diff(np.concatenate([[0.0], np.cumsum(np.log(p))[ends - 1]]))

    def __call__(self, word: bytes) -> float:
        return float(self.all([word])[0])


class Statistics:
    """What is known of all tokens: n training tokens, v distinct, `other` tokens outside the vocabulary, `once` of them seen once."""

    def __init__(self, n: int, v: int, other: int, once: int, spelling: Spelling):
        self.n, self.v, self.other = n, v, other
        self.unseen = min(0.5, max(1e-3, once / other)) if other else 1.0
        self.spelling = spelling
        self.base = math.log10(n + v + 1)

    def behind_other(self, words: list[bytes], counts) -> np.ndarray:
        """log10 P(w | other) of each word, given its count."""
        told = math.log(self.unseen) + np.concatenate([self.spelling.all(words[i : i + 50_000]) for i in range(0, len(words), 50_000)] or [np.empty(0)])
        c = np.asarray(counts, float)
        if self.other and len(words):
            with np.errstate(divide="ignore"):
                told = np.logaddexp(told, np.log((1 - self.unseen) * c / self.other))
        return told / math.log(10)


COUNTS = T.StructType([T.StructField("token", T.StringType()), T.StructField("c", T.LongType()), T.StructField("total", T.LongType())])
#: distinct tokens that a task holds before it passes their counts on
HELD = 150_000


def _counted(batches):
    """Partial counts: each task adds up its own texts before anything is shuffled."""
    seen = (Counter(), Counter())

    def flush():
        c, rest = seen
        tokens = list(c.keys() | rest.keys())
        own = [c[w] for w in tokens]
        total = [n + rest[w] for n, w in zip(own, tokens)]
        c.clear()
        rest.clear()
        text = pa.array([w.decode("utf-8", "replace") for w in tokens], type=pa.string())
        return pa.RecordBatch.from_arrays([text, pa.array(own, type=pa.int64()), pa.array(total, type=pa.int64())], names=COUNTS.fieldNames())

    for b in batches:
        for train, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = seen[0 if train else 1]
            own.update(words_of(data))
            own[b""] += 1
            if len(own) > HELD:
                yield flush()
    if seen[0] or seen[1]:
        yield flush()


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, c, total): occurrences in training rows and in all; the end of a text is the empty token."""
    part = docs.select("train", F.col(text).cast("binary").alias("text")).mapInArrow(_counted, COUNTS)
    return part.groupBy("token").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


SPELLED = T.StructType([T.StructField("order", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.LongType())])


def _spelled(batches):
    """Counts of (context bucket, byte) for each length of context."""
    counts = [np.zeros(c * 257, np.int64) for c in CONTEXTS]
    for batch in batches:
        for i in range(0, batch.num_rows, 20_000):
            b = _bordered(batch.column(0).slice(i, 20_000).to_pylist())
            for n, c, size in zip(counts, _contexts(b), CONTEXTS):
                n += np.bincount(c * 257 + b[1:], minlength=size * 257)
    for order, n in enumerate(counts):
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), order, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["order", "at", "n"])


class Model:
    """What each task needs: the GRU, and of each frequent token its symbol, log10(count + 1), whether it is known, and log10 P(w | other) where the symbol is OTHER."""

    def __init__(self, gru: Gru, stats: Statistics, frequent: dict[bytes, tuple[int, int, float]]):
        """frequent: token -> (count, symbol, log10 P(w | other)); the empty token is the end."""
        self.gru, self.stats = gru, stats
        frequent = {b"": (0, END, 0.0)} | frequent
        self.index = {w: i for i, w in enumerate(frequent)}
        none = [(0, OTHER, 0.0)]  # what place -1 gives
        count, symbol, behind = zip(*frequent.values(), *none)
        self.log, self.known = np.log10(np.array(count, np.float64) + 1), np.array(count) > 0
        self.symbol, self.behind = np.array(symbol, np.int32), np.array(behind)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Of each word and the end; -1 for tokens that are not frequent."""
        return np.fromiter(map(self.index.get, [*words, b""], repeat(-1)), np.int32, len(words) + 1)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        return self.symbol[self.places(words)]


PARAMETERS = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("numbers", T.BinaryType())])


def _in_chunks(vector: np.ndarray, weight: float) -> pa.RecordBatch:
    """The vector times the weight, cut into rows."""
    parts = [(vector[i : i + CHUNK].astype(np.float64) * weight).astype("<f4").tobytes() for i in range(0, len(vector), CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), type=pa.int32()), pa.array([float(weight)] * len(parts)), pa.array(parts, type=pa.binary())], names=PARAMETERS.fieldNames())


def _summed(batches):
    """One row for each chunk; a task holds no more numbers than the model has."""
    weight: dict[int, float] = {}
    numbers: dict[int, np.ndarray] = {}
    for b in batches:
        for c, w, x in zip(*(col.to_pylist() for col in b.columns)):
            weight[c] = weight.get(c, 0.0) + w
            numbers[c] = numbers.get(c, 0.0) + np.frombuffer(x, "<f4").astype(np.float64)
    if weight:
        kept = [(numbers[c] / max(weight[c], 1e-30)).astype("<f4").tobytes() for c in weight]
        yield pa.RecordBatch.from_arrays([pa.array(list(weight), type=pa.int32()), pa.array(list(weight.values())), pa.array(kept, type=pa.binary())], names=PARAMETERS.fieldNames())


def fitted(docs: DataFrame, gru: Gru, symbols: dict[bytes, int], n: int) -> Gru:
    """The GRU after all rounds over docs (train, doc_id, text) with n training tokens."""
    spark = docs.sparkSession
    lanes = int(np.clip(n // TOKENS_A_LANE, *LANES))
    passes = int(np.clip(-(-TRAIN_TOKENS // max(1, n)), 1, MOST_PASSES))
    sixteenth = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    for begin, end in ROUNDS:
        sent = spark.sparkContext.broadcast((gru, symbols))

        def run(batches, sent=sent):
            start, symbol = sent.value
            own = Gru(start.size, start.hidden, start.width)
            own.vector[:] = start.vector
            adam, read = Adam(own), 0
            for b in (part for batch in batches for part in slices(batch, 0)):
                words = [words_of(t) for t in b.column(0).to_pylist()]
                texts = [np.fromiter([*map(symbol.get, w, repeat(OTHER)), END], np.int32, len(w) + 1) for w in words]
                for _ in range(passes):
                    read += adam.read(texts, lanes)
            if read:
                yield _in_chunks(own.vector, read)

        part = docs.where("train").where((sixteenth >= begin) & (sixteenth < end)).select(F.col("text").cast("binary").alias("text"))
        sums = part.mapInArrow(run, PARAMETERS).repartition(8, "chunk").mapInArrow(_summed, PARAMETERS)
        got = sums.collect()  # as many numbers as the model has
        for r in got:
            gru.vector[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.numbers, "<f4")
        sent.unpersist()
    return gru


def build(spark: SparkSession, docs: DataFrame, counts: DataFrame, most: int = FREQUENT, n_words: int = WORDS) -> Model:
    n, v, everything = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("total")).first()
    n, everything = n or 0, everything or 0
    # at most `most` tokens can be that frequent
    top = counts.where((F.col("total") >= everything / most) | (F.col("token") == "")).select(F.col("token").cast("binary").alias("token"), "c").toPandas()
    ranked = sorted(((bytes(w), int(c)) for w, c in zip(top["token"], top["c"])), key=lambda x: (-x[1], x[0]))
    vocabulary = [(w, c) for w, c in ranked if w and c][:n_words]
    tables = [np.zeros(c * 257, np.int64) for c in CONTEXTS]
    spelled = counts.where("c > 0 and token <> ''").select(F.col("token").cast("binary")).mapInArrow(_spelled, SPELLED).groupBy("order", "at").agg(F.sum("n").alias("n")).toPandas()
    for order, filled in enumerate(tables):  # as many numbers as the tables have places at most
        part = spelled[spelled["order"] == order]
        filled[part["at"].to_numpy()] = part["n"].to_numpy()
    symbol = {w: i + 2 for i, (w, _) in enumerate(vocabulary)}
    inside = sum(c for w, c in ranked if w in symbol or not w)
    once = counts.where("c = 1 and token <> ''").count()
    stats = Statistics(n, v, n - inside, once, Spelling([x.reshape(-1, 257) for x in tables]))
    beyond = [(w, c) for w, c in ranked if w and w not in symbol]
    behind = dict(zip((w for w, _ in beyond), stats.behind_other([w for w, _ in beyond], [c for _, c in beyond]).tolist()))
    frequent = {w: (c, END if not w else symbol.get(w, OTHER), behind.get(w, 0.0)) for w, c in ranked}
    gru = Gru(len(vocabulary) + 2)
    ends = dict(ranked).get(b"", 0)
    gru.start_from(np.array([n - inside, ends, *(c for _, c in vocabulary)], np.float64))
    return Model(fitted(docs, gru, symbol, n), stats, frequent)


RARE = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("k", T.IntegerType())]))
PARTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rare", RARE)])


def parts(docs: DataFrame, keys: list[str], model: Model, text: str = "text") -> DataFrame:
    """keys, what the tokens known to every task give, the GRU's log10 probability, and the tokens to look up."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keys, F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([src.schema[k] for k in keys] + PARTS.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        m, arrow, k = sent.value, to_arrow_schema(schema), len(keys)
        for b in (part for batch in batches for part in slices(batch, k, SCORED)):
            own = [words_of(data) for data in b.column(k).to_pylist()]
            n_tokens = np.array([len(w) + 1 for w in own])
            places = [m.places(w) for w in own]
            flat, start = np.concatenate(places), np.concatenate([[0], np.cumsum(n_tokens)[:-1]])
            known = np.add.reduceat(m.known[flat].astype(np.int64), start)
            base, behind = np.add.reduceat(m.log[flat], start), np.add.reduceat(m.behind[flat], start)
            rare, times, cuts = [], [], [0]
            for w, p in zip(own, places):
                met = Counter([w[i] for i in np.flatnonzero(p < 0).tolist()])
                rare += met.keys()
                times += met.values()
                cuts.append(len(rare))
            score = behind + m.gru.score([m.symbol[p] for p in places]) / math.log(10)
            tokens = pa.array(rare, type=pa.binary())
            try:
                tokens = tokens.cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are not UTF-8
                tokens = pa.array([w.decode("utf-8", "replace") for w in rare], type=pa.string())
            looked_up = pa.StructArray.from_arrays([tokens, pa.array(times, type=pa.int32())], ["token", "k"])
            cols = [pa.array(n_tokens), pa.array(known), pa.array(base.astype(float)), pa.array(score), pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), looked_up)]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *(c.cast(arrow.field(k + i).type) for i, c in enumerate(cols))], schema=arrow)

    return src.mapInArrow(run, schema)


LOOKED_UP = T.StructType([T.StructField("token", T.StringType()), T.StructField("c", T.LongType()), T.StructField("behind", T.DoubleType())])


def scored(docs: DataFrame, train, n_words: int = WORDS, most: int = FREQUENT) -> DataFrame:
    """A row for each row of docs; train: which rows may be learnt from."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    src = docs.select("doc_id", "text", train.alias("train"))
    counts = scratch.save(token_counts(src))
    model = build(spark, src, counts, most, n_words)
    stats = spark.sparkContext.broadcast(model.stats)
    rows = scratch.save(parts(src, ["doc_id", "train"], model).withColumn("row", F.monotonically_increasing_id()))
    everything = counts.agg(F.sum("total")).first()[0] or 0

    def look_up(batches):
        for b in batches:
            tokens, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            behind = stats.value.behind_other([t.encode() for t in tokens], c)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(behind, type=pa.float64())], names=["token", "c", "behind"])

    few = counts.where((F.col("total") < everything / most) & (F.col("token") != "")).select("token", "c").mapInArrow(look_up, LOOKED_UP)
    wanted = rows.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.k")
    found = wanted.join(few, "token").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more_base"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.col("behind")).alias("more_score"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.drop("rare").join(found, "row", "left").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("more_known")).alias("n_known"),
        F.lit(model.stats.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") - F.col("n_tokens") * model.stats.base).alias("base_score"),
        (F.col("score") + zero("more_score")).alias("score"),
    )


def op2_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) != 2)


QUERIES = {"op2_gru_lm": op2_gru_lm}
SQL: dict[str, str] = {}
