"""Periodic runs of words by branching tandem repeats of the suffix tree.

A text is the sequence of its words (split at ASCII white space).  A run is a stretch with smallest period q of
at least max(LEAST, TIMES * q) words that no neighbouring word extends.  A task works on some texts at a time:

* the suffixes are sorted by refining groups (each turn doubles the words by which they are known), and the
  intervals of their common prefixes give the suffix tree, a node with several children as a chain of nodes with two;
* at a node of depth D the leaves of the smaller half are listed, and a leaf i is a branching tandem repeat of two
  times D words if the leaf i + D, or i - D, lies in the other half; all lists together have n log n leaves at most;
* a repeat is rotated to the left while the words agree, and repeats that end together and whose lengths are
  multiples merge into one maximal run.

A run of TIMES periods holds the square of a multiple of its period that has STEM words or more, so the tree
is built of the suffixes whose first STEM words come again in their text, and of its nodes of depth STEM or more;
the smallest period is then read off the square.  No text meets another, and none is shuffled.

Defined results: null, empty and white texts have no words and no runs; a text may be of any length and is held
whole by one task; runs are in order of start, then period; repeated rows give a row each; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable
from itertools import chain, count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.llm.common import PART, fresh, map_texts, table
from spotloom.llm.toxicity import ranges

LEAST, TIMES = 6, 4
#: words by which suffixes are told apart first; a run of LEAST words and TIMES periods holds a square of a multiple of its period at least as long
STEM = 3
#: leaves listed at a time
LISTED = 1 << 21


def _refined(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Order of the suffixes that share STEM words with another of their text; ranks by 3, 6, 12, ... words; starts of the groups by STEM words.

    ids has a 0 behind each text, so that what lies beyond never compares as equal.
    """
    n, top = len(ids), int(ids.max()) + 1
    pad = np.concatenate([ids, [0, 0]]).astype(np.int64)
    bits = top.bit_length()
    if 3 * bits + int(doc[-1]).bit_length() < 63:
        key = ((doc << bits | pad[:n]) << bits | pad[1 : n + 1]) << bits | pad[2:]
    else:
        key = doc
        for at in range(3):
            key = np.unique(key, return_inverse=True)[1] * top + pad[at : n + at]
    order = np.argsort(key)
    first = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = start
    alone = first & np.concatenate([first[1:], [True]])
    slots = np.flatnonzero(~alone)
    heads = first[slots]
    levels, width = [rank], STEM
    live = order[slots]
    sa, base = order, start[slots]
    while len(live):
        second = rank[live + width].astype(np.int64)
        by = np.argsort(base * n + second)
        # groups keep their slots, so sorting by (group, second) permutes inside them
        live, second = live[by], second[by]
        new = np.concatenate([[True], (base[1:] != base[:-1]) | (second[1:] != second[:-1])])
        sa[slots] = live
        at = np.maximum.accumulate(np.where(new, slots, 0))
        rank = rank.copy()
        rank[live] = at
        levels.append(rank)
        width *= 2
        more = ~(new & np.concatenate([new[1:], [True]]))
        live, slots, base = live[more], slots[more], at[more]
    kept = np.flatnonzero(~alone)
    return sa[kept], levels, heads


def _shared(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and b share."""
    got = np.zeros(len(a), np.int64)
    a, b, last = a.copy(), b.copy(), len(ids) - 1
    for k in range(len(levels) - 1, -1, -1):
        rank, width = levels[k], STEM << k
        same = (rank[np.minimum(a, last)] == rank[np.minimum(b, last)]) & (a <= last) & (b <= last)
        step = np.where(same, width, 0)
        a, b, got = a + step, b + step, got + step
    on = np.ones(len(a), bool)
    for _ in range(STEM - 1):
        x, y = ids[np.minimum(a, last)], ids[np.minimum(b, last)]
        on &= (x == y) & (x > 0)
        a, b, got = a + on, b + on, got + on
    return got


def _nearest_lower(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest before with a lower depth, and behind with a lower or equal one; depth is 0 at both ends."""
    n = len(depth)
    before, behind = np.arange(n) - 1, np.arange(n) + 1
    before[0], behind[-1] = 0, n - 1
    todo = np.flatnonzero(depth > 0)
    while len(todo):
        todo = todo[depth[before[todo]] >= depth[todo]]
        before[todo] = before[before[todo]]
    todo = np.flatnonzero(depth > 0)
    while len(todo):
        todo = todo[depth[behind[todo]] > depth[todo]]
        behind[todo] = behind[behind[todo]]
    return before, behind


def branching_repeats(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, D) of every square of two times D >= STEM words that can't be rotated to the right."""
    none = np.empty(0, np.int64)
    sa, levels, heads = _refined(ids, doc)
    m = len(sa)
    if not m:
        return none, none
    place = np.full(len(ids), -1, np.int64)
    place[sa] = np.arange(m)
    depth = np.zeros(m + 1, np.int64)  # depth[b]: words shared by leaves b - 1 and b
    inner = np.flatnonzero(~heads)
    depth[inner] = _shared(sa[inner - 1], sa[inner], levels, ids)
    before, behind = _nearest_lower(depth)
    node = np.flatnonzero(depth)
    lo, hi = before[node], behind[node]
    left = node - lo <= hi - node
    # the smaller half's leaves, and the bounds of the other half
    first, size = np.where(left, lo, node), np.where(left, node - lo, hi - node)
    other, upto = np.where(left, node, lo), np.where(left, hi, node)
    starts, lengths = [], []
    cut = np.searchsorted(np.cumsum(size), np.arange(LISTED, int(size.sum()) + LISTED, LISTED))
    for a, b in zip([0, *(cut[:-1] + 1)], cut + 1):
        b = min(b, len(node))
        if a >= b:
            continue
        leaf = sa[ranges(first[a:b], size[a:b])]
        d, o, u = (np.repeat(x[a:b], size[a:b]) for x in (depth[node], other, upto))
        for step in (d, -d):
            at = leaf + step
            ok = (at >= 0) & (at < len(ids))
            p = place[np.where(ok, at, 0)]
            hit = ok & (p >= o) & (p < u)
            starts.append(np.minimum(leaf, at)[hit])
            lengths.append(d[hit])
    return np.concatenate(starts) if starts else none, np.concatenate(lengths) if lengths else none


def _agreeing(ids: np.ndarray, i: int, d: int, floor: int) -> int:
    """How many words before i, down to floor, equal those d further on."""
    got, step = 0, 64
    while i - got > floor:
        lo = max(floor, i - got - step)
        differ = np.flatnonzero(ids[lo : i - got] != ids[lo + d : i - got + d])
        if len(differ):
            return i - lo - int(differ[-1]) - 1
        got, step = i - lo, step * 4
    return got


def runs_of(ids: np.ndarray, doc: np.ndarray, floor: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, places counted over all texts.  floor[t]: where text t begins."""
    i, d = branching_repeats(ids, doc)
    if not len(i):
        return []
    one = (d == 3) & (ids[i] == ids[i + 1]) & (ids[i] == ids[i + 2])
    two = (d == 4) & (ids[i] == ids[i + 2]) & (ids[i + 1] == ids[np.minimum(i + 3, len(ids) - 1)])
    q = np.where(one, 1, np.where(two, 2, d))
    # what has to stand before the square for TIMES periods; three words there are tried first
    need = np.maximum(LEAST, TIMES * q) - 2 * d
    low = floor[doc[i]]
    ok = i - need >= low
    for back in (1, d, need):
        at = np.maximum(i - back, 0)
        ok &= (need < back) | (ids[at] == ids[at + d])
    i, d, q, need, low = (x[ok] for x in (i, d, q, need, low))
    out: list[tuple[int, int, int]] = []
    end, here = -1, []
    for j in np.lexsort((d, i + 2 * d)).tolist():
        s, w, p = int(i[j]), int(d[j]), int(q[j])
        if s + 2 * w != end:
            end, here = s + 2 * w, []
        if any(w % x == 0 and a <= s for a, _, x in here):
            continue
        more = _agreeing(ids, s, w, int(low[j]))
        if more >= need[j]:
            here.append((s - more, end, p))
            out.append(here[-1])
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_tail(words: list, h: int) -> list:
    """The words, for a tenth of all h with a tail that repeats some words (the digest query's periodic texts)."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


RUN = T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
DIGESTS = T.StructType([*[T.StructField(f, T.LongType()) for f in ("n_runs", "start", "length", "period", "exponent_milli")], T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])


def _found(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, given as words."""
    sizes = np.array([len(w) for w in texts], np.int64)
    ids = np.zeros(int(sizes.sum()) + len(texts), np.int32)
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    floor = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    body = np.ones(len(ids), bool)
    body[floor + sizes] = False
    ids[body] = np.fromiter(map(defaultdict(count(1).__next__).__getitem__, chain.from_iterable(texts)), np.int32, int(sizes.sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e, q in runs_of(ids, doc, floor):
        t = int(doc[s])
        out[t].append((s - int(floor[t]), e - s, q))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> list:
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return [len(runs), s, n, q, None if n is None else 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_collapsed(words, runs)).hexdigest()]


def _mapped(docs: DataFrame, keys: list[str], text: str, one: Callable, out: T.StructType, number: Column | None = None, alter: Callable[[list, int], list] | None = None) -> DataFrame:
    """one(words, runs) for each row; the words are altered first, by the row's number."""
    body = fresh(docs, "body")
    src = docs.select(*[F.col(f"`{k}`") for k in keys], F.concat((F.lit(0) if number is None else number).cast("string"), F.lit("\n"), F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias(body))

    def make():
        def fn(texts):
            numbers, bodies = zip(*(t.split(b"\n", 1) for t in texts))
            words = [b.split() for b in bodies]
            if alter:
                words = [alter(w, int(h)) for w, h in zip(words, numbers)]
            rows = [one(w, r) for w, r in zip(words, _found(words))]
            return {f.name: list(column) for f, column in zip(out.fields, zip(*rows))}

        return fn

    return map_texts(src, keys, body, make, out, PART)


def word_runs(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_words, runs (start, length, period; in words) and the text without what its runs repeat, words joined by spaces."""
    return _mapped(docs, keys, text, lambda w, r: [len(w), r, _collapsed(w, r).decode("utf-8", "replace")], FOUND)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(table(spark, sf_dir, "documents"), ["doc_id"], "text", _digest, DIGESTS, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), repeated_tail)


QUERIES = {"op13_word_runs": op13_word_runs}
SQL: dict[str, str] = {}
