"""SimHash near-duplicates by anchor-point covering.

Fingerprints: one bit a place, set where over half the shingle hashes have it.  Equal fingerprints meet by
aggregation, and from there on each fingerprint is one row, however many documents have it.

Anchors are the words of a linear code of length 64, fewer or more by the number of fingerprints.  Let r(x)
be the distance from fingerprint x to its nearest anchor, its home; the largest r is the code's covering
radius on the data.  Each x goes to every anchor within r(x) + t.  If d(x, y) <= t and r(x) <= r(y), then y
is within r(x) + t <= r(y) + t of the home of x: the pair meets there, so comparing at each anchor those at
home with all that came finds every link, and no radius has to be guessed.

At an anchor the two sides are cut into blocks of at most BLOCK, and each pair of blocks is a group of its
own, so a crowded anchor (a large group of near copies) is shared out over tasks.  A group gives a spanning
forest of its links, at most one edge for each row it holds, never all pairs.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other; repeated
rows give a row each; a null id counts as no id in a component's smallest; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.llm.common import LOWER, Scratch, map_texts, ship, table
from spotloom.llm.components import components

SHINGLE = 4
BITS = 4
HASH_SEED = 42
CODE_SEED = 7
BLOCK = 8192


def shingle_hashes(data: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = data.translate(LOWER).split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    text, size = b" ".join(words), len(words)
    digest, seed = xxhash.xxh64_intdigest, HASH_SEED
    if size <= n:
        return np.array([digest(text, seed)], np.uint64)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    return np.fromiter([digest(text[a : b - 1], seed) for a, b in zip(starts, ends[n - 1 :])], np.uint64, size - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """As a signed 64-bit integer."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        bits = np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", n: int = SHINGLE) -> DataFrame:
    """keys and fp; a text of any length is hashed whole, 4096 shingles at a time."""

    def make():
        return lambda texts: {"fp": [fingerprint(shingle_hashes(t, n)) for t in texts]}

    return map_texts(docs, keys, text, make, T.StructType([T.StructField("fp", T.LongType())]))


def anchors(k: int) -> np.ndarray:
    """The 2^k words of a linear code of length 64, from a fixed generator of rank k."""
    rng, rows = np.random.default_rng(CODE_SEED), []
    reduced: list[int] = []
    while len(rows) < k:
        row = x = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for r in reduced:
            x = min(x, x ^ r)
        if x:
            reduced.append(x)
            rows.append(row)
    out = np.zeros(1, np.uint64)
    for row in rows:
        out = np.concatenate([out, out ^ np.uint64(row)])
    return out


def code_size(n: int) -> int:
    """Dimension of the code for n fingerprints: finding anchors costs n 2^k, comparing n^2 times the share of anchors that each visits."""
    return int(np.clip(-(-int(max(n, 1)).bit_length() // 2) + 3, 4, 18))


VISITS = T.StructType([T.StructField("anchor", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("home", T.BooleanType())])


def visits(fps: DataFrame, k: int, bits: int = BITS) -> DataFrame:
    """A row for each fingerprint and anchor within its own radius plus the threshold."""
    ship(fps.sparkSession)

    def run(batches):
        import pyarrow as pa

        code = anchors(k)
        step = max(1, (1 << 20) >> k)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), step):
                part = fp[i : i + step]
                far = np.bitwise_count(part.view(np.uint64)[:, None] ^ code[None, :])
                home = far.argmin(1)
                least = far[np.arange(len(part)), home]
                row, anchor = np.nonzero(far <= (least + bits)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(part[row]), pa.array(anchor == home[row])], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, VISITS)


def forest(home: np.ndarray, came: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links between the two sides."""
    home_u, came_u = home.view(np.uint64), came.view(np.uint64)
    label = np.arange(len(came))
    own: dict[int, int] = {}  # where a fingerprint at home also stands among those that came
    at = {int(x): i for i, x in enumerate(came)}
    left, right = [], []
    step = max(1, (1 << 21) // max(1, len(came)))
    for i in range(0, len(home), step):
        near = np.bitwise_count(home_u[i : i + step, None] ^ came_u[None, :]) <= bits
        for j in np.flatnonzero(near.sum(1) > 0):
            x = int(home[i + j])
            linked = np.flatnonzero(near[j])
            labels, first = np.unique(label[linked], return_index=True)
            mine = at.get(x)
            new = 0
            for f in linked[first]:
                if mine is not None and label[f] == label[mine]:
                    continue
                if int(came[f]) != x:
                    left.append(x)
                    right.append(int(came[f]))
                    new += 1
            if mine is not None and label[mine] not in labels:
                labels = np.append(labels, label[mine])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels.min()
    return left, right


EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def links(fps: DataFrame, scratch: Scratch, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Edges between different fingerprints that differ in at most `bits` bits: the same components as all such pairs."""
    n = fps.count()
    k = code_size(n)
    tasks = max(1, (n << k) >> 28)  # comparisons with anchors, by task
    seen = scratch.save(visits(fps.repartition(tasks, "fp"), k, bits))
    # one row for each anchor, of which there are 2^18 at most
    load = seen.groupBy("anchor").agg(F.ceil(F.sum(F.col("home").cast("int")) / block).cast("int").alias("hs"), F.ceil(F.count("*") / block).cast("int").alias("cs")).where("hs > 0")
    met = seen.join(F.broadcast(load), "anchor")
    cut = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)).cast("int")
    came = met.select("anchor", "fp", F.lit(False).alias("home"), F.explode(F.expr("sequence(0, hs - 1)")).alias("h"), (cut % F.col("cs")).alias("c"))
    home = met.where("home").select("anchor", "fp", F.lit(True).alias("home"), (cut % F.col("hs")).alias("h"), F.explode(F.expr("sequence(0, cs - 1)")).alias("c"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        at_home = pdf["home"].to_numpy()
        fp = pdf["fp"].to_numpy()
        a, b = forest(fp[at_home], fp[~at_home], bits)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    edges = came.union(home).groupBy("anchor", "h", "c").applyInPandas(compare, EDGES)
    return edges


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(id, fp, component_id) for each row; component_id is the smallest id reachable over links."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(fingerprints(docs, [doc_id], text, n).withColumnRenamed(doc_id, "doc_id"))
    fps = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(fps, scratch, bits)
    comp = scratch.save(components(edges, scratch))
    member = fps.join(comp.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
    roots = member.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = member.join(roots, "root").select("fp", "component_id")
    # written, so that the join below stands alone and the planner can split the partition of a hot fingerprint
    whole = scratch.save(fps.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(whole, "fp").select(F.col("doc_id").alias(doc_id), "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
SQL: dict[str, str] = {}
