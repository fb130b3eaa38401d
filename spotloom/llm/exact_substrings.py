"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts elsewhere.

Windows of LENGTH bytes that are equal choose the same anchor: of the K-byte strings inside, the one of
least hash, leftmost of equals.  Consecutive windows with one anchor form a run, so a text of n bytes has
about n / 80 runs, and only those whose anchor hash stands twice or more can hold a repeated window.

Runs of equal content (same class) repeat as a whole.  An anchor with several classes is settled by
suffix sorting: one text segment for each class, many anchors in one bounded batch, sorted by the Lyndon
grouping construction of suffix_array; neighbours in that order show the equal windows.  A class goes into
the batch only if it shares an anchor's surroundings on the left, on the right or on both sides with
another, which every repeated window must.  An anchor with over CROWD classes (a passage in a large share
of all texts) is never gathered: its windows are compared by 128-bit hash in a spread-out aggregation.

Equal texts are known by a 128-bit hash of the text, and their runs collapse before they are shuffled.

Defined results: null is the empty text; texts under LENGTH bytes lose nothing, texts may be of any length;
repeated rows, with or without an id, remove each other's bytes where they are long enough; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.llm.common import Scratch, ship, table
from spotloom.llm.suffix_array import suffix_array

LENGTH = 200
K = 50
W = LENGTH - K + 1
CHUNK = (1 << 20) - 1024
CROWD = 2000
BATCH_CLASSES = 1500
#: partitions of the sorting stage: one for so many batches, up to what a driver can keep track of
BATCHES_A_TASK, MOST_TASKS = 8, 50_000
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _hashes(b: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of each K-byte string."""
    n = len(b)
    if len(_tables.get("up", ())) < n + 1:
        size = max(n + 1, 1 << 16)
        _tables["up"] = _powers(_BASE, size)
        _tables["down"] = _powers(pow(_BASE, -1, 1 << 64), size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _tables["up"][:n], out=sums[1:])
    h = (sums[K:] - sums[:-K]) * _tables["down"][: n - K + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def runs(data: bytes):
    """Arrays over the runs: first window, number of windows, place of the anchor, anchor hash."""
    parts = []
    for a in range(0, len(data) - LENGTH + 1, CHUNK):
        piece = np.frombuffer(data, np.uint8)[a : a + CHUNK + LENGTH - 1]
        h = _hashes(piece)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= W:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        least = np.minimum(key[: len(h) - W + 1], key[W - width : W - width + len(h) - W + 1])
        at = (least & _LOW).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        size = np.diff(np.concatenate([start, [len(at)]]))
        parts.append((start + a, size, at[start] + a, h[at[start]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else None


def name_of(data: bytes | None) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data or b"")
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


RUNS = T.StructType([T.StructField(n, t) for n, t in (("t1", T.LongType()), ("t2", T.LongType()), ("s", T.IntegerType()), ("n", T.IntegerType()), ("m", T.IntegerType()), ("g", T.LongType()), ("c", T.LongType()))])


def _runs_of(batches):
    for b in batches:
        rows = []
        for data in b.column(0).to_pylist():
            got = runs(data) if data and len(data) >= LENGTH else None
            if got is None:
                continue
            s, n, m, g = got
            c = np.array([xxhash.xxh3_64_intdigest(data[i : i + k]) for i, k in zip(s.tolist(), (n + LENGTH - 1).tolist())], np.uint64).view(np.int64)
            t1, t2 = name_of(data)
            rows.append((np.full(len(s), t1), np.full(len(s), t2), s.astype(np.int32), n.astype(np.int32), (m - s).astype(np.int32), g, c))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], names=RUNS.fieldNames())


NAMES = T.StructType([T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType())])


def _named(df: DataFrame, text: str) -> DataFrame:
    """df with the name of its text as t1, t2."""

    @F.pandas_udf(NAMES)
    def named(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([name_of(x) for x in s], columns=["t1", "t2"], dtype="int64")

    return df.withColumn("name", named(F.col(text))).select("*", "name.*").drop("name")


SEGMENTS = T.StructType([T.StructField("g", T.LongType()), T.StructField("c", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("m", T.IntegerType()), T.StructField("seg", T.BinaryType())])


def _segments(batches):
    for b in batches:
        rows = []
        for data, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows += [(w["g"], w["c"], w["n"], w["m"], data[w["s"] : w["s"] + w["n"] + LENGTH - 1]) for w in wanted]
        if rows:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), types)], names=SEGMENTS.fieldNames())


def _surroundings(n: int, m: int, seg: bytes) -> list[tuple]:
    """Of the windows of a run, each holds one of these beside the anchor; equal windows hold equal ones."""
    left, out = m, []  # windows have from m - n + 1 to m bytes before the anchor
    least = m - n + 1
    third = (W - 1) // 3
    if left >= 2 * third:
        out.append(("l", seg[m - 2 * third : m]))
    if least < third:
        out.append(("r", seg[m + K : m + K + 2 * third]))
    if left >= third and least < 2 * third:
        out.append(("b", seg[m - third : m], seg[m + K : m + K + third]))
    return out


def repeated_windows(classes: list[tuple[int, int, int, bytes]]) -> list[list[int]]:
    """For each (anchor hash, windows, place of the anchor, segment) the offsets of windows that another class, or the same one, also has."""
    seen: dict[tuple, int] = {}
    keys = [[(g, *k) for k in _surroundings(n, m, seg)] for g, n, m, seg in classes]
    for ks in keys:
        for k in ks:
            seen[k] = seen.get(k, 0) + 1
    out: list[list[int]] = [[] for _ in classes]
    live = [i for i, ks in enumerate(keys) if any(seen[k] > 1 for k in ks)]
    if not live:
        return out
    text: list[int] = []
    owner: list[tuple[int, int]] = []
    for i in live:
        _, n, _, seg = classes[i]
        text.extend(seg)
        text.append(-1)
        owner.extend((i, o) for o in range(n))
        owner.extend([(-1, 0)] * (len(seg) + 1 - n))
    last, last_window = (-1, 0), None
    for p in suffix_array(text):
        i, o = owner[p]
        if i < 0:
            continue
        window = classes[i][3][o : o + LENGTH]
        if window == last_window:
            out[i].append(o)
            if last is not None:
                out[last[0]].append(last[1])
            last = None
        else:
            last, last_window = (i, o), window
    return [sorted(x) for x in out]


def _intervals(offsets: list[int]) -> list[int]:
    out: list[int] = []
    for o in offsets:
        if out and out[-1] == o:
            out[-1] = o + 1
        else:
            out += [o, o + 1]
    return out


FOUND = T.StructType([T.StructField("g", T.LongType()), T.StructField("c", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType()))])


def _sorted_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["g", "c"]).sort_values(["g", "c"])
    got = repeated_windows(list(zip(pdf.g.tolist(), pdf.n.tolist(), pdf.m.tolist(), pdf.seg.tolist())))
    rows = [(g, c, _intervals(x)) for g, c, x in zip(pdf.g.tolist(), pdf.c.tolist(), got) if x]
    return pd.DataFrame(rows, columns=["g", "c", "spans"])


WINDOWS = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), T.StructField("g", T.LongType()), T.StructField("c", T.LongType()), T.StructField("o", T.IntegerType())])


def _windows(batches):
    for b in batches:
        rows = []
        for g, c, n, seg in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
            rows += [(*name_of(seg[o : o + LENGTH]), g, c, o) for o in range(n)]
        if rows:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), types)], names=WINDOWS.fieldNames())


def _crowded(segments: DataFrame) -> DataFrame:
    w = segments.mapInArrow(_windows, WINDOWS)
    twice = w.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1").select("w1", "w2")
    return w.join(twice, ["w1", "w2"]).groupBy("g", "c").agg(F.expr("flatten(transform(array_sort(collect_list(o)), o -> array(o, o + 1)))").alias("spans"))


def removals(docs: DataFrame, scratch: Scratch, text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(t1, t2, spans) for each text that loses bytes: byte intervals as start, end, start, end ...; they may overlap."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(f"`{text}`").cast("binary").alias("data")).where(F.octet_length("data") >= LENGTH)
    own = ["t1", "t2", "s", "n", "m", "g", "c"]
    occ = scratch.save(texts.mapInArrow(_runs_of, RUNS).groupBy(*own).agg(F.count("*").alias("k")))
    classes = occ.groupBy("g", "c").agg(F.sum("k").alias("k"), F.min(F.struct("t1", "t2", "s", "n", "m")).alias("at"))
    groups = occ.groupBy("g").agg(F.sum("k").alias("all")).where("all > 1").select("g")
    known = scratch.save(classes.join(groups, "g"))
    wide = known.groupBy("g").agg(F.count("*").alias("classes")).where("classes > 1")
    many = known.join(wide, "g").select("g", "c", "classes", "at.*")
    wanted = many.groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "n", "m", "g", "c")).alias("wanted"))
    pieces = _named(texts, "data").join(wanted, ["t1", "t2"]).select("data", "wanted").mapInArrow(_segments, SEGMENTS)
    # copies of a text give the same pieces; they meet task by task before the shuffle
    pieces = scratch.save(pieces.groupBy("g", "c", "n", "m").agg(F.first("seg").alias("seg")).select(*SEGMENTS.fieldNames()))
    crowds = wide.where(F.col("classes") > crowd).select("g")
    batches = max(1, pieces.count() // BATCH_CLASSES)
    small = pieces.join(crowds, "g", "left_anti").withColumn("batch", F.pmod(F.xxhash64("g"), F.lit(batches)))
    # a number of its own, since the planner would join small partitions whose work is long
    tasks = min(-(-batches // BATCHES_A_TASK), MOST_TASKS)
    found = small.repartition(tasks, "batch").groupBy("batch").applyInPandas(lambda pdf: _sorted_batch(pdf), FOUND)
    found = scratch.save(found.union(_crowded(pieces.join(crowds, "g", "left_semi"))))
    # a class that stands twice repeats as a whole; of the others what was found
    status = known.select("g", "c", F.col("k").alias("stands")).join(found, ["g", "c"], "left").where("stands > 1 or spans is not null").select("g", "c", F.when(F.col("stands") == 1, F.col("spans")).alias("spans"))
    # written, so that the join below stands alone and the planner can split the partition of a hot class
    status = scratch.save(status)
    for done in (pieces, found, known):
        scratch.drop(done)
    each = occ.join(status, ["g", "c"]).select("t1", "t2", F.expr(f"transform(coalesce(spans, array(0, n)), (x, i) -> s + x + if(i % 2 = 1, {LENGTH - 1}, 0))").alias("spans"))
    return each.groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


OUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def maximal(spans: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def digest(docs: DataFrame, keys: list[str], text: str = "text", crowd: int = CROWD) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    gone = scratch.save(removals(docs, scratch, text, crowd))
    named = _named(docs.select(*keys, F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("data")), "data")
    src = named.join(gone, ["t1", "t2"], "left").select(*keys, "data", "spans")
    schema = T.StructType([src.schema[k] for k in keys] + OUT.fields)

    def run(batches):
        for b in batches:
            rows = []
            for data, spans in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist()):
                cut, at, h = maximal(spans or []), 0, hashlib.sha256()
                for x, y in cut:
                    h.update(data[at:x])
                    at = y
                h.update(data[at:])
                rows.append((len(data), sum(y - x for x, y in cut), len(cut), h.hexdigest()))
            if rows:
                cols = [pa.array(x, type=t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *cols], names=schema.fieldNames())

    return src.mapInArrow(run, schema)


def op7_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op7_exact_substrings": op7_exact_substrings}
SQL: dict[str, str] = {}
