"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, texts scanned once.

An item's words (ASCII letters lower-cased, split at what is neither letter nor digit in ASCII) are cut
into windows of ten words; an item of fewer words is one window.  A text is normalised alike with the byte
place of each word kept, scanned once, and each occurrence marks its words, which map back to the
original text's bytes.

The items travel as a broadcast of a checked size: at most about AUTOMATON_BYTES of windows a block; a long
item is cut into pieces that overlap by all but one word of a window.  A larger benchmark is scanned block by
block, and the marks of the blocks are joined in the row that carries the text.

Defined results: null and empty texts have no words; texts may be of any length; an item without words never
occurs; repeated items with one id count once; items without an id count as one item that has no name, so
their words are hit too; repeated rows give a row each; all other columns are kept by mark(), whose own column
gets another name where `marks` is taken, and ignored by digest().
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.llm.common import ALNUM, Scratch, forget, fresh, ship, table

WINDOW = 10
#: bytes of window text in one automaton; an automaton takes about forty times as much memory
AUTOMATON_BYTES = 4_000_000


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(ALNUM).split() if data else []


def windows_of(words: list[bytes], n: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def build(items: list[tuple[str | None, bytes]], n: int = WINDOW):
    """The automaton; each pattern's value is (number of words, ids of the items it stands in)."""
    import ahocorasick

    owners: dict[tuple[bytes, ...], set[str | None]] = {}
    for item, data in items:
        for w in windows_of(words_of(data), n):
            owners.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, ids in owners.items():
        a.add_word(b" ".join([b"", *w, b""]).decode("latin-1"), (len(w), tuple(ids)))
    if owners:
        a.make_automaton()
    return a if owners else None


def scan_words(words: list[bytes], auto) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged ranges of hit words, end exclusive, and the items that occur."""
    if not words or auto is None:
        return [], set()
    found = list(auto.iter(b" ".join([b"", *words, b""]).decode("latin-1")))
    if not found:
        return [], set()
    ends = list(accumulate(len(w) + 1 for w in words))  # place of the space after each word
    ranges, items = [], set()
    for end, (n, ids) in found:
        last = bisect_left(ends, end)
        ranges.append((last - n + 1, last + 1))
        items.update(ids)
    return merge(ranges), items


def merge(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def byte_spans(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as byte ranges of the original text."""
    if not ranges:
        return []
    norm, at, place = data.translate(ALNUM), 0, []
    for w in norm.split():
        at = norm.index(w, at)
        place.append((at, at + len(w)))
        at += len(w)
    return [(place[a][0], place[b - 1][1]) for a, b in ranges]


MARKS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("ranges", T.ArrayType(T.LongType())),  # start, end, start, end ... in words
        T.StructField("spans", T.ArrayType(T.LongType())),  # the same in bytes of the text
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


PIECES = T.StructType([T.StructField("item", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("data", T.BinaryType())])


def pieces_of(words: list[bytes], most: int, n: int = WINDOW) -> list[list[bytes]]:
    """Runs of words of about `most` bytes, or n words, that together have the windows of all."""
    out, start, held = [], 0, 0
    for i, w in enumerate(words):
        held += len(w) + 1
        if held >= most and i - start + 1 >= n and i + 1 < len(words):
            out.append(words[start : i + 1])
            start = i - n + 2
            held = sum(len(x) + 1 for x in words[start : i + 1])
    return [*out, words[start:]] if words else []


def blocks_of(items: DataFrame, most: int) -> list[DataFrame]:
    """The items as (item, data), one table for each block of about `most` bytes of windows."""

    def cut(batches):
        for b in batches:
            rows = [(i, k, b" ".join(p)) for i, t in zip(*(c.to_pylist() for c in b.columns)) for k, p in enumerate(pieces_of(words_of(t), max(1, most // (4 * WINDOW))))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], names=PIECES.fieldNames())

    src = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("data")).where("data is not null").mapInArrow(cut, PIECES)
    total = src.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n = max(1, -(-total * WINDOW // most))
    if n == 1:
        return [src]
    dealt = src.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(n)))
    return [dealt.where(F.col("block") == i).drop("block") for i in range(n)]


def _sorted(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x))


def mark(docs: DataFrame, items: DataFrame, text: str = "text", most: int = AUTOMATON_BYTES) -> DataFrame:
    """docs with a last column `marks`: number of words, hit ranges in words and bytes, and items that occur.

    Where docs has a column of that name, the new one is named by fresh(docs, "marks").
    """
    spark = docs.sparkSession
    ship(spark)
    blocks, scratch, name = blocks_of(items, most), None, fresh(docs, "marks")
    out = docs
    for i, block in enumerate(blocks):
        rows = spark.sparkContext.broadcast([(r.item, bytes(r.data)) for r in block.collect()])
        src = out if i else out.withColumn(name, F.lit(None).cast(MARKS))
        at, schema = src.columns.index(text), src.schema

        def run(batches, rows=rows, at=at, schema=schema):
            from pyspark.sql.pandas.types import to_arrow_schema

            forget()
            auto, arrow = build(rows.value), to_arrow_schema(schema)
            kind = arrow.field(arrow.names[-1]).type
            for b in batches:
                if not b.num_rows:
                    continue
                old, new = b.column(b.num_columns - 1).to_pylist(), []
                for data, had in zip(b.column(at).cast(pa.binary()).to_pylist(), old):
                    words = words_of(data)
                    ranges, ids = scan_words(words, auto)
                    if had and had["ranges"]:
                        ranges = merge([*ranges, *zip(had["ranges"][::2], had["ranges"][1::2])])
                        ids |= set(had["items"])
                    new.append({"n_words": len(words), "ranges": [x for r in ranges for x in r], "spans": [x for r in byte_spans(data, ranges) for x in r], "items": _sorted(ids)})
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, type=kind)], schema=arrow)

        out = src.mapInArrow(run, schema)
        if i + 1 < len(blocks):
            scratch = scratch or Scratch(spark)
            out = scratch.save(out)
    return out


def digest(docs: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    got = mark(docs.select(*keys, "text"), items)
    pairs = F.expr("transform(sequence(1, cast(size(marks.ranges) / 2 as int)), i -> marks.ranges[2 * i - 1] - marks.ranges[2 * i - 2])")
    hit = F.when(F.size("marks.ranges") > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    return got.select(
        *keys,
        F.col("marks.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("marks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("marks.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("marks.ranges") > 0).alias("contaminated"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


_WORDS = "list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

SQL = {
    "op5_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT g.r, g.i, g.n, win.item FROM grams g JOIN win ON g.n = win.n AND g.g = win.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
  coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
}
QUERIES = {"op5_decontaminate": op5_decontaminate}
