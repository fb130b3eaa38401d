"""All pairs of texts whose shingle sets have a Jaccard similarity of `least` or more, and their components.

Texts with the same set are one item from the start.  Fingerprints that SimHash links by anchors (simhash.links) are
found first, and each such pair of items is compared by whole sets.  The rest, what fingerprints miss, is found by
shingles: they are put in one order, those frequent in a
sample last; sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each, so items that
are alike meet there, and nothing is lost whatever the order (it only decides how many unlike items meet).
Of two items that meet, sizes, the places of the shingle, the parities of the numbers of shingles by cell
(two items' differ in no more cells than they differ in shingles) and the counts of shingles by bin bound
the similarity; what passes is compared by whole sets.

Where m items meet there are m^2 pairs, so links are found in rounds.  First each item is compared with one
other at each shingle, in an order of the shingle's own: in TURNS turns, each for its part of the shingles and
without pairs that are of one component by then, of fingerprints' links or an earlier turn's.  Then, where items of different components still meet, those
outside the largest component are compared with all of other components.  What is left out would join items
that are joined already.

Defined results: null and empty texts have the empty set, which is like itself only; texts may be of any
length; rows of one id are told apart, each by its own text; other columns are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.llm import simhash
from spotloom.llm.common import Scratch, forget, ship, slices
from spotloom.llm.components import components
from spotloom.llm.simhash import HASH_SEED, shingle_hashes

LEAST = 0.8
#: the sample that tells frequent shingles: a share of the rows, and so many rows at least
SAMPLE, SAMPLE_ROWS, SEEN = 0.05, 5000, 4
MOST_FREQUENT = 500_000
#: parts of the shingle hashes' range whose numbers of shingles are kept by item
BINS = 256
#: cells of the hashes' range whose numbers of shingles are kept by item as odd or even, 64 to a word
CELLS = 512
#: pairs whose bins a task holds at a time
STEP = 512
TURNS = 2

ITEMS = [T.StructField("__item", T.LongType()), T.StructField("__size", T.IntegerType()), T.StructField("__prefix", T.ArrayType(T.LongType())), T.StructField("__bins", T.BinaryType()), T.StructField("__odd", T.ArrayType(T.LongType())), T.StructField("__fp", T.LongType())]


def lists(parts: list[np.ndarray]) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(parts or [np.empty(0, np.uint64)]).view(np.int64)))


def sets(docs: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    """keys and the distinct shingle hashes of each row."""
    ship(docs.sparkSession)
    src = docs.select(*keys, F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([*(src.schema[k] for k in keys), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        forget()
        arrow = to_arrow_schema(schema)
        for b in (part for batch in batches for part in slices(batch, len(keys))):
            new = lists([np.unique(shingle_hashes(t, n)) for t in b.column(len(keys)).to_pylist()])
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns[:-1], new], arrow)], schema=arrow)

    return src.mapInArrow(run, schema)


def frequent(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met SEEN times or more in the sample, sorted, and how often.  They only order shingles: no result hangs on them."""
    share = min(1.0, max(SAMPLE, SAMPLE_ROWS / max(1, docs.count())))
    part = docs.where(F.pmod(F.xxhash64(text), F.lit(10_000)) < int(10_000 * share)).select(text)
    met = sets(part, [], text, n).select(F.explode("shingles").alias("h")).groupBy("h").count().where(F.col("count") >= SEEN)
    got = met.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["count"].to_numpy(np.int64)[order]


def prefix(hashes: np.ndarray, often: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The shingles of which a set of that similarity has one too, the rarest first; `hashes` are distinct."""
    n = len(hashes)
    if not n:
        return hashes
    known, count = often
    rank = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, count[at], 0)
    return hashes[np.lexsort((hashes, rank))][: n - math.ceil(least * n - 1e-9) + 1]


def items(docs: DataFrame, text: str, n: int, least: float) -> DataFrame:
    """docs with __item (a hash of the shingle set), __size, __prefix, __bins (counts of shingles by the top bits), __odd (a bit for each cell with an odd number) and __fp (the SimHash)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, n))
    at, schema = docs.columns.index(text), T.StructType([*docs.schema.fields, *ITEMS])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        forget()
        arrow, often = to_arrow_schema(schema), sent.value
        for b in (part for batch in batches for part in slices(batch, at)):
            item, size, first, bins, odd, fp = [], [], [], [], [], []
            for data in b.column(at).cast(pa.binary()).to_pylist():
                h = shingle_hashes(data, n)
                fp.append(simhash.fingerprint(h))
                h = np.unique(h)
                item.append(xxhash.xxh64_intdigest(h.tobytes(), HASH_SEED))
                size.append(len(h))
                first.append(prefix(h, often, least))
                bins.append(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=BINS).astype("<u4").tobytes())
                odd.append(np.packbits((np.bincount((h % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) & 1).astype(np.uint8)).view(np.uint64))
            new = [pa.array(np.array(item, np.uint64).view(np.int64)), pa.array(size, type=pa.int32()), lists(first), pa.array(bins, type=pa.binary()), lists(odd), pa.array(fp, type=pa.int64())]
            cols = [c.cast(f.type) for c, f in zip([*b.columns, *new], arrow)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.mapInArrow(run, schema)


def _possible(a: str, b: str, least: float):
    """Whether items that meet at a shingle, before which they share none, can be that similar: sizes, and what is left from there on."""
    size, other = F.col(f"{a}.size"), F.col(f"{b}.size")
    fits = F.least(size, other) >= least * F.greatest(size, other) - 1e-9
    return fits & (F.least(f"{a}.rest", f"{b}.rest") >= least / (1 + least) * (size + other) - 1e-9)


def _near(a: str, b: str, size: str, other: str, least: float):
    """Whether sets with these parities can be that similar: they differ in (1 - J) / (1 + J) of both sizes' sum."""
    cells = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(CELLS // 64)), F.lit(0))
    return cells <= (1 - least) / (1 + least) * (F.col(size) + F.col(other)) + 1e-6


def _pair(a: str, b: str) -> list:
    return [F.least(f"{a}.item", f"{b}.item").alias("a"), F.greatest(f"{a}.item", f"{b}.item").alias("b")]


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def picked(rows: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose __row is in ids, which come as bitmaps of 32,768 rows each.

    A bit for each row is so little that the planner sends the bitmaps to the tasks up to large tables, and
    the rows stay where they are.
    """
    maps = ids.groupBy(F.bitmap_bucket_number("__row").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__row")).alias("__map"))
    near = rows.withColumn("__bucket", F.bitmap_bucket_number("__row")).join(scratch.save(maps), "__bucket")
    byte = "cast(conv(hex(substring(__map, cast(bitmap_bit_position(__row) div 8 as int) + 1, 1)), 16, 10) as int)"
    return near.where(f"getbit({byte}, cast(bitmap_bit_position(__row) % 8 as int)) = 1").drop("__bucket", "__map")


def _wanted(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The first row of each item that the pairs name."""
    ends = pairs.select(F.col("a").alias("__item")).union(pairs.select("b")).distinct()
    return first.select("__item", "__row").join(ends, "__item").select("__row")


def _beside(pairs: DataFrame, known: DataFrame, column: str) -> DataFrame:
    x = known.select(F.col("__item").alias("a"), F.col(column).alias("x"))
    return pairs.join(x, "a").join(known.select(F.col("__item").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")


def bounded(pairs: DataFrame, rows: DataFrame, first: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """The pairs without those that cannot be that similar: they share no more in a bin than the lesser of the two counts."""

    def run(batches):
        forget()
        for b in (batch.slice(i, STEP) for batch in batches for i in range(0, batch.num_rows, STEP)):
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u4").reshape(-1, BINS) for i in (2, 3))
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            ok = most * (1 + least) >= least * (x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64)) - 1e-6
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    known = scratch.save(picked(rows.select("__row", "__item", "__bins"), _wanted(pairs, first), scratch).drop("__row"))
    return scratch.save(_beside(pairs, known, "__bins").mapInArrow(run, LINKS))


def verified(pairs: DataFrame, rows: DataFrame, first: DataFrame, text: str, n: int, least: float, scratch: Scratch) -> DataFrame:
    """Those of the pairs whose whole sets are that similar."""
    pairs = bounded(pairs, rows, first, least, scratch)
    known = scratch.save(sets(picked(rows.select("__row", "__item", text), _wanted(pairs, first), scratch), ["__item"], text, n))
    shared = _beside(pairs, known, "shingles").select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("s"))
    out = scratch.save(shared.where(F.col("n") / (F.col("s") - F.col("n")) >= least).select("a", "b"))
    scratch.drop(known)
    return out


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs of which the items are not of one component yet."""
    for c in ("a", "b"):
        pairs = pairs.join(comp.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def by_fingerprint(rows: DataFrame, first: DataFrame, text: str, n: int, least: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of items that SimHash links, one item for a fingerprint and the others of its own with it, and those of that similarity."""
    # written, so that the join of a hot fingerprint stands alone and the planner can split it
    fps = scratch.save(first.groupBy(F.col("__fp").alias("fp")).agg(F.min("__item").alias("item")))
    at = lambda s: fps.select(F.col("fp").alias(s), F.col("item").alias(f"i{s}"))
    linked = simhash.links(fps, scratch).join(at("a"), "a").join(at("b"), "b").select("ia", "ib")
    same = first.select(F.col("__fp").alias("a"), F.col("__item").alias("ib")).join(at("a"), "a").where("ia <> ib").select("ia", "ib")
    pairs = scratch.save(linked.union(same).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct())
    return pairs, verified(pairs, rows, first, text, n, least, scratch)


def links(rows: DataFrame, text: str, n: int, least: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different items of that similarity: the same components as all such pairs."""
    first = rows.groupBy("__item").agg(F.min("__row").alias("__row"), F.first("__size").alias("__size"), F.first("__prefix").alias("__prefix"), F.first("__odd").alias("__odd"), F.min("__fp").alias("__fp"))
    first = scratch.save(first)
    tried, found = by_fingerprint(rows, first, text, n, least, scratch)
    comp = scratch.save(components(found, scratch))
    met = first.select("__item", "__size", F.posexplode("__prefix").alias("at", "h"))
    met = met.select("h", "__item", F.struct(F.col("__item").alias("item"), F.col("__size").alias("size"), (F.col("__size") - F.col("at")).alias("rest")).alias("x"))
    turn = Window.partitionBy("h").orderBy(F.xxhash64("__item", "h"), "__item")
    met = met.select("h", "x", F.lag("x").over(turn).alias("y"), F.lead("__item").over(turn).alias("z"))
    met = scratch.save(met.where("y is not null or z is not null").drop("z"))
    beside = met.where("y is not null").where(_possible("x", "y", least))
    for turn in range(TURNS):
        pairs = beside.where(F.pmod("h", F.lit(TURNS)) == turn).select(*_pair("x", "y")).distinct()
        pairs = scratch.save(_apart(pairs, comp))
        got = verified(pairs, rows, first, text, n, least, scratch)
        tried, found = tried.union(pairs), found.union(got)
        comp = scratch.save(components(found, scratch))
    now = scratch.save(met.select("h", "x", F.col("x.item").alias("node")).join(comp, "node", "left").select("h", "x", F.coalesce("root", "node").alias("root")))
    scratch.drop(met)
    several = now.groupBy("h", "root").count().groupBy("h").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("c")).where("c > 1").select("h", "main")
    odd = first.select(F.col("__item").alias("node"), "__odd")
    here = scratch.save(now.join(several, "h").withColumn("node", F.col("x.item")).join(odd, "node").drop("node"))
    scratch.drop(now)
    left = here.where("root <> main").select("h", "x", "root", F.col("__odd").alias("p"))
    right = here.select("h", F.col("x").alias("y"), F.col("root").alias("other"), F.col("__odd").alias("q"))
    alike = (F.col("root") != F.col("other")) & _possible("x", "y", least) & _near("p", "q", "x.size", "y.size", least)
    more = left.join(right, "h").where(alike).select(*_pair("x", "y")).distinct()
    more = scratch.save(more.join(tried, ["a", "b"], "left_anti"))
    scratch.drop(here)
    return found.union(verified(more, rows, first, text, n, least, scratch))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, least: float = LEAST) -> DataFrame:
    """The rows of docs without those that a row of a smaller id stands for: one row for each component of alike texts.

    Of rows with one id in a component, one stays.  Rows without an id stay and stand for no others.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(items(docs, text, n, least).withColumn("__row", F.monotonically_increasing_id()))
    comp = scratch.save(components(links(rows, text, n, least, scratch), scratch))
    # items first, so that a large group of copies is one row where it is joined
    best = rows.where(F.col(doc_id).isNotNull()).groupBy("__item").agg(F.min(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col("__row").alias("row"))).alias("best"))
    kept = best.join(comp.withColumnRenamed("node", "__item"), "__item", "left").groupBy(F.coalesce("root", "__item").alias("root")).agg(F.min("best").alias("best"))
    kept = kept.select(F.col("best.row").alias("__row")).union(rows.where(F.col(doc_id).isNull()).select("__row"))
    return picked(rows, kept, scratch).select(*docs.columns)
