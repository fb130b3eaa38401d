"""Lines that many documents share, in DataFrame functions only.

Every line with a key (the line without white space at both ends, A-Z lower-cased) becomes a 128-bit hash with its
document and position.  The hashes are dealt out by range of (hash, document) and sorted by (hash, document, position)
inside each range, so a line that stands in a third of all documents covers many ranges.  First occurrences in each
document are read off in that order and counted: each range adds up its own, and only sums meet.  Lines of keys in
at least `documents` documents are marked, and the marks of each document come back as a compressed keep bitmap:
64 positions a word, and only words with a line to drop.  Texts are not part of any of this; they are dealt out once, and only when
the bitmaps are laid on them (`applied`).

Defined results: null and empty texts are one empty line, which has no key and stays; documents are told apart by
doc_id, so rows of one id count once for a key, as do all rows without an id; each row is judged by its own text, and
repeated rows give a row each; texts may be of any length (one text's lines are held by one task); other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotloom.llm.common import Scratch, table

WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENTS, CODE_POINTS = 10, 1
#: lines that a word of a bitmap stands for
WORD = 64


def _text(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, f, t): id, fingerprint of the text, text.  Rows alike in d and f have the same result."""
    return docs.select(F.col(f"`{doc_id}`").alias("d"), F.xxhash64(_text(text)).alias("f"), _text(text).alias("t"))


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", code_points: int = CODE_POINTS) -> DataFrame:
    """(h, g, d, f, i): two hashes of the key of line i, for lines with a key of at least so many code points."""
    t = F.col("t")
    # for text of ASCII alone lower() is the same and faster
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    lines = _rows(docs, doc_id, text).select("d", "f", F.posexplode(F.split(low, "\n")).alias("i", "line"))
    key = lines.select("d", "f", "i", F.btrim("line", F.lit(WS)).alias("key")).where(F.length("key") >= max(code_points, 1))
    return key.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "d", "f", "i")


def keep_bitmaps(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", documents: int = DOCUMENTS, code_points: int = CODE_POINTS) -> DataFrame:
    """(d, f, words) of texts that lose lines: words of 64 lines, in order, as (place, keep: bit b is set if line 64 * place + b stays).

    Places not listed keep all their lines.
    """
    # written first, so that the cut points of the ranges are found without reading the texts again
    hashed = scratch.save(line_hashes(docs, doc_id, text, code_points))
    # a window over what the ranges are cut by needs no other exchange
    ranged = hashed.repartitionByRange("h", "g", "d").withColumn("nth", F.row_number().over(Window.partitionBy("h", "g", "d").orderBy("f", "i")))
    common = scratch.save(ranged.where("nth = 1").groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= documents).select("h", "g"))
    hit = hashed.join(common, ["h", "g"]).select("d", "f", "i").repartition("d", "f")
    word = hit.groupBy("d", "f", F.expr(f"i div {WORD}").cast("int").alias("place")).agg(F.bitwise_not(F.bit_or(F.expr(f"shiftleft(1L, i % {WORD})"))).alias("keep"))
    return scratch.save(word.groupBy("d", "f").agg(F.sort_array(F.collect_list(F.struct("place", "keep"))).alias("words")))


def _dropped(words: Column) -> Column:
    """The positions that a bitmap drops, in order."""
    bits = lambda w: F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(w["keep"], b) == 0)
    return F.flatten(F.transform(words, lambda w: F.transform(bits(w), lambda b: w["place"] * WORD + b)))


def applied(docs: DataFrame, bitmaps: DataFrame, keys: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """keys, n_lines, n_dropped and the text's other lines, joined by \\n."""
    src = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{doc_id}`").alias("__d"), F.xxhash64(_text(text)).alias("__f"), _text(text).alias("__t"))
    marks = bitmaps.select(F.col("d").alias("__d2"), F.col("f").alias("__f2"), F.col("words").alias("__words"))
    # dealt out at any size, so that its cost is in proportion; the bitmaps are hashed, and texts aren't sorted
    j = src.join(marks.hint("shuffle_hash"), F.col("__d").eqNullSafe(F.col("__d2")) & (F.col("__f") == F.col("__f2")), "left")
    at = j.select(*keys, "__t", F.split("__t", "\n").alias("__lines"), _dropped(F.coalesce("__words", F.array().cast("array<struct<place:int,keep:bigint>>"))).alias("__drop"))
    # the stretches between dropped lines are cut out whole
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("__drop", k - 1) + 1)
    until = lambda k: F.coalesce(F.get("__drop", k), F.size("__lines"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("__drop")), lambda k: F.slice("__lines", begin(k) + 1, until(k) - begin(k)))
    kept = F.when(F.size("__drop") == 0, F.col("__t")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return at.select(*keys, F.size("__lines").cast("long").alias("n_lines"), F.size("__drop").cast("long").alias("n_dropped"), kept.alias("kept"))


def without_common_lines(docs: DataFrame, keys: list[str], doc_id: str = "doc_id", text: str = "text", documents: int = DOCUMENTS, code_points: int = CODE_POINTS) -> DataFrame:
    """keys, n_lines (before dropping), n_dropped and the kept text of each row."""
    scratch = Scratch(docs.sparkSession)
    return applied(docs, keep_bitmaps(docs, scratch, doc_id, text, documents, code_points), keys, doc_id, text)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = without_common_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = {
    "op11_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM x),
c AS (SELECT key FROM k WHERE length(key) >= {CODE_POINTS} GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'none')) >= {DOCUMENTS}),
m AS (SELECT r, line, i, key IN (SELECT key FROM c) AS hit FROM k)
SELECT d.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (hit) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit), '')) AS kept_sha256
FROM m JOIN d USING (r) GROUP BY r, d.doc_id
"""
}
QUERIES = {"op11_line_dedup": op11_line_dedup}
