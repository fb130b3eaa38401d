"""Quality rules with adaptive thresholds, in DataFrame functions only.

Measures of each text are expressions inside one projection (windows of eight words are compared by a
64-bit hash; two different windows of one text that share a hash would count as equal).  For each language
and source a quantile sketch is kept for each measure: counts by bucket, the buckets as wide as a 32nd of
their values, so a sketch has some hundreds of numbers whatever the number of rows.  Sketches merge by adding
counts.  A source's sketch is merged with that of its language, which counts as PRIOR rows, and a language's
likewise with that of all: small sources follow their language, large ones themselves, without a step between.

The thresholds of a cell are the quantiles of its own sketch: a measure is out of bounds in the bucket beyond
that up to which all but TAIL thousandths of the cell's rows lie, mean word length also below that of TAIL
thousandths.  They are joined back to the measures, and a text with a measure out of bounds, or that fails
the base rules, is not kept.

Defined results: null and empty texts have no words and fail the base rules; texts may be of any length; null
languages and sources form groups of their own; repeated rows give a row each; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotloom.llm.common import Scratch, table

WS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words
#: rows that what is known of the language counts for in a source, and what is known of all in a language
PRIOR = 100
#: thousandths of a cell's rows beyond a threshold, by which a measure is out of bounds
TAIL = 10
#: highest bits of a measure that its bucket keeps: a relative error of 1/32
SIGNIFICANT = 6
#: measure -> what is divided by what
MEASURES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
#: those of which low values are out of bounds too
LOW_TOO = ("word_length",)
NONE = "\u0000none"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words in windows that stand twice or more."""
    n = F.size(words)
    long_ = lambda x: F.lit(x).cast("int")

    def starts(s: Column) -> Column:
        k = F.size(s)
        same = lambda i, j: F.element_at(s, i)["h"] == F.element_at(s, j)["h"]
        mark = F.transform(F.sequence(long_(1), k), lambda i: F.when(((i > 1) & same(i, F.greatest(i - 1, long_(1)))) | ((i < k) & same(i, F.least(i + 1, k))), F.element_at(s, i)["i"]))
        return F.sort_array(F.filter(mark, lambda x: x.isNotNull()))

    def cover(p: Column) -> Column:
        k = F.size(p)
        gaps = F.transform(F.sequence(long_(1), k), lambda i: F.when(i == k, long_(WINDOW)).otherwise(F.least(long_(WINDOW), F.element_at(p, F.least(i + 1, k)) - F.element_at(p, i))))
        return F.when(k > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))

    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    windows = lambda h: F.sort_array(F.transform(F.sequence(long_(1), F.size(h) - WINDOW + 1), lambda i: F.struct(F.xxhash64(F.slice(h, i, WINDOW)).alias("h"), i.alias("i"))))
    return F.when(n > WINDOW, _let(hashes(words), lambda h: _let(windows(h), lambda s: _let(starts(s), cover)))).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and the counts of each text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.btrim(t, F.lit(WS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    both = lambda a: F.struct(F.size(a).cast("long").alias("n"), F.size(F.array_distinct(a)).cast("long").alias("d"))
    counted = lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("r"))
    found = docs.select(
        *keys,
        _let(words, counted).alias("w"),
        _let(lines, both).alias("l"),
        F.length(F.translate(t, WS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return found.select(*keys, F.col("w.n").alias("n_words"), "word_chars", "n_symbols", (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"))


BASE_FAILED = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)"


def _bucket(name: str, div: str = "div") -> str:
    """SQL: the measure in millionths, cut to its SIGNIFICANT highest bits."""
    value = f"1000000 * {MEASURES[name][0]} {div} greatest({MEASURES[name][1]}, 1)"
    drop = f"greatest(length(bin({value})) - {SIGNIFICANT}, 0)"
    if div == "div":
        return f"shiftleft(shiftright({value}, {drop}), {drop})"
    return f"((({value}) >> CAST({drop} AS BIGINT)) << CAST({drop} AS BIGINT))"


def sketches(m: DataFrame) -> DataFrame:
    """Counts by (lang, source, measure, bucket) of the texts that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.expr(_bucket(k)).alias("bucket")) for k in MEASURES]))
    return m.where(f"NOT {BASE_FAILED}").select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").cast("decimal(38,0)").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "bucket").agg(F.sum("n").cast("decimal(38,0)").alias("n"))


def with_prior(sketch: DataFrame, prior: DataFrame, by: list[str]) -> DataFrame:
    """The sketch, each of its cells as if PRIOR rows more had been seen that are spread as in the prior sketch of the cell's `by`.

    Counts are multiplied by the prior's total, so that they stay whole numbers; only ratios matter.
    """
    total = prior.groupBy(*by).agg(F.sum("n").cast("decimal(38,0)").alias("total"))
    rest = [c for c in sketch.columns if c not in (*by, "bucket", "n")]
    cells = sketch.select(*by, *rest).distinct()
    whole = lambda c: c.cast("decimal(38,0)")
    own = sketch.join(total, by).select(*by, *rest, "bucket", whole(F.col("n") * F.col("total")).alias("n"))
    more = cells.join(prior, by).select(*by, *rest, "bucket", whole(F.col("n") * PRIOR).alias("n"))
    return merged(own.union(more), [*by, *rest])


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi): the least buckets up to which TAIL of the cell's rows lie, and all but TAIL."""
    own = Window.partitionBy(*by)
    c = sketch.select(*by, "bucket", F.sum("n").over(own.orderBy("bucket")).alias("upto"), F.sum("n").over(own).alias("rows"))
    at = lambda share: F.min(F.when(F.col("upto") * 1000 >= F.col("rows") * share, F.col("bucket")))
    return c.groupBy(*by).agg(at(TAIL).alias("lo"), at(1000 - TAIL).alias("hi"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source): bounds as columns lo_ and hi_ of each measure."""
    of_all = merged(sketch, ["measure"])
    of_lang = with_prior(merged(sketch, ["measure", "lang"]), of_all, ["measure"])
    ends = quantiles(with_prior(sketch, of_lang, ["measure", "lang"]), ["lang", "source", "measure"])
    return ends.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == k, F.col(e))).alias(f"{e}_{k}") for k in MEASURES for e in ("lo", "hi")])


def _outside(div: str = "div") -> str:
    return " OR ".join([f"{_bucket(k, div)} > hi_{k}" for k in MEASURES] + [f"{_bucket(k, div)} < lo_{k}" for k in LOW_TOO])


def judged(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, measures, base_failed and kept of each row."""
    scratch = Scratch(docs.sparkSession)
    src = docs.select(*keys, f"`{text}`", F.coalesce("lang", F.lit(NONE)).alias("__lang"), F.coalesce("source", F.lit(NONE)).alias("__source"))
    m = scratch.save(measured(src, [*keys, "__lang", "__source"], text))
    sketch = scratch.save(sketches(m.withColumnsRenamed({"__lang": "lang", "__source": "source"})))
    # written, so that the planner knows its size before it deals out the rows
    bounds = scratch.save(thresholds(sketch).withColumnsRenamed({"lang": "__lang", "source": "__source"}))
    # every (lang, source) with a row that passes the base rules has bounds; the others need none
    j = m.join(bounds, ["__lang", "__source"], "left")
    inside = ~F.coalesce(F.expr(_outside()), F.lit(False))
    return j.select(*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"), (~F.expr(BASE_FAILED) & inside).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), ["doc_id"])


SQL = {
    "op9_quality_rules": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM f WHERE len(w) >= 8)),
twice AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest(range(i, i + 8)) AS p FROM g JOIN twice USING (r, g)) GROUP BY r),
m AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
  FROM f LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
s AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {_bucket(k, '//')} AS bucket, CAST(count(*) AS HUGEINT) AS n FROM b WHERE NOT base_failed GROUP BY ALL" for k in MEASURES)}),
a AS (SELECT measure, bucket, sum(n) AS n FROM s GROUP BY ALL),
l0 AS (SELECT measure, lang, bucket, sum(n) AS n FROM s GROUP BY ALL),
l AS (
  SELECT measure, lang, bucket, sum(n) AS n FROM (
    SELECT measure, lang, bucket, n * total AS n FROM l0 JOIN (SELECT measure, sum(n) AS total FROM a GROUP BY ALL) USING (measure)
    UNION ALL SELECT measure, lang, bucket, n * {PRIOR} FROM (SELECT DISTINCT measure, lang FROM l0) JOIN a USING (measure)) GROUP BY ALL),
w AS (
  SELECT measure, lang, source, bucket, sum(n) AS n FROM (
    SELECT measure, lang, source, bucket, n * total AS n FROM s JOIN (SELECT measure, lang, sum(n) AS total FROM l GROUP BY ALL) USING (measure, lang)
    UNION ALL SELECT measure, lang, source, bucket, n * {PRIOR} FROM (SELECT DISTINCT measure, lang, source FROM s) JOIN l USING (measure, lang)) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS tot FROM w),
e AS (SELECT lang, source, measure, min(bucket) FILTER (upto * 1000 >= tot * {TAIL}) AS lo, min(bucket) FILTER (upto * 1000 >= tot * {1000 - TAIL}) AS hi FROM c GROUP BY ALL),
t AS (SELECT lang, source, {", ".join(f"max(lo) FILTER (measure = '{k}') AS lo_{k}, max(hi) FILTER (measure = '{k}') AS hi_{k}" for k in MEASURES)} FROM e GROUP BY ALL)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({_outside("//")}, false) AS kept
FROM b LEFT JOIN t USING (lang, source)
"""
}
QUERIES = {"op9_quality_rules": op9_quality_rules}
