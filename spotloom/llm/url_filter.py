"""URL filters: fixed host rules first, then association rules mined by FP-growth, in DataFrame functions only.

Examples for mining are the pages that `labels` covers (doc_id = page_id; block where a row says toxic or of
low quality); the fixed rules' verdicts are none.  A page's tokens are its host's names, its site, the path's
parts without numbers, the file ending, the names in the query, and marks for query and fragment.  Tokens that
stand in the very same examples are one item for mining, named by the least of them, since k such tokens would
make 2^k combinations that say the same.  FP-growth gives the frequent combinations; rules "tokens -> block" or
"-> allow" stay if confident and frequent enough, if their confidence is above the verdict's share of all
examples, and if no rule with one token less is as confident.

Matching uses an inverted index from token to rules: each distinct set of tokens is looked up token by token,
and a rule matches when as many of its tokens were met as it has.  Sets stand for all pages that share them,
so a host with a third of all pages is one row.  The most confident rule gives the verdict (then the more
frequent, then the longer, then block); without any, allow.

Defined results: null URLs, and those without ://, have an empty host and path and no token, and are
allowed; URLs may be of any length; without examples of both kinds no rule is mined; null labels say nothing;
repeated rows give a row each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.llm.common import Scratch, table

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SUPPORT = 0.005
CONFIDENCE = 0.9
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, _URL, 1), UPPER, LOW), F.regexp_extract(u, _URL, 2)


def fixed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The sorted distinct tokens of a URL."""
    host, path = parts(url)
    u = F.coalesce(url, F.lit(""))
    names = F.split(host, r"\.")
    tail = F.regexp_extract(u, r"://[^?#]*(\?[^#]*)?(#.*)?", 1)
    plain = lambda x: F.regexp_replace(x, "[0-9]+", "")
    lists = [
        F.transform(names, lambda x: F.concat(F.lit("host="), x)),
        F.array(F.concat(F.lit("site="), F.array_join(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), 2), "."))),
        F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path="), plain(F.regexp_replace(x, r"\..*$", "")))),
        F.array(F.concat(F.lit("ending="), F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))),
        F.transform(F.split(F.regexp_replace(tail, r"^\?", ""), "&"), lambda x: F.concat(F.lit("query="), plain(F.regexp_extract(x, "^([^=]*)", 1)))),
        F.array(F.when(F.regexp_extract(u, r"://[^#]*(#.*)", 1) != "", F.lit("fragment=any")).otherwise(F.lit("fragment="))),
    ]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.filter(F.concat(*lists), lambda x: ~x.endswith("=")))))


def folded(sets: DataFrame) -> DataFrame:
    """(tokens, label) of which each group of tokens that stand in the same rows keeps its least one."""
    rows = sets.withColumn("at", F.monotonically_increasing_id())
    each = rows.select("at", F.explode("tokens").alias("token"))
    where = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("at")).alias("x"), F.sum(F.xxhash64("at", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    least = where.groupBy("n", "x", "s").agg(F.min("token").alias("token")).select("token")
    kept = each.join(least, "token").groupBy("at").agg(F.array_sort(F.collect_list("token")).alias("kept"))
    return rows.join(kept, "at").select(F.col("kept").alias("tokens"), "label")


def examples(pages: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Item sets to mine: tokens and the label item."""
    by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit("block")).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), F.lit("allow"))).alias("said"))
    got = pages.join(by_id, "page_id").select("tokens", F.col("said").alias("label"))
    return folded(scratch.save(got.where("label is not null and size(tokens) > 0"))).select(F.concat("tokens", F.array(F.concat(F.lit("label="), "label"))).alias("items"))


def mine(items: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule, tokens, verdict, confidence, support), pruned."""
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).associationRules
    said = F.col("consequent")[0]
    plain = F.forall("antecedent", lambda x: ~x.startswith("label="))
    rules = found.where(plain & said.startswith("label=") & (F.col("lift") > 1.001)).select(F.array_sort("antecedent").alias("tokens"), F.substring(said, 7, 99).alias("verdict"), "confidence", "support")
    less = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("out")).where("size(tokens) > 1").select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("out")).alias("fewer"))
    short = rules.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("as_confident"))
    idle = less.join(short, ["fewer", "verdict"]).where("as_confident >= confidence").select("tokens", "verdict").distinct()
    return rules.join(idle, ["tokens", "verdict"], "left_anti").withColumn("rule", F.concat_ws(" ", "tokens"))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, learned) for the token sets that some rule matches."""
    index = rules.select(F.explode("tokens").alias("token"), "rule", "verdict", "confidence", "support", F.size("tokens").alias("size"))
    met = sets.select("key", F.explode("tokens").alias("token")).join(index, "token").groupBy("key", "rule", "verdict", "confidence", "support", "size").agg(F.count("*").alias("n"))
    best = F.max(F.struct("confidence", "support", "size", "verdict", "rule"))
    return met.where("n = size").groupBy("key").agg(best.alias("best")).select("key", F.col("best.verdict").alias("learned"), F.col("best.rule").alias("learned_rule"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule with its confidence where that decided."""
    scratch = Scratch(pages.sparkSession)
    host, path = parts(F.col("url"))
    src = pages.select("page_id", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("tokens"))
    src = scratch.save(src.withColumn("fixed", fixed(F.col("host"), F.col("path"))).withColumn("key", F.concat_ws(" ", "tokens")))
    rules = scratch.save(mine(examples(src, labels, scratch), support, confidence))
    sets = src.where("fixed is null and size(tokens) > 0").groupBy("key").agg(F.first("tokens").alias("tokens"))
    # written, so that the join below stands alone and the planner can split the partition of a hot set of tokens
    out = src.join(scratch.save(match(sets, rules)), "key", "left")
    learned = lambda c: F.when(F.col("fixed").isNull(), F.col(c))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "learned", F.lit("allow")).alias("verdict"), learned("learned_rule").alias("learned_rule"), learned("confidence").alias("confidence"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_url_filter": op3_url_filter}
SQL: dict[str, str] = {}
