"""Sites as intervals: filters, overlap and nearest joins, islands.

Range joins are equi-joins on (chr, strand, bin): each interval is listed under the bins it touches, and a
pair counts only in its first common bin, so no pair is seen twice and no cross join arises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def properties(a: DataFrame) -> DataFrame:
    return a.select("*", (F.col("e") - F.col("s")).alias("length"), F.floor((F.col("s") + F.col("e")) / 2).alias("middle"))


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(s2 - e1, s1 - e2, F.lit(0))


def next_distance(sites: DataFrame, keys: list[str]) -> DataFrame:
    """sites with the next one on the same keys (by start, end, id) and the gap between the two; null for the last."""
    w = Window.partitionBy(*keys).orderBy("s", "e", "site")
    return sites.select("*", F.lead("site").over(w).alias("next_site"), gap(F.col("s"), F.col("e"), F.lead("s").over(w), F.lead("e").over(w)).alias("distance")).withColumn("distance", F.when(F.col("next_site").isNotNull(), F.col("distance")))


def _bins(df: DataFrame, size: int, s: str, e: str) -> DataFrame:
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(s) / size), F.floor((F.col(e) - 1) / size))))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], size: int = 512) -> DataFrame:
    """Pairs of half-open intervals a [s, e) and b [bs, be) that overlap, on equal keys."""
    pair = _bins(a, size, "s", "e").join(_bins(b, size, "bs", "be"), [*keys, "bin"])
    first = F.greatest(F.floor(F.col("s") / size), F.floor(F.col("bs") / size)) == F.col("bin")
    return pair.where(first & (F.col("s") < F.col("be")) & (F.col("bs") < F.col("e"))).drop("bin")


def smallest_containing(points: DataFrame, genes: DataFrame, keys: list[str], size: int = 4096) -> DataFrame:
    """For each point (site, pos) the narrowest [gs, ge] that holds it (ties: start, id); null if none."""
    p = points.withColumn("bin", F.floor(F.col("pos") / size))
    g = genes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("gs") / size), F.floor(F.col("ge") / size))))
    hit = p.join(g, [*keys, "bin"]).where("pos >= gs AND pos <= ge")
    best = hit.groupBy("site").agg(F.min_by("gid", F.struct(F.col("ge") - F.col("gs"), "gs", "gid")).alias("gid"))
    return points.select("site").join(best, "site", "left")


def nearest(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """For each (id, pos) of a the distance to the nearest pos of b, by a sort of both sides up and one down.

    A frame that ends with the partition would be scanned anew from every row, so both frames begin with it.
    """
    u = a.select(*keys, "pos", "id", F.lit(1).alias("side")).unionByName(b.select(*keys, "pos", F.lit(None).cast("bigint").alias("id"), F.lit(0).alias("side")))
    mine = F.when(F.col("side") == 0, F.col("pos"))
    upto = lambda c: F.last(mine, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(c).rangeBetween(Window.unboundedPreceding, 0))
    below, above = upto(F.asc("pos")), upto(F.desc("pos"))
    return u.withColumn("below", below).withColumn("above", above).where("side = 1").select("id", F.least(F.col("pos") - F.col("below"), F.col("above") - F.col("pos")).alias("distance"))


def islands(df: DataFrame, keys: list[str], s: str, e: str, reach: int, tie: str) -> DataFrame:
    """df with the number of its island: a row starts one if it begins over `reach` after all before it end."""
    w = Window.partitionBy(*keys).orderBy(s, e, tie)
    end = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("brk", F.when(end.isNull() | (F.col(s) - end > reach), 1).otherwise(0)).withColumn("island", F.sum("brk").over(w)).drop("brk")


def merge(sites: DataFrame, reach: int = 10) -> DataFrame:
    """Islands as sites: least start, greatest end, greatest support, all reads, first gene along the order."""
    i = islands(sites, ["chr", "strand"], "s", "e", reach, "site")
    return i.groupBy("chr", "strand", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.coalesce("support", F.lit(0.0))).alias("support"), F.sum(F.coalesce("reads", F.lit(0))).alias("reads"), F.min_by("gene", F.struct("s", "e", "site")).alias("gene"), F.count("*").alias("n")).drop("island")


def consensus(sites: DataFrame, sample: str, reach: int = 50) -> DataFrame:
    """Islands over several samples, with their samples, members and most common gene (ties: the smaller)."""
    i = islands(sites, ["chr", "strand"], "s", "e", reach, "site")
    by = ["chr", "strand", "island"]
    top = i.groupBy(*by, "gene").agg(F.count("*").alias("k")).groupBy(*by).agg(F.min_by("gene", F.struct(-F.col("k"), "gene")).alias("gene"))
    return i.groupBy(*by).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count_distinct(sample).alias("n_samples"), F.count("*").alias("n_sites"), F.array_join(F.array_sort(F.collect_list(F.col("site").cast("string"))), ",").alias("members")).join(top, by).drop("island")


def cluster_overlap(points: DataFrame, caller: str, reach: int = 50) -> DataFrame:
    """1-D single linkage of two callers' positions: clusters shared and own, and the Jaccard index."""
    w = Window.partitionBy("chr", "strand").orderBy("pos", "site")
    c = points.withColumn("k", F.sum(F.when(F.col("pos") - F.lag("pos").over(w) > reach, 1).otherwise(0)).over(w))
    g = c.groupBy("chr", "strand", "k").agg(F.bool_or(F.col(caller) == 0).alias("a"), F.bool_or(F.col(caller) == 1).alias("b"))
    n = lambda cond: F.count_if(cond)
    return g.agg(n(F.col("a") & F.col("b")).alias("shared"), n(F.col("a") & ~F.col("b")).alias("a_only"), n(~F.col("a") & F.col("b")).alias("b_only"), (n(F.col("a") & F.col("b")) / F.count("*")).alias("jaccard"))


def segments(sites: DataFrame) -> DataFrame:
    """Proximal and distal site of a gene along its strand, and the region between them."""
    plus = F.col("strand") == "+"
    return sites.groupBy("gene", "chr", "strand").agg(F.count("*").alias("n"), F.min("coord").alias("lo"), F.max("coord").alias("hi")).where("n >= 2").select("gene", "chr", "strand", F.when(plus, F.col("lo")).otherwise(F.col("hi")).alias("proximal"), F.when(plus, F.col("hi")).otherwise(F.col("lo")).alias("distal"), "lo", "hi")


def annotate(points: DataFrame, genes: DataFrame, key: str = "chr", flank: int = 5000, size: int = 4096) -> DataFrame:
    """For each point (site, key, strand, pos) the gene that holds it, else the nearest on the key: (site, gid, gap, tier).

    Of genes equally near, one of the point's strand comes first, then the least id.  tier is inside, near (a
    gap up to flank), far, or null where the key has no gene.  Nearest ends come from sorts of points and
    ends, up and down; only genes that end or start right there are joined.
    """
    ends = genes.select(key, F.col("ge").alias("at"), F.lit(-1).alias("end")).union(genes.select(key, F.col("gs").alias("at"), F.lit(1).alias("end"))).distinct()
    u = points.select(key, F.col("pos").alias("at"), F.lit(0).alias("end"), "site").unionByName(ends, allowMissingColumns=True)
    upto = lambda side, c: F.last(F.when(F.col("end") == side, F.col("at")), ignorenulls=True).over(Window.partitionBy(key).orderBy(c).rangeBetween(Window.unboundedPreceding, 0))
    below, above = upto(-1, F.asc("at")), upto(1, F.desc("at"))
    found = u.select(key, "site", "end", "at", below.alias("below"), above.alias("above")).where("end = 0").select("site", F.least(F.col("at") - F.col("below"), F.col("above") - F.col("at")).alias("gap"))
    p = points.join(found, "site")
    left = p.withColumn("there", F.col("pos") - F.col("gap")).join(genes.select(key, "gid", F.col("strand").alias("gstrand"), F.col("ge").alias("there")), [key, "there"])
    right = p.withColumn("there", F.col("pos") + F.col("gap")).join(genes.select(key, "gid", F.col("strand").alias("gstrand"), F.col("gs").alias("there")), [key, "there"])
    binned = genes.select(key, "gid", F.col("strand").alias("gstrand"), "gs", "ge", F.explode(F.sequence(F.floor(F.col("gs") / size), F.floor(F.col("ge") / size))).alias("bin"))
    inside = points.withColumn("bin", F.floor(F.col("pos") / size)).join(binned, [key, "bin"]).where("pos >= gs AND pos <= ge").withColumn("gap", F.lit(0).cast("bigint"))
    cols = ["site", F.col("gap").cast("bigint").alias("gap"), "gid", (F.col("strand") != F.col("gstrand")).alias("other")]
    best = inside.select(*cols).union(left.select(*cols)).union(right.select(*cols)).groupBy("site").agg(F.min(F.struct("gap", "other", "gid")).alias("b"))
    tier = F.when(F.col("b.gap") == 0, "inside").when(F.col("b.gap") <= flank, "near").when(F.col("b").isNotNull(), "far")
    return points.select("site").join(best, "site", "left").select("site", F.col("b.gid").alias("gid"), F.col("b.gap").alias("gap"), tier.alias("tier"))
