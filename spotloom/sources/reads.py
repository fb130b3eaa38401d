"""Aligned reads as rows: (chr, start, cigar, flag), start from 0; the CIGAR string is taken apart inside each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.functions.cigar import spans

#: flag bits of reads that are no primary alignment: unmapped, secondary, supplementary
NOT_PRIMARY = 0x4 | 0x100 | 0x800
ANCHOR = 10


def primary(reads: DataFrame) -> DataFrame:
    return reads.where(F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(NOT_PRIMARY) == 0)


def nuclear(chr_: Column) -> Column:
    """Whole chromosomes: named chr..., without chrM, chrEBV and names with an underscore or a dot."""
    return F.coalesce(chr_.startswith("chr") & ~chr_.isin("chrM", "chrEBV") & ~chr_.contains("_") & ~chr_.contains("."), F.lit(False))


def junctions(reads: DataFrame, least: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(chr, s, e, *by, count): introns (operation N) of primary reads on whole chromosomes, found `least` times or more.

    An intron counts once for each read and each time the read has it.  Nothing but introns leaves the scan, and they are
    summed before they are shuffled.  Reads without a place or CIGAR have none.
    """
    n = primary(reads).where(nuclear(F.col("chr"))).select("chr", *by, F.explode(spans(F.col("start"), F.col("cigar"), "N")).alias("i"))
    n = n.groupBy("chr", F.col("i.s").alias("s"), F.col("i.e").alias("e"), *by).agg(F.count("*").alias("count"))
    return n.where((F.col("count") >= least) & F.col("s").isNotNull())


def junction_lines(found: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """(chr, s, e, line): BED lines of twelve fields, a block of `anchor` bases at either side of the intron."""
    s, e = F.col("s") - anchor, F.col("e") + anchor
    line = F.concat_ws("\t", "chr", s, e, F.lit("junc"), "count", F.lit("."), s, e, F.lit("0"), F.lit("2"), F.lit(f"{anchor},{anchor}"), F.concat(F.lit("0,"), (F.col("e") - F.col("s") + anchor).cast("string")))
    return found.select("chr", "s", "e", line.alias("line"))


def coverage(reads: DataFrame, regions: DataFrame, barcodes: DataFrame | None = None) -> DataFrame:
    """(region, pos, depth) of every place of each region (region, chr, s, e): primary reads with a base there (operations M, = and X).

    With barcodes (cb), only their reads count.  Reads and regions meet in bins of 1,000 bases, and only places of
    regions become rows.
    """
    r = primary(reads)
    if barcodes is not None:
        r = r.join(barcodes.select("cb").distinct(), "cb")
    part = r.select(F.col("chr").alias("c"), F.explode(spans(F.col("start"), F.col("cigar"), "M=X")).alias("i")).select("c", F.col("i.s").alias("rs"), F.col("i.e").alias("re"))
    bin_ = lambda a, b: F.explode(F.sequence(F.floor(a / 1000), F.floor((b - 1) / 1000)))
    left = part.where("rs < re").select("*", bin_(F.col("rs"), F.col("re")).alias("bin"))
    right = regions.where("s < e").select("region", F.col("chr").alias("c"), "s", "e", bin_(F.col("s"), F.col("e")).alias("bin"))
    both = left.join(right, ["c", "bin"]).where("rs < e AND s < re")
    # a pair counts in the first bin that both have
    both = both.where(F.col("bin") == F.greatest(F.floor(F.col("rs") / 1000), F.floor(F.col("s") / 1000)))
    on = both.select("region", F.explode(F.sequence(F.greatest("rs", "s"), F.least("re", "e") - 1)).alias("pos")).groupBy("region", "pos").agg(F.count("*").alias("depth"))
    places = regions.where("s < e").select("region", F.explode(F.sequence("s", F.col("e") - 1)).alias("pos"))
    return places.join(on, ["region", "pos"], "left").select("region", "pos", F.coalesce("depth", F.lit(0)).alias("depth"))
