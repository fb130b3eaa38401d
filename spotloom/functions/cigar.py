"""CIGAR strings taken apart inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: operations that move along the reference
MOVES = "MDN=X"


def operations(cigar: Column) -> Column:
    """array of (op, n) of a CIGAR string; null or `*`: empty."""
    of = lambda k: F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(k))
    return F.zip_with(of(1), of(2), lambda n, op: F.struct(op.alias("op"), n.cast("long").alias("n")))


def spans(start: Column, cigar: Column, ops: str) -> Column:
    """array of (s, e), half open: where on the reference the operations named lie.  Reads have few operations, so they are walked in the row."""
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    step = lambda a, o: F.struct(
        (a["at"] + F.when(o["op"].isin(*MOVES), o["n"]).otherwise(0)).alias("at"),
        F.when(o["op"].isin(*ops), F.concat(a["got"], F.array(F.struct(a["at"].alias("s"), (a["at"] + o["n"]).alias("e"))))).otherwise(a["got"]).alias("got"),
    )
    return F.aggregate(operations(cigar), F.struct(start.cast("long").alias("at"), empty.alias("got")), step, lambda a: a["got"])
