"""Masks of held-out cells for judging imputers: six kinds, all by hashed numbers, so a seed always gives the same mask."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.hashed import exponential
from spotloom.operators.lineage import cut

#: rows that are put in order in one task at most, and slices that a range of keys is cut into
FEW, SLICES = 4096, 256
#: shares of the radii, and sector widths, that a ring sector is tried with until it holds enough
BANDS, WIDTHS = ((0.2, 0.8), (0.1, 0.9), (0.0, 1.0)), (math.pi / 2, 2 * math.pi / 3, math.pi)
KINDS = ("random", "spatial_block", "spatial_block_large", "ring_sector", "layer_aware", "low_coverage")


def least(df: DataFrame, key: str, ids: list[str], target: int, weight: str | None = None) -> DataFrame:
    """The rows in order of (key, ids) up to that with which their weights (1 each) reach the target.

    The range of keys is cut into slices and only the sums of the slice that holds the target matter further, until few
    rows are left in it; those alone are put in order.  Any number of rows equal in key is put in order by ids in one task.
    """
    w = F.col(weight) if weight else F.lit(1)
    lo, before = None, 0
    part = df = cut(df)  # every pass reads it
    while True:
        n, a, b = part.agg(F.count("*"), F.min(key), F.max(key)).first()
        if n <= FEW or a == b:
            break
        width = (b - a) / SLICES
        slice_ = F.least(F.floor((F.col(key) - a) / width), F.lit(SLICES - 1)).cast("int")
        sums = sorted((r.at, r.w, r.lo, r.hi) for r in part.groupBy(slice_.alias("at")).agg(F.sum(w).alias("w"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect())
        for i, (_, more, first, last) in enumerate(sums):
            if before + more >= target or i == len(sums) - 1:
                break
            before += more
        lo = first
        part = df.where((F.col(key) >= first) & (F.col(key) <= last))
    upto = F.sum(w).over(Window.orderBy(key, *ids).rowsBetween(Window.unboundedPreceding, -1))  # over few rows
    edge = part.withColumn("__before", F.coalesce(upto, F.lit(0)) + before).where(F.col("__before") < target).drop("__before")
    return edge if lo is None else df.where(F.col(key) < lo).unionByName(edge)


def _spots(observed: DataFrame, spots: DataFrame) -> DataFrame:
    n = observed.groupBy("spot").agg(F.count("*").alias("n"))
    return spots.select("spot", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(n, "spot", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _block(observed: DataFrame, spots: DataFrame, target: int, salt: str) -> DataFrame:
    """Spots nearest to one that is drawn by its observed cells, until they have enough."""
    s = _spots(observed, spots)
    centre = s.where("n > 0").orderBy(exponential("spot", salt=f"{salt}/centre", weight=F.col("n")), "spot").first()
    d = F.sqrt(F.pow(F.col("x") - centre.x, 2) + F.pow(F.col("y") - centre.y, 2))
    return least(s.withColumn("d", d), "d", ["spot"], target, "n").select("spot")


def _sector(observed: DataFrame, spots: DataFrame, target: int, salt: str) -> DataFrame:
    """Spots of a sector between two radii around the middle; the first of the bands and widths with enough observed cells, else the widest."""
    s = _spots(observed, spots)
    mx, my = s.agg(F.avg("x"), F.avg("y")).first()
    dx, dy = F.col("x") - mx, F.col("y") - my
    s = s.select("spot", "n", F.sqrt(dx * dx + dy * dy).alias("r"), F.atan2(dy, dx).alias("t"))
    theta = direction(salt)
    turned = F.col("t") - theta + math.pi
    off = F.abs(turned - 2 * math.pi * F.floor(turned / (2 * math.pi)) - math.pi)
    shares = sorted({x for band in BANDS for x in band})
    edge = dict(zip(shares, s.agg(F.percentile("r", F.array(*[F.lit(x) for x in shares])).alias("q")).first().q))
    tries = [(F.col("r") >= edge[a]) & (F.col("r") <= edge[b]) & (off <= w / 2) for a, b in BANDS for w in WIDTHS]
    held = s.agg(*[F.sum(F.when(t, F.col("n")).otherwise(0)) for t in tries]).first()
    return s.where(next((t for t, n in zip(tries, held) if n >= target), tries[-1])).select("spot")


def direction(salt: str) -> float:
    import hashlib

    return 2 * math.pi * (int(hashlib.md5(f"{salt}/direction".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48) - math.pi


def _layers(observed: DataFrame, spots: DataFrame, layer: str, target: int, salt: str) -> DataFrame:
    """Spots of a layer drawn by its observed cells, and of the larger of its neighbours in the order of mean radius, until they have enough.  Layers are few."""
    s = _spots(observed, spots).join(spots.select("spot", F.col(layer).alias("layer")), "spot")
    mx, my = s.agg(F.avg("x"), F.avg("y")).first()
    r = F.sqrt(F.pow(F.col("x") - mx, 2) + F.pow(F.col("y") - my, 2))
    rows = s.groupBy("layer").agg(F.avg(r).alias("r"), F.sum("n").alias("n")).withColumn("key", F.when(F.col("n") > 0, exponential("layer", salt=f"{salt}/layer", weight=F.col("n")))).collect()
    order = sorted(rows, key=lambda x: (x.r, x.layer))
    at = min((i for i, x in enumerate(order) if x.n), key=lambda i: order[i].key)
    lo = hi = at
    while sum(x.n for x in order[lo : hi + 1]) < target and (lo > 0 or hi < len(order) - 1):
        left, right = (order[lo - 1].n if lo else -1), (order[hi + 1].n if hi < len(order) - 1 else -1)
        lo, hi = (lo - 1, hi) if left >= right else (lo, hi + 1)
    return s.where(F.col("layer").isin([x.layer for x in order[lo : hi + 1]])).select("spot")


def mask(kind: str, usage: DataFrame, spots: DataFrame, share: float, seed: int = 42, layer: str = "domain") -> DataFrame:
    """(gene, spot) of the observed cells to hold out: `share` of them, one at least.

    random: from all.  spatial_block: from the spots around a drawn one that together have as many observed cells as are held out,
    spatial_block_large: twice as many.  ring_sector: from a sector between two radii.  layer_aware: from a layer
    and its neighbours.  low_coverage: from all, cells of seldom observed genes rather.  Without observed cells: none.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    seen = usage.where("value IS NOT NULL").select("gene", "spot")
    total = seen.count()
    if not total:
        return seen
    target, salt = max(1, int(total * share)), f"{kind}/{seed}"
    if kind == "low_coverage":
        w = F.lit(1.0) / F.count("*").over(Window.partitionBy("gene"))
        keyed = seen.withColumn("w", w).withColumn("key", exponential("gene", "spot", salt=salt, weight=F.col("w"))).drop("w")
    else:
        from_ = {
            "random": lambda: None,
            "spatial_block": lambda: _block(seen, spots, target, salt),
            "spatial_block_large": lambda: _block(seen, spots, 2 * target, salt),
            "ring_sector": lambda: _sector(seen, spots, target, salt),
            "layer_aware": lambda: _layers(seen, spots, layer, target, salt),
        }[kind]()
        keyed = (seen if from_ is None else seen.join(from_, "spot")).select("gene", "spot", exponential("gene", "spot", salt=salt).alias("key"))
    return least(keyed, "key", ["gene", "spot"], target).select("gene", "spot")
