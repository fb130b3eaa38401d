"""Neighbour graphs over spots, and spatial statistics on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _cells(df: DataFrame, side: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("cx", F.floor(F.col(x) / side)).withColumn("cy", F.floor(F.col(y) / side))


def _around(df: DataFrame, ring: int) -> DataFrame:
    """A row for each cell within `ring` cells of the own."""
    step = F.sequence(F.lit(-ring), F.lit(ring))
    return df.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy")).drop("dx", "dy")


def _dest(spots: DataFrame, side: float) -> DataFrame:
    return _cells(spots.select(F.col("spot").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2")), side, "x2", "y2")


def _d2() -> Column:
    return (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))


#: cells to a radius, pairs that a task compares at most, about, and partitions at most
FINE, PAIRS, MOST_PARTS = 3, 20_000_000, 20_000


def _deals(spark: SparkSession, pairs: int | None, most: int | None) -> tuple[int, int]:
    """Into how many a key's rows are dealt, and partitions, for so many pairs in all and of one key."""
    return max(1, math.ceil((most or 0) / PAIRS)), min(max(4 * spark.sparkContext.defaultParallelism, math.ceil((pairs or 0) / PAIRS)), MOST_PARTS)


def radius_edges(spots: DataFrame, radius: float) -> DataFrame:
    """(src, dst, d2) of all ordered pairs within the radius: spots meet in the cells around, FINE to a radius.

    The rows are few but their pairs are many, so partitions are counted by the pairs that meet, and a cell's spots are dealt over
    several where they are many.
    """
    side = radius / FINE * (1 + 1e-9)  # a quotient's rounding doesn't lead beyond the cells around
    dest = _dest(spots, side)
    held = dest.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    met = _around(held, FINE).groupBy("cx", "cy").agg(F.sum("n").alias("m")).join(held, ["cx", "cy"])
    pairs, most = met.agg(F.sum(F.col("n") * F.col("m")), F.max(F.col("n") * F.col("m"))).first()
    deals, parts = _deals(spots.sparkSession, pairs, most)
    a = _cells(spots.select(F.col("spot").alias("src"), "x", "y", F.pmod(F.xxhash64("spot"), F.lit(deals)).cast("int").alias("deal")), side)
    far = dest.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    on = ["cx", "cy", "deal"]
    pair = _around(a, FINE).repartition(parts, *on).join(far.repartition(parts, *on).hint("shuffle_hash"), on)
    return pair.select("src", "dst", _d2().alias("d2")).where((F.col("src") != F.col("dst")) & (F.col("d2") <= radius * radius))


def knn_edges(spots: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(src, dst, d2, rank) of the k nearest other spots (ties: the smaller id), exact.

    Spots meet in rings of grid cells; a query is settled when its k-th distance lies within the ring
    searched.  Only unsettled queries are searched again, in twice the ring, so work follows density.
    """
    n, x0, x1, y0, y1 = spots.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    todo = (queries if queries is not None else spots).select(F.col("spot").alias("src"), "x", "y")
    if not n or (n == 1 and queries is None):
        return todo.where("false").select("src", F.col("src").alias("dst"), F.lit(0.0).alias("d2"), F.lit(1).alias("rank"))
    reach = min(k, n - (queries is None))
    side = max(math.sqrt(max(1.0, float(x1 - x0) * float(y1 - y0)) * (reach + 1) / n), 1e-9)
    widest = int(max(x1 - x0, y1 - y0) / side) + 2
    far = _dest(spots, side)
    order = Window.partitionBy("src").orderBy("d2", "dst")
    done, ring = None, 1
    while True:
        pair = _around(_cells(todo, side), ring).join(far, ["cx", "cy"])
        got = pair.where("src <> dst") if queries is None else pair
        got = got.select("src", "x", "y", "dst", _d2().alias("d2")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= reach)
        if ring >= widest:
            out = got.select("src", "dst", "d2", "rank")
            return out if done is None else done.unionByName(out)
        last = Window.partitionBy("src")
        got = got.withColumn("sure", (F.count("*").over(last) == reach) & (F.max("d2").over(last) <= (ring * side) ** 2))
        part = got.where("sure").select("src", "dst", "d2", "rank")
        done = part if done is None else done.unionByName(part)
        todo = todo.join(part.select("src").distinct(), "src", "left_anti")
        if todo.isEmpty():
            return done
        ring = min(ring * 2, widest)


#: points that a task compares with as many others, groups of blocks a side at least, and rows of distances held at a time
BLOCK, LEAST_BLOCKS, ROWS = 8192, 6, 128


def knn_in(points: DataFrame, column: str, k: int) -> DataFrame:
    """knn_edges in a space of any number of dimensions, given as an array column of at least one.

    A block of points is compared with a block at a time and keeps each point's k nearest of that block, of which the k nearest
    of all are taken: work grows with the square of the points, a task's memory doesn't.
    """
    n = points.count()
    p = points.select("spot", F.col(column).cast("array<double>").alias("at"))
    if n < 2:
        return p.where("false").select(F.col("spot").alias("src"), F.col("spot").alias("dst"), F.lit(0.0).alias("d2"), F.lit(1).alias("rank"))
    blocks = max(math.ceil(n / BLOCK), min(LEAST_BLOCKS, math.ceil(n / ROWS)))
    own = p.withColumn("own", F.pmod(F.xxhash64("spot"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = own.select("spot", "at", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"))
    told = own.select("spot", "at", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[~pdf.asks].sort_values("spot")
        out = [pd.DataFrame({"src": [], "dst": [], "d2": []}).astype({"src": "int64", "dst": "int64", "d2": "float64"})]
        if len(a) and len(b):
            x, y, u, v = np.stack(a["at"].to_list()), np.stack(b["at"].to_list()).T.copy(), a.spot.to_numpy(), b.spot.to_numpy()
            for i in range(0, len(x), ROWS):
                d = np.zeros((len(x[i : i + ROWS]), len(v)))
                for c in range(len(y)):
                    off = x[i : i + ROWS, c, None] - y[c]
                    off *= off
                    d += off
                d[u[i : i + ROWS, None] == v] = np.inf
                last = np.partition(d, k - 1, axis=1)[:, k - 1, None] if k < len(v) else np.inf
                row, col = np.nonzero((d <= last) & np.isfinite(d))
                got = d[row, col]
                order = np.lexsort((col, got, row))
                row, col, got = row[order], col[order], got[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(pd.DataFrame({"src": u[i + row[kept]], "dst": v[col[kept]], "d2": got[kept]}))
        return pd.concat(out)

    best = asks.union(told).groupBy("i", "j").applyInPandas(near, "src bigint, dst bigint, d2 double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))).where(F.col("rank") <= k)


def weights(edges: DataFrame, kind: str = "inverse", radius: float | None = None) -> DataFrame:
    """Row-normalised weights: inverse distance, gaussian or uniform."""
    d = F.sqrt(F.col("d2").cast("double"))
    w = {"inverse": 1 / (d + 1e-6), "gaussian": F.exp(-F.col("d2") / (2 * radius * radius if radius else 1)), "uniform": F.lit(1.0)}[kind]
    return edges.select("src", "dst", w.alias("w")).withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src")))


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge both ways once, with weight one over the number at its start."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return both.withColumn("w", 1 / F.count("*").over(Window.partitionBy("src")))


def support(counts: DataFrame, edges: DataFrame, weighted: bool = False) -> DataFrame:
    """For each site and spot with counts, the (weighted) share of its neighbours that have counts too."""
    on = counts.where("count > 0").select("site", "spot")
    w = edges.withColumn("v", F.lit(1.0) if not weighted else 1 / (F.sqrt(F.col("d2").cast("double")) + 1e-6))
    total = w.groupBy("src").agg(F.sum("v").alias("all"))
    near = on.join(w, on.spot == w.src).select("site", "spot", "dst", "v").join(on.select("site", F.col("spot").alias("dst")), ["site", "dst"]).groupBy("site", "spot").agg(F.sum("v").alias("v"))
    return on.join(total, on.spot == total.src).join(near, ["site", "spot"], "left").select("site", "spot", (F.coalesce("v", F.lit(0.0)) / F.col("all")).alias("support"))


def site_support(counts: DataFrame, edges: DataFrame, least: float = 0.3) -> DataFrame:
    """Mean of a site's positive supports (0 if none), and whether that is enough."""
    s = support(counts, edges).groupBy("site").agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("support"))), F.lit(0.0)).alias("score"))
    return s.withColumn("valid", F.round("score", 9) >= least)


def consistent_counts(counts: DataFrame, edges: DataFrame, least: float = 0.3) -> DataFrame:
    s = support(counts, edges)
    return counts.join(s, ["site", "spot"], "left").select("site", "spot", F.when(F.coalesce("support", F.lit(0.0)) >= least, F.col("count")).otherwise(0).alias("count"))


def _centred(values: DataFrame) -> DataFrame:
    return values.withColumn("z", F.col("value") - F.avg("value").over(Window.partitionBy("gene")))


def autocorrelation(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Moran's I and Geary's C by gene on one graph; edges to spots without a value drop out.

    values: (gene, spot, value) not null; edges: (src, dst, w).  Fewer than three values or no variance: null.
    """
    z = _centred(values)
    a = z.select("gene", F.col("spot").alias("src"), F.col("z").alias("zi"))
    b = z.select("gene", F.col("spot").alias("dst"), F.col("z").alias("zj"))
    cross = a.join(edges, "src").join(b, ["gene", "dst"]).groupBy("gene").agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("cross"), F.sum(F.col("w") * F.pow(F.col("zi") - F.col("zj"), 2)).alias("apart"))
    own = z.groupBy("gene").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("ss"))
    ok = (F.col("n") >= 3) & (F.col("ss") > 1e-12) & (F.col("s0") > 0)
    return own.join(cross, "gene", "left").select("gene", "n", F.when(ok, F.col("n") / F.col("s0") * F.col("cross") / F.col("ss")).alias("morans_i"), F.when(ok, (F.col("n") - 1) / (2 * F.col("s0")) * F.col("apart") / F.col("ss")).alias("gearys_c"))


def moran_moments(edges: DataFrame) -> DataFrame:
    """S0, S1, S2 of a weight table, one row."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v"))
    both = edges.join(back, ["src", "dst"], "full_outer")
    s1 = both.agg((F.sum(F.pow(F.coalesce("w", F.lit(0.0)) + F.coalesce("v", F.lit(0.0)), 2)) / 2).alias("s1"))
    sums = edges.select("src", F.col("w")).union(edges.select("dst", "w")).groupBy("src").agg(F.sum("w").alias("t"))
    s2 = sums.agg(F.sum(F.col("t") * F.col("t")).alias("s2"), (F.sum("t") / 2).alias("s0"))
    return s1.crossJoin(s2)


def local_statistics(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(gene, spot, value, n, mean, var_pop) of the values at a spot's neighbours."""
    near = values.select("gene", F.col("spot").alias("dst"), F.col("value").alias("v"))
    m = edges.join(near, "dst").groupBy("gene", F.col("src").alias("spot")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    return values.join(m, ["gene", "spot"], "left")


def fidelity(pred: DataFrame, edges: DataFrame) -> DataFrame:
    """Correlation of prediction and true neighbour mean, both centred within the gene."""
    m = local_statistics(pred.select("gene", "spot", F.col("truth").alias("value")), edges).select("gene", "spot", "mean")
    j = pred.join(m, ["gene", "spot"]).where("mean IS NOT NULL")
    w = Window.partitionBy("gene")
    j = j.withColumn("a", F.col("pred") - F.avg("pred").over(w)).withColumn("b", F.col("mean") - F.avg("mean").over(w)).withColumn("k", F.count("*").over(w)).where("k >= 2")
    return j.agg(F.when((F.stddev_pop("a") > 1e-12) & (F.stddev_pop("b") > 1e-12), F.corr("a", "b")).otherwise(0.0).alias("fidelity"))


def smooth_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One synchronous majority vote: a spot takes its neighbours' label if over half agree (ties: the smaller)."""
    near = edges.join(labels.select(F.col("spot").alias("dst"), F.col("label").alias("l")), "dst").groupBy("src", "l").agg(F.count("*").alias("k"))
    top = near.groupBy("src").agg(F.sum("k").alias("all"), F.min(F.struct((-F.col("k")).alias("minus"), "l")).alias("t"))
    moved = top.where(-F.col("t.minus") * 2 > F.col("all")).select(F.col("src").alias("spot"), F.col("t.l").alias("to"))
    return labels.join(moved, "spot", "left").select("spot", F.coalesce("to", "label").alias("label"))


def rbf_graph(edges: DataFrame) -> DataFrame:
    """exp(-d^2 / 2 s^2) with s the median distance, made symmetric by the larger: (a, b, w), a < b."""
    s = edges.where("d2 > 0").agg(F.percentile(F.sqrt("d2"), F.lit(0.5)).alias("s"))
    w = edges.crossJoin(F.broadcast(s)).withColumn("w", F.exp(-F.col("d2") / (2 * F.col("s") * F.col("s"))))
    return w.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("w"))


def laplacian(graph: DataFrame, normalized: bool = False) -> DataFrame:
    """Entries (i, j, v) of D - W, or of I - D^-1/2 W D^-1/2, from undirected (a, b, w)."""
    both = graph.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").union(graph.select(F.col("b").alias("i"), F.col("a").alias("j"), "w"))
    d = both.groupBy("i").agg(F.sum("w").alias("d"))
    if not normalized:
        return both.select("i", "j", (-F.col("w")).alias("v")).union(d.select("i", F.col("i").alias("j"), "d"))
    off = both.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j").select("i", "j", (-F.col("w") / F.sqrt(F.col("d") * F.col("dj"))).alias("v"))
    return off.union(d.select("i", F.col("i").alias("j"), F.lit(1.0)))


def lift_graph(parents: DataFrame, children: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Parent edges (a, b, w) on all pairs of their children (spot, parent), by w / sqrt(na nb): (i, j, w), and with near (spot, near), maps, what i's has for j as `own`.

    The pairs are many, so a parent's children are dealt over several tasks, by their number.
    """
    size = children.groupBy("parent").agg(F.count("*").alias("k"))
    at = lambda s: size.select(F.col("parent").alias(s), F.col("k").alias(f"k{s}"))
    edges = parents.select("a", "b", "w").join(at("a"), "a").join(at("b"), "b")
    deals, parts = _deals(children.sparkSession, *edges.agg(F.sum(F.col("ka") * F.col("kb")), F.max(F.col("ka") * F.col("kb"))).first())
    left = edges.select("a", "b", (F.col("w") / F.sqrt((F.col("ka") * F.col("kb")).cast("double"))).alias("w")).join(children.select(F.col("spot").alias("i"), F.col("parent").alias("a")), "a")
    left = left.withColumn("deal", F.pmod(F.xxhash64("i"), F.lit(deals)).cast("int"))
    if near is not None:
        left = left.join(near.select(F.col("spot").alias("i"), "near"), "i", "left")
    right = edges.select("a", "b").join(children.select(F.col("spot").alias("j"), F.col("parent").alias("b")), "b").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    on = ["a", "b", "deal"]
    pair = left.repartition(parts, *on).join(right.repartition(parts, *on).hint("shuffle_hash"), on)
    return pair.select("i", "j", "w", *([] if near is None else [F.try_element_at("near", F.col("j")).alias("own")]))


def uncertain_moran(values: DataFrame, edges: DataFrame, least: int = 10) -> DataFrame:
    """Moran's I in which a value counts by the inverse of its uncertainty: (gene, n, morans_i, expected_i).

    values: (gene, spot, value, std); edges: (src, dst).  Weights 1 / (std + 1e-10) sum to one for a gene, each
    spot's neighbours with a value share a weight of one, and the cross products are divided by the weighted
    variance.  Genes with fewer than `least` values are left out; without variance the index is 0.
    """
    own = Window.partitionBy("gene")
    a = values.where("value IS NOT NULL AND std IS NOT NULL").withColumn("a", 1 / (F.col("std") + 1e-10))
    a = a.withColumn("n", F.count("*").over(own)).where(F.col("n") >= least).withColumn("a", F.col("a") / F.sum("a").over(own))
    z = a.withColumn("z", F.col("value") - F.sum(F.col("a") * F.col("value")).over(own)).select("gene", "spot", "n", "a", "z")
    near = z.select("gene", F.col("spot").alias("dst"), (F.col("a") * F.col("z")).alias("far"))
    pair = z.select("gene", F.col("spot").alias("src"), (F.col("a") * F.col("z")).alias("here")).join(edges.select("src", "dst"), "src").join(near, ["gene", "dst"])
    row = pair.groupBy("gene", "src").agg((F.first("here") * F.avg("far")).alias("c")).groupBy("gene").agg(F.sum("c").alias("c"))
    var = z.groupBy("gene").agg(F.first("n").alias("n"), F.sum(F.col("a") * F.col("z") * F.col("z")).alias("var"))
    i = F.when(F.col("var") < 1e-10, 0.0).otherwise(F.coalesce("c", F.lit(0.0)) / F.col("var"))
    return var.join(row, "gene", "left").select("gene", "n", i.alias("morans_i"), (-1 / (F.col("n") - 1)).alias("expected_i"))


def sparse_moran(counts: DataFrame, edges: DataFrame, spots: DataFrame) -> DataFrame:
    """(site, n, morans_i): Moran's I of a site's counts over all spots, those without a count at 0, on uniform weights.

    Only positive counts are joined: the zeros enter through the sums of counts, squares and weights.  Null without variance.
    """
    w = weights(edges.select("src", "dst", "d2"), "uniform")
    n = spots.agg(F.count("*").alias("n"))
    s0 = w.agg(F.sum("w").alias("s0"))
    degree = w.select(F.col("src").alias("spot"), "w").union(w.select("dst", "w")).groupBy("spot").agg(F.sum("w").alias("deg"))
    on = counts.where("count > 0").select("site", "spot", F.col("count").cast("double").alias("c"))
    far = on.select("site", F.col("spot").alias("dst"), F.col("c").alias("c2"))
    cross = on.join(w, on.spot == w.src).join(far, ["site", "dst"]).groupBy("site").agg(F.sum(F.col("w") * F.col("c") * F.col("c2")).alias("a"))
    own = on.join(degree, "spot", "left").groupBy("site").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.sum(F.col("c") * F.coalesce("deg", F.lit(0.0))).alias("b"))
    j = own.join(cross, "site", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(s0)).withColumn("m", F.col("s") / F.col("n"))
    ss = F.col("q") - F.col("n") * F.col("m") * F.col("m")
    top = F.coalesce("a", F.lit(0.0)) - F.col("m") * F.col("b") + F.col("m") * F.col("m") * F.col("s0")
    return j.select("site", "n", F.when((ss > 1e-9) & (F.col("s0") > 0), F.col("n") / F.col("s0") * top / ss).alias("morans_i"))
