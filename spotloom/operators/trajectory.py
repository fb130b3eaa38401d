"""Usage along a path over the slide: path, pseudospace, curves, turns, ranking and classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.operators import geometry, graph

#: decades of the penalty's weight
DECADES = (-10.0, 8.0)


def basis(x: np.ndarray, pieces: int, degree: int = 3) -> np.ndarray:
    """B-splines on [0, 1] with evenly spaced knots at the places x: len(x) x (pieces + degree)."""
    knots = np.arange(-degree, pieces + degree + 1) / pieces
    b = ((x[:, None] >= knots[:-1]) & (x[:, None] < knots[1:])).astype(float)
    for k in range(1, degree + 1):
        left = (x[:, None] - knots[: -k - 1]) / (knots[k:-1] - knots[: -k - 1])
        right = (knots[k + 1 :] - x[:, None]) / (knots[k + 1 :] - knots[1:-k])
        b = left * b[:, :-1] + right * b[:, 1:]
    return b


def penalised(y: np.ndarray, near: float) -> np.ndarray:
    """Smooth curves, one a row, on evenly spaced places, from values that may be nan.

    Of the cubic splines, with a knot a bin, that miss the values by a sum of squares of at most `near`, that of least second differences of its
    coefficients; the penalty's weight is halved in on for all rows at once.  Where even the straight line is near enough, it is the line.
    """
    bins = y.shape[1]
    b = basis((np.arange(bins) + 0.5) / bins, bins)
    curve = np.diff(np.eye(b.shape[1]), 2, axis=0)
    seen = np.isfinite(y)
    v, w = np.where(seen, y, 0.0), seen.astype(float)
    gram, right = np.einsum("gb,bi,bj->gij", w, b, b), v @ b
    lo, hi = np.full(len(y), DECADES[0]), np.full(len(y), DECADES[1])

    def fitted(decade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = gram + 10.0 ** decade[:, None, None] * (curve.T @ curve) + 1e-12 * np.eye(b.shape[1])
        f = np.linalg.solve(a, right[..., None])[..., 0] @ b.T
        return f, (w * (f - v) ** 2).sum(1)

    line, off = fitted(hi)
    for _ in range(50):
        mid = (lo + hi) / 2
        far = fitted(mid)[1] > near
        lo, hi = np.where(far, lo, mid), np.where(far, mid, hi)
    return np.where((off <= near)[:, None], line, fitted(lo)[0])


def smoothed(curves: DataFrame, bins: int, method: str = "spline", near: float = 0.1, share: float = 0.4) -> DataFrame:
    """(gene, bin, m): curves (gene, bin, m) smoothed, with a value in every bin, held within 0 and 1; under four bins they stay.

    spline: penalised(); lowess: local lines over a share of the bins, straight between and beyond bins.
    """
    if method not in ("spline", "lowess"):
        raise ValueError("method must be spline or lowess")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = np.full((len(pdf), bins), np.nan)
            for g, points in enumerate(pdf.points):
                for p in points:
                    y[g, p["bin"]] = p["m"]
            enough = np.isfinite(y).sum(1) >= 4
            if enough.any() and method == "spline":
                y[enough] = np.clip(penalised(y[enough], near), 0, 1)
            elif method == "lowess":
                for g in np.flatnonzero(enough):
                    at = np.flatnonzero(np.isfinite(y[g]))
                    f = geometry.lowess((at + 0.5) / bins, y[g, at], share)
                    x = np.arange(bins)
                    y[g] = np.interp(x, at, f)
                    y[g, : at[0]] = f[0] + (x[: at[0]] - at[0]) * (f[1] - f[0]) / (at[1] - at[0])
                    y[g, at[-1] + 1 :] = f[-1] + (x[at[-1] + 1 :] - at[-1]) * (f[-1] - f[-2]) / (at[-1] - at[-2])
                y[enough] = np.clip(y[enough], 0, 1)
            i, j = np.nonzero(np.isfinite(y))
            yield pd.DataFrame({"gene": pdf.gene.to_numpy()[i], "bin": j, "m": y[i, j]})

    points = curves.groupBy("gene").agg(F.collect_list(F.struct(F.col("bin").cast("int").alias("bin"), F.col("m").cast("double").alias("m"))).alias("points"))
    return points.mapInPandas(fit, f"gene {curves.schema['gene'].dataType.simpleString()}, bin bigint, m double")


def nearest_spot(spots: DataFrame, x: float, y: float) -> int:
    row = spots.orderBy((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y), "spot").select("spot").first()
    if row is None:
        raise ValueError("no spots")
    return row.spot


def analyse(usage: DataFrame, spots: DataFrame, edges: DataFrame, start: tuple[float, float], end: tuple[float, float], bins: int = 20, method: str | None = None) -> dict[str, DataFrame]:
    """path, curves, switches, ranked and classes along the shortest path between the spots nearest to two places.

    A path spot's p is its share of the path's length; a curve is the mean value by bin of p, smoothed if a method of
    smoothed() is named.  A bin is a switch where the
    sign of the curve's gradient changes.  Genes rank by the variance of their curve, ties by id.  A curve of under three
    bins is stable, of two or more switches a switch, else increasing or decreasing by its correlation with the bin
    beyond 0.5.  Where no path leads from start to end all tables are empty.
    """
    both = edges.select("src", "dst", "d2").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d2")).distinct()
    walk = graph.shortest_path(both, nearest_spot(spots, *start), nearest_spot(spots, *end), spots=spots).join(spots.select("spot", "x", "y"), "spot")
    by = Window.orderBy("seq")  # one row a spot of the path
    sq = lambda c: F.pow(F.col(c) - F.lag(c).over(by), 2)
    path = walk.withColumn("d", F.coalesce(F.sqrt(sq("x") + sq("y")), F.lit(0.0))).withColumn("c", F.sum("d").over(by))
    path = path.select("seq", "spot", F.coalesce(F.try_divide("c", F.sum("d").over(Window.partitionBy())), F.lit(0.0)).alias("p"))
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("bigint")
    curves = usage.where("value IS NOT NULL").join(path, "spot").groupBy("gene", place.alias("bin")).agg(F.avg("value").alias("m"))
    if method:
        curves = smoothed(curves, bins, method)
    g = Window.partitionBy("gene").orderBy("bin")
    before, after = F.lag("m").over(g), F.lead("m").over(g)
    slope = F.when(before.isNull(), after - F.col("m")).when(after.isNull(), F.col("m") - before).otherwise((after - before) / 2)
    turned = curves.withColumn("slope", F.round(slope, 7)).withColumn("turned", F.coalesce(F.signum("slope") != F.signum(F.lag("slope").over(g)), F.lit(False)))
    r = F.round(F.try_divide(F.covar_pop("bin", "m"), F.stddev_pop("bin") * F.stddev_pop("m")), 6)  # null for a flat curve
    kind = F.when(F.count("*") < 3, "stable").when(F.count_if("turned") >= 2, "switch").when(r > 0.5, "increasing").when(r < -0.5, "decreasing").otherwise("stable")
    ranked = turned.groupBy("gene").agg(F.var_pop("m").alias("variance"), (F.max("m") - F.min("m")).alias("reach"))
    return {
        "path": path,
        "curves": curves,
        "switches": turned.where("turned").select("gene", "bin"),
        "ranked": ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("variance").desc(), "gene"))),
        "classes": turned.groupBy("gene").agg(kind.alias("class")),
    }
