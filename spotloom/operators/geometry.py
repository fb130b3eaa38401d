"""Triangulation and smoothing of one slide or curve at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: points between two looks for triangles that are done
SWEEP = 16


def triangles(pts: np.ndarray) -> set[tuple[int, int, int]]:
    """Delaunay triangles of distinct points, by insertion into a covering triangle.

    Points come from left to right, so a triangle whose circle lies to the left of the point is done: it is looked at no more.
    """
    n = len(pts)
    if n < 3:
        return set()
    mid, span = pts.mean(0), float(np.ptp(pts, axis=0).max()) or 1.0
    p = np.vstack([(pts - mid) / span, [[-50, -40], [50, -40], [0, 60]]])
    live: dict[tuple[int, int, int], tuple[float, float, float]] = {}
    done: set[tuple[int, int, int]] = set()

    def put(t: tuple[int, int, int]) -> None:
        (ax, ay), (bx, by), (cx, cy) = p[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-14:
            return
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
        live[t] = (ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2)

    put((n, n + 1, n + 2))
    for seen, i in enumerate(np.lexsort((p[:n, 1], p[:n, 0]))):
        x, y = p[i].tolist()
        bad = [t for t, (ux, uy, r) in live.items() if (x - ux) ** 2 + (y - uy) ** 2 < r * (1 - 1e-12)]
        if not seen % SWEEP:
            past = [t for t, (ux, _, r) in live.items() if x > ux and (x - ux) ** 2 >= r]
            done.update(t for t in past if t[2] < n)
            for t in past:
                del live[t]
        edges: dict[tuple[int, int], int] = {}
        for t in bad:
            del live[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                e = (min(e), max(e))
                edges[e] = edges.get(e, 0) + 1
        for (a, b), k in edges.items():
            if k == 1:
                put(tuple(sorted((a, b, int(i)))))
    return done | {t for t in live if t[2] < n}


def delaunay_edges(spots: DataFrame, by: str) -> DataFrame:
    """(src, dst, d2) of each slide's triangulation, both ways.  A slide is one group: spots of a slide are bounded by its array."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["x", "y"]).sort_values("spot").reset_index(drop=True)
        at, ids = pdf[["x", "y"]].to_numpy(float), pdf.spot.to_numpy()
        pairs = {(a, b) for t in triangles(at) for a in t for b in t if a != b}
        rows = sorted((int(ids[a]), int(ids[b]), float(((at[a] - at[b]) ** 2).sum())) for a, b in pairs)
        return pd.DataFrame(rows, columns=["src", "dst", "d2"]).astype({"src": "int64", "dst": "int64", "d2": "float64"})

    return spots.select(by, "spot", "x", "y").groupBy(by).applyInPandas(build, "src bigint, dst bigint, d2 double")


def lowess(x: np.ndarray, y: np.ndarray, share: float = 0.4) -> np.ndarray:
    """Locally weighted lines with tricube weights over the nearest share of the points."""
    k = max(2, min(len(x), int(np.ceil(share * len(x)))))
    out = np.empty(len(x))
    for i, at in enumerate(x):
        d = np.abs(x - at)
        h = max(np.sort(d)[k - 1], 1e-12) * 1.000001
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        m, v = np.average(x, weights=w), np.average(y, weights=w)
        s = (w * (x - m) ** 2).sum()
        out[i] = v + ((w * (x - m) * (y - v)).sum() / s if s > 1e-18 else 0.0) * (at - m)
    return out


def smooth_curves(curves: DataFrame, share: float = 0.4) -> DataFrame:
    """(gene, domain, bin, m, smooth): smoothed to [0, 1] where a curve has four bins or more."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin").reset_index(drop=True)
        y = pdf.m.to_numpy(float)
        pdf["smooth"] = np.clip(lowess(pdf.bin.to_numpy(float), y, share), 0, 1) if len(y) >= 4 else y
        return pdf[["gene", "domain", "bin", "m", "smooth"]]

    return curves.groupBy("gene", "domain").applyInPandas(fit, "gene bigint, domain int, bin bigint, m double, smooth double")


def binomial_band(df: DataFrame, n: str, p: float) -> DataFrame:
    """df with the central 95 % of a Binomial(n, p) as shares lo, hi; one row a sample."""

    def band(batches):
        for b in batches:
            lo, hi = [], []
            for k in b[n].astype(int):
                i = np.arange(k + 1)
                lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, k + 1)))]) if k else np.zeros(1)
                c = np.cumsum(np.exp(lf[k] - lf[i] - lf[k - i] + i * np.log(p) + (k - i) * np.log1p(-p)))
                lo.append(float(np.searchsorted(c, 0.025) / k) if k else None)
                hi.append(float(np.searchsorted(c, 0.975) / k) if k else None)
            yield b.assign(lo=lo, hi=hi)

    return df.mapInPandas(band, T.StructType([*df.schema.fields, T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
