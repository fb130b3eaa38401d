"""Low-rank factors of the usage table that are smooth on a graph of the spots.

Factors are tables of an id and k columns f0, f1, ...; all sums over cells are plain aggregates, combined before
they are shuffled, so neither a gene nor a spot has to fit in a task.  Only k x k matrices reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.operators import spatial
from spotloom.operators.lineage import cut, cut_and_count, drop


#: a graph of no more entries (24 bytes each) is smoothed by the driver
DRIVER_ENTRIES = 500_000


def _names(k: int) -> list[str]:
    return [f"f{i}" for i in range(k)]


def _times(data: DataFrame, factors: DataFrame, by: str, other: str, k: int) -> DataFrame:
    return data.join(factors.withColumnRenamed("id", other), other).groupBy(F.col(by).alias("id")).agg(*[F.sum(F.col("c") * F.col(f)).alias(f) for f in _names(k)])


def _orthonormal(factors: DataFrame, k: int) -> DataFrame:
    f = [F.col(n) for n in _names(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = factors.agg(*[F.sum(f[i] * f[j]) for i, j in pairs]).first()
    gram = np.zeros((k, k))
    for (i, j), s in zip(pairs, sums):
        gram[i, j] = gram[j, i] = s or 0.0
    w, v = np.linalg.eigh(gram)
    mix = (v / np.sqrt(np.maximum(w, 1e-12 * max(w.max(), 1e-300))))[:, ::-1]
    return factors.select("id", *[sum(f[j] * float(mix[j, i]) for j in range(k)).alias(n) for i, n in enumerate(_names(k))])


def _first_factors(data: DataFrame, k: int, rounds: int, seed: int) -> DataFrame:
    """Leading singular vectors over the spots by subspace iteration from hashed numbers; missing cells are at their gene's mean."""
    start = [((F.pmod(F.xxhash64("id", F.lit(i), F.lit(seed)), F.lit(20001)) - 10000) / 10000.0).alias(n) for i, n in enumerate(_names(k))]
    z = data.select(F.col("spot").alias("id")).distinct().select("id", *start)
    for _ in range(rounds):
        g = _times(data, z, "gene", "spot", k)
        z = _orthonormal(cut(_times(data, g, "spot", "gene", k)), k)
    return z


def _sums(data: DataFrame, factors: DataFrame, by: str, other: str, k: int) -> DataFrame:
    """The normal equations of every id: s (upper triangle), t (right side) and q (weighted squares)."""
    f, w = [F.col(n) for n in _names(k)], F.col("weight")
    s = [F.sum(w * f[i] * f[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    t = [F.sum(w * F.col("v") * f[i]).alias(f"t{i}") for i in range(k)]
    return data.join(factors.withColumnRenamed("id", other), other).groupBy(F.col(by).alias("id")).agg(*s, *t, F.sum(w * F.col("v") * F.col("v")).alias("q"), F.sum(w).alias("n"))


def _solved(sums: DataFrame, k: int, ridge: float) -> DataFrame:
    names = _names(k)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = np.zeros((len(pdf), k, k))
            for i in range(k):
                for j in range(i, k):
                    a[:, i, j] = a[:, j, i] = pdf[f"s{i}_{j}"].to_numpy(float)
            t = np.stack([pdf[f"t{i}"].to_numpy(float) for i in range(k)], axis=1)
            x = np.linalg.solve(a + ridge * np.eye(k), t[..., None])[..., 0] if len(pdf) else t
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), **{n: x[:, i] for i, n in enumerate(names)}})

    return sums.mapInPandas(solve, "id bigint, " + ", ".join(f"{n} double" for n in names))


def _series(strength: float, error: float) -> list[float]:
    """Coefficients of a polynomial in S that is (I + strength (I + S))^-1 up to the error; S has its eigenvalues in [-1, 1]."""
    a = (1 + strength) / strength
    degree = max(2, math.ceil(math.log(1 / error) / math.log(a + math.sqrt(a * a - 1))))
    series = np.polynomial.Chebyshev.interpolate(lambda s: 1 / (1 + strength * (1 + s)), degree, domain=[-1, 1])
    return [float(x) for x in series.convert(kind=np.polynomial.Polynomial).coef]


def smooth(factors: DataFrame, steps: DataFrame, strength: float, k: int, error: float = 1e-5, driver_entries: int = DRIVER_ENTRIES, here: pd.DataFrame | None = None) -> DataFrame:
    """(I + strength L)^-1 on every factor column, L = I + S the normalised Laplacian, S given as entries (i, j, v).

    The inverse is a polynomial in S whose degree follows from the strength and the error alone.  By Horner's rule
    each step is one join and one aggregate; a graph of at most `driver_entries` entries is worked out by the driver,
    with the same polynomial, from `here`, all entries, if they are there already.  Isolated spots keep their factors.
    """
    c, names = _series(strength, error), _names(k)
    if here is not None:
        return _smooth_here(factors, here, c, names)
    if driver_entries and len(few := _entries(steps.limit(driver_entries + 1))) <= driver_entries:
        return _smooth_here(factors, few, c, names)
    linked = steps.select(F.col("i").alias("id")).distinct()
    b, alone = factors.join(linked, "id", "left_semi"), factors.join(linked, "id", "left_anti")
    part = lambda x: b.select("id", *[(F.col(n) * x).alias(n) for n in names])
    y = part(c[-1])
    for x in reversed(c[:-1]):
        moved = steps.join(y.withColumnRenamed("id", "j"), "j").select(F.col("i").alias("id"), *[(F.col("v") * F.col(n)).alias(n) for n in names])
        y = moved.union(part(x)).groupBy("id").agg(*[F.sum(n).alias(n) for n in names])
    return y.union(alone)


def _entries(steps: DataFrame) -> pd.DataFrame:
    return steps.toArrow().to_pandas()


def _smooth_here(factors: DataFrame, steps: pd.DataFrame, c: list[float], names: list[str]) -> DataFrame:
    ids = np.unique(steps.i.to_numpy(np.int64))
    spark = factors.sparkSession
    linked = spark.createDataFrame(pa.table({"id": ids}))
    own = factors.join(F.broadcast(linked), "id", "left_semi").toArrow().to_pandas()
    b = np.zeros((len(ids), len(names)))
    b[np.searchsorted(ids, own["id"].to_numpy(np.int64))] = own[names].to_numpy(float)
    i, j, v = np.searchsorted(ids, steps.i.to_numpy(np.int64)), np.searchsorted(ids, steps.j.to_numpy(np.int64)), steps.v.to_numpy(float)
    y = c[-1] * b
    for x in reversed(c[:-1]):
        y = x * b + np.stack([np.bincount(i, v * y[j, f], len(ids)) for f in range(len(names))], axis=1)
    done = spark.createDataFrame(pa.table({"id": ids, **{n: y[:, f] for f, n in enumerate(names)}}))
    return done.union(factors.join(F.broadcast(linked), "id", "left_anti").select("id", *names))


def factorize(usage: DataFrame, graph: DataFrame | None = None, rank: int = 8, strength: float = 1.0, ridge: float = 1e-2, max_iter: int = 50, tol: float = 1e-4, seed: int = 42, weight: str | None = None) -> DataFrame:
    """(gene, spot, imputed) by alternating weighted ridge regressions, the spots' factors smoothed on the graph each round.

    usage: (gene, spot, value, null where missing) with an optional weight column; graph: undirected (a, b, w).
    Rounds end when the weighted root mean square error changes by less than `tol` of itself, or at `max_iter`.
    Observed values stay.  A gene without any value gives 0, and so does a spot without any value or neighbour.
    """
    usage = cut(usage)  # read for the sums and for the result
    seen = usage.where("value IS NOT NULL")
    seen = seen.select("gene", "spot", F.col("value").alias("v"), (F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0)).alias("weight"))
    data = cut(seen.withColumn("c", F.col("v") - F.avg("v").over(Window.partitionBy("gene"))))
    steps = here = None
    if graph is not None and strength > 0:
        steps, got = cut_and_count(spatial.laplacian(graph, normalized=True).where("i <> j"), n=F.count("*"))
        # once: every round smooths by the same entries
        here = _entries(steps) if got["n"] <= DRIVER_ENTRIES else None
    z, genes, last = cut(_first_factors(data, rank, 5, seed)), None, math.inf
    f = _names(rank)
    for _ in range(max_iter):
        before = [t for t in (genes, z) if t is not None]
        genes = cut(_solved(_sums(data, z, "gene", "spot", rank), rank, ridge))
        sums = cut(_sums(data, genes, "spot", "gene", rank))
        raw = _solved(sums, rank, ridge)
        if steps is None:
            z = cut(raw)
        else:
            rough = cut(raw)
            z = cut(smooth(rough, steps, strength, rank, driver_entries=0, here=here))
            drop(rough)
        square = sum((1 if i == j else 2) * F.col(f"s{i}_{j}") * F.col(f[i]) * F.col(f[j]) for i in range(rank) for j in range(i, rank))
        off = F.col("q") - 2 * sum(F.col(f"t{i}") * F.col(f[i]) for i in range(rank)) + square
        got = sums.join(z, "id").agg(F.sum(off).alias("e"), F.sum("n").alias("n")).first()
        drop(sums, *before)
        error = math.sqrt(max(got.e or 0.0, 0.0) / max(got.n or 0.0, 1.0))
        if math.isfinite(last) and abs(last - error) / max(last, 1e-8) < tol:
            break
        last = error
    g = genes.select(F.col("id").alias("gene"), *[F.col(n).alias(f"g{i}") for i, n in enumerate(f)])
    s = z.withColumnRenamed("id", "spot")
    dot = sum(F.col(f"g{i}") * F.col(n) for i, n in enumerate(f))
    return usage.join(g, "gene", "left").join(s, "spot", "left").select("gene", "spot", F.coalesce("value", dot, F.lit(0.0)).alias("imputed"))
