"""Filling missing cells, batch correction, and per-gene numerics on grouped vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.operators import likelihood
from spotloom.operators.lineage import cut, cut_and_count, drop

#: rows that a gene's task estimates at a time, at least
ROWS = 1024


def by_gene(usage: DataFrame, how: str = "mean") -> DataFrame:
    w = Window.partitionBy("gene")
    fill = F.avg("value").over(w) if how == "mean" else F.percentile("value", F.lit(0.5)).over(w)
    return usage.withColumn("imputed", F.coalesce("value", fill))


def by_neighbours(usage: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean of the observed values at the neighbours, else the gene's mean; observed values stay."""
    near = usage.where("value IS NOT NULL").select("gene", F.col("spot").alias("dst"), F.col("value").alias("v"))
    m = edges.join(near, "dst").groupBy("gene", F.col("src").alias("spot")).agg(F.avg("v").alias("m"))
    return usage.join(m, ["gene", "spot"], "left").withColumn("imputed", F.coalesce("value", "m", F.avg("value").over(Window.partitionBy("gene")))).drop("m")


def sparse_gp(usage: DataFrame, spots: DataFrame, inducing: np.ndarray, length: float, noise: float = 0.1) -> DataFrame:
    """FITC-style Gaussian process by gene: mean and std at every spot; observed values stay, with std 0.

    One group a gene; the spots' coordinates are part of each group, so nothing is broadcast.
    """
    z, ell, s2 = np.asarray(inducing, float), float(length), float(noise) ** 2

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * ell * ell))

    kmm = kernel(z, z) + 1e-6 * np.eye(len(z))
    inverse = np.linalg.inv(kmm)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("spot").reset_index(drop=True)
        at = pdf[["x", "y"]].to_numpy(float)
        y = pdf.value.to_numpy(float)
        seen = np.isfinite(y)
        k = kernel(at, z)
        q = np.einsum("ij,jk,ik->i", k, inverse, k)
        mean, var = np.zeros(len(y)), 1 - q + s2
        if seen.any():
            weight = 1 / (1 - q[seen] + s2)
            kn = k[seen]
            mean = k @ np.linalg.solve(kmm + (kn * weight[:, None]).T @ kn, kn.T @ (weight * y[seen]))
        out = pdf[["gene", "spot"]].copy()
        out["imputed"] = np.where(seen, y, mean)
        out["std"] = np.where(seen, 0.0, np.sqrt(np.maximum(var, 0)))
        return out

    return usage.join(spots.select("spot", "x", "y"), "spot").groupBy("gene").applyInPandas(fit, "gene bigint, spot bigint, imputed double, std double")


def likelihood_ratio(usage: DataFrame, spots: DataFrame, lengths: list[float]) -> DataFrame:
    """White noise against C k(x) + noise, by gene: the likelihood's best over a grid of lengths and variance shares, p = exp(-LR / 2).

    A group is a gene and a length.  Where the places span few lengths, work and memory are linear in the spots (see likelihood.Places);
    elsewhere a factorisation for each share is cheaper than one decomposition for all, and holds four matrices at a time.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("spot")
        y = pdf.value.to_numpy(float)
        n, k = len(y), int(pdf.k.iloc[0])
        lr, share, best_l = 0.0, 0.0, None
        if n >= 10 and y.std() > 1e-12:
            y = (y - y.mean()) / y.std()
            at = pdf[["x", "y"]].to_numpy(float)
            null = -0.5 * n * (np.log(2 * np.pi) + 1)
            process = likelihood.Places(at, y)
            for s in (0.1, 0.25, 0.5, 0.75, 0.9):
                ll = process.value(lengths[k], (1 - s) / s)  # s from the kernel, the rest from the noise
                if 2 * (ll - null) > lr:
                    lr, share, best_l = 2 * (ll - null), s, lengths[k]
        return pd.DataFrame([(pdf.gene.iloc[0], -k, n, lr, float(np.exp(-lr / 2)), share, best_l)], columns=["gene", "turn", "n", "lr", "p", "share", "length"])

    rows = usage.where("value IS NOT NULL").join(spots.select("spot", "x", "y"), "spot").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(lengths) - 1))))
    # few rows but much work: a number of partitions that the planner leaves as it is
    rows = rows.repartition(4 * usage.sparkSession.sparkContext.defaultParallelism, "gene", "k")
    each = rows.groupBy("gene", "k").applyInPandas(fit, "gene bigint, turn int, n bigint, lr double, p double, share double, length double")
    return each.groupBy("gene").agg(F.max(F.struct("lr", "turn", "n", "p", "share", "length")).alias("b")).select("gene", "b.n", "b.lr", "b.p", "b.share", "b.length")


def permutation_p(usage: DataFrame, edges: DataFrame, n_perm: int = 99, seed: int = 42) -> DataFrame:
    """Moran's I by gene with p = (1 + #{permuted >= observed}) / (n_perm + 1); seeded by gene."""
    near = usage.where("value IS NOT NULL").select("gene", F.col("spot"), "value")
    rows = near.join(edges.groupBy(F.col("src").alias("spot")).agg(F.collect_list(F.struct("dst", "w")).alias("near")), "spot")

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("spot")
        gene, spot, y = t["gene"][0].as_py(), t["spot"].to_numpy(), t["value"].to_numpy().astype(float)
        # flat columns: an object for each edge takes more than a worker has
        edge = pc.list_flatten(t["near"])
        dst, w = pc.struct_field(edge, "dst").to_numpy(), pc.struct_field(edge, "w").to_numpy()
        i, j = np.repeat(np.arange(len(spot)), pc.list_value_length(t["near"]).to_numpy()), np.searchsorted(spot, dst)
        known = spot[np.minimum(j, len(spot) - 1)] == dst
        i, j, w = i[known], j[known], w[known]
        z = y - y.mean()
        ss, seen, p = float(z @ z), None, 1.0
        if len(z) >= 3 and ss > 1e-12 and len(w):
            value = lambda v: len(v) / w.sum() * float((w * v[i]) @ v[j]) / ss
            rng = np.random.default_rng([seed, gene])
            seen = value(z)
            p = (1 + sum(value(rng.permutation(z)) >= seen for _ in range(n_perm))) / (n_perm + 1)
        return pa.table({"gene": pa.array([gene], pa.int64()), "n": pa.array([len(z)], pa.int64()), "morans_i": pa.array([seen], pa.float64()), "p": pa.array([p], pa.float64())})

    return rows.groupBy("gene").applyInArrow(fit, "gene bigint, n bigint, morans_i double, p double")


def two_batch_correction(values: DataFrame) -> DataFrame:
    """Per gene: the second batch moves by the difference of batch means (least squares of one batch term)."""
    w = Window.partitionBy("gene")
    a, b = (F.avg(F.when(F.col("batch") == i, F.col("value"))).over(w) for i in (0, 1))
    return values.withColumn("corrected", F.when(F.col("batch") == 1, F.col("value") - F.coalesce(b - a, F.lit(0.0))).otherwise(F.col("value")))


def quantile_normalize(values: DataFrame) -> DataFrame:
    """Each batch's values on the gene's pooled quantiles: ranks at (r + 0.5) / n, linear between, flat beyond the ends; batches under two stay."""
    g = Window.partitionBy("gene")
    pooled = values.select("gene", (F.row_number().over(g.orderBy("value", "spot")) - 1).alias("j"), F.col("value").alias("ref"), F.count("*").over(g).alias("m"))
    own = Window.partitionBy("gene", "batch")
    v = values.withColumn("nb", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("value", "spot")) - 1).withColumn("m", F.count("*").over(g))
    v = v.withColumn("at", F.least(F.greatest((F.col("r") + 0.5) / F.col("nb") * F.col("m") - 0.5, F.lit(0.0)), (F.col("m") - 1).cast("double")))
    v = v.withColumn("j0", F.floor("at")).withColumn("j1", F.ceil("at"))
    lo = pooled.select("gene", F.col("j").alias("j0"), F.col("ref").alias("lo"))
    hi = pooled.select("gene", F.col("j").alias("j1"), F.col("ref").alias("hi"))
    j = v.join(lo, ["gene", "j0"]).join(hi, ["gene", "j1"])
    return j.select("gene", "spot", "batch", "value", F.when(F.col("nb") < 2, F.col("value")).otherwise(F.col("lo") + (F.col("at") - F.col("j0")) * (F.col("hi") - F.col("lo"))).alias("normalized"))


def exact_gp(usage: DataFrame, spots: DataFrame, lengths: list[float], noises: list[float], nu: float | None = 1.5, seek: bool = False) -> DataFrame:
    """Exact Gaussian process by gene, Matern (nu 0.5, 1.5, 2.5) or RBF (None): the length and noise of greatest likelihood on a grid.

    With `seek`, they are sought from the best of the grid on, the amplitude as well.  Values are standardised; observed values stay, with std 0.  A gene needs two observed values, else its rows stay null.
    Memory grows with the square of a gene's observed spots; the others are estimated some at a time.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("spot").reset_index(drop=True)
        at, y = pdf[["x", "y"]].to_numpy(float), pdf.value.to_numpy(float)
        seen = np.isfinite(y)
        out = pdf[["gene", "spot"]].copy()
        out["imputed"], out["std"] = y, np.where(seen, 0.0, np.nan)
        if seen.sum() < 2:
            return out
        mu, sd = y[seen].mean(), y[seen].std() or 1.0
        t, own = (y[seen] - mu) / sd, at[seen]
        d = likelihood.apart(own, own)
        best, size, sides = None, 1.0, [(ell, noises) for ell in lengths]
        if seek:
            _, ell, s2 = likelihood.search(d, t, lengths, noises, nu)
            sides = [(ell, [s2])]
            size = max(float(t @ np.linalg.solve(likelihood.shape(d, ell, nu)[0] + s2 * np.eye(len(t)), t)) / len(t), 1e-300)
        for ell, tried in sides:
            k = likelihood.shape(d, ell, nu)[0]
            for s2 in tried:
                low = np.linalg.cholesky(k + (s2 + 1e-9) * np.eye(len(t)))
                a = likelihood.forward(low, t)
                ll = -0.5 * a @ a - np.log(np.diag(low)).sum()
                if best is None or ll > best[0]:
                    best = (ll, ell, low, a)
        _, ell, low, a = best
        rest, step = np.flatnonzero(~seen), max(ROWS, len(t))
        for i in range(0, len(rest), step):
            j = rest[i : i + step]
            v = likelihood.forward(low, likelihood.shape(likelihood.apart(own, at[j]), ell, nu)[0])
            out.loc[j, "imputed"] = mu + sd * (v.T @ a)
            out.loc[j, "std"] = sd * np.sqrt(np.maximum(size * (1 - (v * v).sum(0)), 0))
        return out

    return usage.join(spots.select("spot", "x", "y"), "spot").groupBy("gene").applyInPandas(fit, "gene bigint, spot bigint, imputed double, std double")


def block_gp(usage: DataFrame, spots: DataFrame, side: float, lengths: list[float], noises: list[float], overlap: float = 0.25) -> DataFrame:
    """exact_gp by gene and square block; blocks reach `overlap` of their side into their neighbours, and estimates are averaged."""
    reach = side * overlap
    cut = lambda c: F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))
    placed = spots.select("spot", "x", "y", F.explode(cut("x")).alias("bx")).select("*", F.explode(cut("y")).alias("by"))
    ids = placed.select("bx", "by").distinct().select("bx", "by", F.xxhash64("bx", "by").alias("block"))
    rows = usage.join(placed, "spot").join(ids, ["bx", "by"]).withColumn("key", F.xxhash64("gene", "block"))
    keys = rows.select("key", F.col("gene").alias("of")).distinct()
    got = exact_gp(rows.select(F.col("key").alias("gene"), "spot", "value"), spots, lengths, noises).join(keys, F.col("gene") == F.col("key"))
    return got.groupBy(F.col("of").alias("gene"), "spot").agg(F.avg("imputed").alias("imputed"), F.avg("std").alias("std"))


def neighbour_passes(usage: DataFrame, edges: DataFrame, passes: int = 3) -> DataFrame:
    """Missing values take the mean of their neighbours' values, pass by pass, until none is filled; then the gene's mean."""
    now, left = usage.select("gene", "spot", F.col("value").alias("filled")), None
    if passes > 1:
        now, edges = cut(now), cut(edges.select("src", "dst"))
    before = now
    for _ in range(passes):
        near = now.where("filled IS NOT NULL").select("gene", F.col("spot").alias("dst"), F.col("filled").alias("v"))
        m = edges.join(near, "dst").groupBy("gene", F.col("src").alias("spot")).agg(F.avg("v").alias("m"))
        now = now.join(m, ["gene", "spot"], "left").select("gene", "spot", F.coalesce("filled", "m").alias("filled"))
        if passes > 1:
            filled, got = cut_and_count(now, missing=F.count_if(F.col("filled").isNull()))
            drop(before)
            before = now = filled
            if got["missing"] in (0, left):
                break
            left = got["missing"]
    return now.select("gene", "spot", F.coalesce("filled", F.avg("filled").over(Window.partitionBy("gene"))).alias("imputed"))


def variance_parts(usage: DataFrame, spots: DataFrame, lengths: list[float], noises: list[float], least: int = 10) -> DataFrame:
    """(gene, n, total, spatial, random, share, r2, length, noise): how much of a gene's variance an exact Gaussian process of the places explains.

    Values are centred; length and noise of greatest likelihood, given the best amplitude, are sought from the best of the grid.
    spatial is the variance of the fitted values, random the mean squared residual.  Genes of fewer than `least`
    values give nulls, and so does the share without variance; r2 is then 0.  Work and memory are linear in the spots
    where they span few lengths (see likelihood.Places); a search that comes to short lengths makes the matrix of all pairs.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("spot")
        y, n = pdf.value.to_numpy(float), len(pdf)
        row = [pdf.gene.iloc[0], n, None, None, None, None, None, None, None]
        if n >= least:
            t, total = y - y.mean(), float(y.var())
            row[2:7] = [total, 0.0, total, None, 0.0]
            if total > 1e-12:
                process = likelihood.Places(pdf[["x", "y"]].to_numpy(float), t)
                _, ell, noise = likelihood.climb(process, lengths, noises)
                fitted = process.fitted(ell, noise)
                rest, own = float(((t - fitted) ** 2).mean()), float(fitted.var())
                row[2:] = [total, own, rest, own / total, 1 - rest / total, float(ell), float(noise)]
        return pd.DataFrame([row], columns=["gene", "n", "total", "spatial", "random", "share", "r2", "length", "noise"])

    rows = usage.where("value IS NOT NULL").join(spots.select("spot", "x", "y"), "spot")
    # few rows but much work: a number of partitions that the planner leaves as it is
    rows = rows.repartition(4 * usage.sparkSession.sparkContext.defaultParallelism, "gene")
    return rows.groupBy("gene").applyInPandas(fit, "gene bigint, n bigint, total double, spatial double, random double, share double, r2 double, length double, noise double")


def nearest(at: np.ndarray, k: int, most: int = 2_000_000) -> np.ndarray:
    """Of each of the points (n x 2) the k < n nearest others, the smaller number first of equally near ones: n x k.

    Points meet in rings of grid cells, as in spatial.knn_edges, `most` pairs at a time.
    """
    n, low = len(at), at.min(0)
    wide = at.max(0) - low
    side = max(float(np.sqrt(max(1.0, wide[0] * wide[1]) * (k + 1) / n)), 1e-9)
    cell = np.floor((at - low) / side).astype(np.int64)
    high = int(cell[:, 1].max()) + 1
    code = cell[:, 0] * high + cell[:, 1]
    order = np.argsort(code, kind="stable")
    filed, out, todo, ring, widest = code[order], np.empty((n, k), np.int64), np.arange(n), 1, int(wide.max() / side) + 2
    while len(todo):
        steps = np.arange(-ring, ring + 1)
        left = []
        for part in np.array_split(todo, max(1, len(todo) * (2 * ring + 1) // most)):
            column = (cell[part, 0, None] + steps) * high
            lo = np.searchsorted(filed, column + np.maximum(cell[part, 1, None] - ring, 0))
            hi = np.searchsorted(filed, column + np.minimum(cell[part, 1, None] + ring, high - 1), side="right")
            total = np.cumsum((hi - lo).sum(1))
            for few in np.split(np.arange(len(part)), np.unique(np.searchsorted(total, np.arange(most, total[-1], most)))):
                if not len(few):
                    continue
                length = (hi[few] - lo[few]).ravel()
                first = np.repeat(lo[few].ravel() - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
                other = order[first + np.arange(len(first))]
                row = np.repeat(np.arange(len(few)), (hi[few] - lo[few]).sum(1))
                own = part[few][row]
                row, other, own = row[other != own], other[other != own], own[other != own]
                d2 = ((at[own] - at[other]) ** 2).sum(1)
                sort = np.lexsort((other, d2, row))
                row, other, d2 = row[sort], other[sort], d2[sort]
                begin = np.searchsorted(row, np.arange(len(few)))
                count = np.diff(np.append(begin, len(row)))
                sure = count >= k
                sure[sure] = (d2[begin[sure] + k - 1] <= (ring * side) ** 2) | (ring >= widest)
                out[part[few[sure]]] = other[begin[sure, None] + np.arange(k)]
                left.append(part[few[~sure]])
        todo, ring = np.concatenate(left), min(ring * 2, widest)
    return out


def local_noise(usage: DataFrame, spots: DataFrame, k: int = 8, scale: float = 1000.0, least: float = 1e-3) -> DataFrame:
    """(gene, n, noise): (1.4826 x median distance of a value from the median of its k nearest observed values)^2 x scale.

    Neighbours are the gene's other observed spots, ties by the smaller id; under four values the variance takes the
    square's place.  A spot is compared with those of the cells around alone.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("spot").reset_index(drop=True)
        y, at, n = pdf.value.to_numpy(float), pdf[["x", "y"]].to_numpy(float), len(pdf)
        if n < 4:
            noise = float(y.var()) * scale
        else:
            off = np.abs(y - np.median(y[nearest(at, min(k, n - 1))], axis=1))
            noise = (1.4826 * float(np.median(off))) ** 2 * scale
        return pd.DataFrame([(pdf.gene.iloc[0], n, max(noise, least))], columns=["gene", "n", "noise"])

    rows = usage.where("value IS NOT NULL").join(spots.select("spot", "x", "y"), "spot")
    # few rows but much work: a number of partitions that the planner leaves as it is
    return rows.repartition(4 * usage.sparkSession.sparkContext.defaultParallelism, "gene").groupBy("gene").applyInPandas(fit, "gene bigint, n bigint, noise double")


def loo_residuals(usage: DataFrame, spots: DataFrame, length: float, noise: float = 0.1) -> DataFrame:
    """(gene, spot, value, residual): a value less what a Gaussian process (RBF) of the gene's other values says there.

    In closed form from one factorisation a gene: the weights over the diagonal of the inverse.  Values are centred on
    the gene's mean of all its values.  A gene of under two values gives residuals of 0.  Where the places span few lengths,
    the kernel is a product of few columns up to rounding, and work and memory are linear in the spots (see likelihood.columns).
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("spot").reset_index(drop=True)
        at, y = pdf[["x", "y"]].to_numpy(float), pdf.value.to_numpy(float)
        out = pdf[["gene", "spot", "value"]].copy()
        out["residual"] = 0.0
        columns = likelihood.columns(at, length)
        if columns is not None:
            out["residual"] = likelihood.left_out(columns, at, y - y.mean(), noise)
        elif len(y) > 1:
            d2 = likelihood.apart(at, at) ** 2
            inverse = np.linalg.inv(np.exp(-d2 / (2 * length * length)) + noise * np.eye(len(y)))
            out["residual"] = inverse @ (y - y.mean()) / np.diag(inverse)
        return out

    rows = usage.where("value IS NOT NULL").join(spots.select("spot", "x", "y"), "spot")
    return rows.groupBy("gene").applyInPandas(fit, "gene bigint, spot bigint, value double, residual double")


def residual_noise(residuals: DataFrame, edges: DataFrame, cells: DataFrame, scale: float = 1.0, least: float = 1e-6) -> DataFrame:
    """(gene, spot, noise) for each of the cells: the variance of the residuals at a spot's neighbours (src, dst), times scale.

    With fewer than two neighbours observed, or no variance there, it is that of all the gene's residuals; where that is 0 too,
    half the variance of its values, and 0.01 for a gene without values; `least` at least before scaling.
    """
    near = residuals.select("gene", F.col("spot").alias("dst"), "residual")
    own = edges.select("src", "dst").join(near, "dst").groupBy("gene", F.col("src").alias("spot")).agg(F.var_pop("residual").alias("v"), F.count("*").alias("n"))
    whole = residuals.groupBy("gene").agg(F.var_pop("residual").alias("all"), F.var_pop("value").alias("values"))
    rest = F.when(F.col("all") > 0, F.col("all")).otherwise(F.coalesce(F.col("values") * 0.5, F.lit(0.01)))
    j = cells.select("gene", "spot").join(own, ["gene", "spot"], "left").join(whole, "gene", "left")
    v = F.when((F.col("n") >= 2) & (F.col("v") > 0), F.col("v")).otherwise(rest)
    return j.select("gene", "spot", (F.greatest(v, F.lit(least)) * scale).alias("noise"))
