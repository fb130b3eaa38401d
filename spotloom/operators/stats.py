"""Ranks, tests, false-discovery control, metrics and conformal intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(part: list[str], column: str) -> Column:
    w = Window.partitionBy(*part)
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*part, column)) - 1) / 2


def rank_sum(df: DataFrame, by: list[str], value: str = "value", group: str = "g") -> DataFrame:
    """Mann-Whitney U of group 1 against 2, tie term, and z with tie and continuity correction (null without variance).

    Groups of one kind only are left out.
    """
    r = df.withColumn("r", average_rank(by, value)).withColumn("t", F.count("*").over(Window.partitionBy(*by, value)))
    a = r.groupBy(*by).agg(F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 2).alias("n2"), F.sum(F.when(F.col(group) == 1, F.col("r"))).alias("r1"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties")).where("n1 > 0 AND n2 > 0")
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mid = F.col("n1") * F.col("n2") / 2
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return a.select(*by, "n1", "n2", u.alias("u"), F.when(var > 0, (F.greatest(u, F.col("n1") * F.col("n2") - u) - mid - 0.5) / F.sqrt(var)).alias("z"))


def all_pairs(df: DataFrame, label: str, by: list[str], value: str = "value") -> DataFrame:
    """rank_sum of each unordered pair of labels (a < b), a being group 1; pairs with a group under three are left out; a row goes to the pairs of its own label."""
    known = df.select(F.col(label).alias("__l")).where("__l IS NOT NULL").distinct()
    pairs = known.select(F.col("__l").alias("a")).join(known.select(F.col("__l").alias("b")), F.col("a") < F.col("b"))
    sides = pairs.select(F.col("a").alias(label), "a", "b", F.lit(1).alias("g")).union(pairs.select(F.col("b").alias(label), "a", "b", F.lit(2).alias("g")))
    return rank_sum(df.select(*by, value, label).join(sides, label), ["a", "b", *by], value).where("n1 >= 3 AND n2 >= 3")


def uncertainty_weights(df: DataFrame, by: list[str], uncertainty: str = "std") -> DataFrame:
    """df with `weight`: 1 / (uncertainty + 1e-8), 1 where that is missing or not positive, and 1 throughout where fewer than three of a group are valid."""
    ok = F.col(uncertainty).isNotNull() & ~F.isnan(uncertainty) & (F.col(uncertainty) > 0)
    enough = F.count_if(ok).over(Window.partitionBy(*by)) >= 3
    return df.withColumn("weight", F.when(enough & ok, 1 / (F.col(uncertainty) + 1e-8)).otherwise(1.0))


def certain_half(df: DataFrame, by: list[str], group: str = "g", least: int = 5) -> DataFrame:
    """Of each group of over `least` rows those of a weight above the group's median; smaller groups whole."""
    own = [*by, group]
    median = df.groupBy(*own).agg(F.percentile("weight", F.lit(0.5)).alias("__m"), F.count("*").alias("__n"))
    return df.join(median, own).where((F.col("__n") <= least) | (F.col("weight") > F.col("__m"))).drop("__m", "__n")


def resampled(df: DataFrame, by: str, value: str = "value", group: str = "g", most: int = 500, seed: int = 42) -> DataFrame:
    """For each group of each `by` min(3 * the larger group, most) rows drawn by weight with replacement, seeded; those without both groups are left out."""
    import numpy as np

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rng, parts = pdf.sort_values([group, value, "weight"]), np.random.default_rng(seed), []
        n = min(3 * int(pdf[group].value_counts().max()), most)
        if set(pdf[group]) >= {1, 2}:
            for g in (1, 2):
                own = pdf[pdf[group] == g]
                p = own.weight.clip(lower=0).to_numpy(float)
                p = p / p.sum() if p.sum() > 0 else None
                parts.append(own.iloc[rng.choice(len(own), n, p=p)])
        return pd.concat(parts)[[by, value, group]] if parts else pdf.iloc[:0][[by, value, group]]

    src = df.select(by, value, F.col(group).cast("int").alias(group), "weight")
    return src.groupBy(by).applyInPandas(draw, src.drop("weight").schema)


def normal_p(z: str):
    """Two-sided normal p of a column, at most 1; one row a test, so this is no hot path."""
    @F.pandas_udf("double")
    def p(s: pd.Series) -> pd.Series:
        return s.map(lambda v: min(1.0, math.erfc(v / math.sqrt(2))) if v == v and v is not None else None).astype("float64")

    return p(F.col(z))


def welch(df: DataFrame, by: list[str], value: str = "value", group: str = "g") -> DataFrame:
    """t and Welch-Satterthwaite degrees of freedom."""
    g = {i: F.when(F.col(group) == i, F.col(value)) for i in (1, 2)}
    a = df.groupBy(*by).agg(*[f(g[i]).alias(f"{n}{i}") for i in (1, 2) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).where("n1 > 1 AND n2 > 1")
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    ok = s1 + s2 > 0
    return a.select(*by, F.when(ok, (F.col("m1") - F.col("m2")) / F.sqrt(s1 + s2)).alias("t"), F.when(ok, F.pow(s1 + s2, 2) / (s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1))).alias("df"))


def adjust(df: DataFrame, by: list[str], p: str = "p", method: str = "bh", tie: str = "gene") -> DataFrame:
    """padj within each comparison: Bonferroni, Benjamini-Hochberg or Benjamini-Yekutieli; null p stays null and doesn't count."""
    own = Window.partitionBy(*by, F.col(p).isNull())
    m = F.count(p).over(own)
    if method == "bonferroni":
        adj = F.least(F.lit(1.0), F.col(p) * m)
        return df.withColumn("padj", F.when(F.col(p).isNotNull(), adj))
    k = F.row_number().over(own.orderBy(p, tie))
    scale = F.lit(1.0) if method == "bh" else F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("__m")), F.lit(0.0), lambda a, i: a + 1 / i)
    t = df.withColumn("__m", m).withColumn("__q", F.col(p) * F.col("__m") / k)
    q = F.min("__q").over(own.orderBy(F.col(p).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("padj", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), q * scale))).drop("__m", "__q")


def errors(by: list[str], df: DataFrame) -> DataFrame:
    """RMSE, MAE, bias, R2 and Pearson of pred against truth."""
    d = F.col("pred") - F.col("truth")
    a = df.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.avg(d * d).alias("mse"), F.var_pop("truth").alias("v"), F.corr("pred", "truth").alias("pearson"))
    return a.select(*by, "n", "rmse", "mae", "bias", F.when(F.col("v") > 1e-12, 1 - F.col("mse") / F.col("v")).alias("r2"), "pearson")


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    r = df.withColumn("ra", average_rank(by, a)).withColumn("rb", average_rank(by, b))
    return r.groupBy(*by).agg(F.corr("ra", "rb").alias("spearman"))


def conformal_level(n: int, alpha: float) -> float:
    return min(1.0, math.ceil((n + 1) * (1 - alpha)) / n) if n else 1.0


def conformal(calibration: DataFrame, alpha: float = 0.1, scaled: bool = True) -> DataFrame:
    """One row (q, floor): the order statistic of the scores at the split-conformal level.

    The fraction given to percentile falls on a rank exactly, so nothing is interpolated.
    """
    err = F.abs(F.col("truth") - F.col("pred"))
    floor = calibration.agg(F.greatest(F.max("std") * 1e-3, F.lit(1e-12)).alias("floor"))
    s = calibration.crossJoin(F.broadcast(floor)).select((err / F.greatest("std", "floor") if scaled else err).alias("score"))
    n = s.count()
    level = conformal_level(n, alpha)
    k = math.ceil(level * (n - 1)) + 1
    q = s.agg(F.percentile("score", F.lit((k - 1) / (n - 1) if n > 1 else 0.0)).alias("q"))
    return q.crossJoin(floor)


def intervals(test: DataFrame, q: DataFrame, scaled: bool = True) -> DataFrame:
    half = F.col("q") * (F.greatest("std", "floor") if scaled else F.lit(1.0))
    return test.crossJoin(F.broadcast(q)).withColumn("lo", F.col("pred") - half).withColumn("hi", F.col("pred") + half)


def coverage(df: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    """Coverage, mean width and interval score."""
    y, miss = F.col("truth"), 2 / alpha
    winkler = F.col("hi") - F.col("lo") + miss * F.greatest(F.col("lo") - y, F.lit(0.0)) + miss * F.greatest(y - F.col("hi"), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(((y >= F.col("lo")) & (y <= F.col("hi"))).cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"), F.avg(winkler).alias("interval_score"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, normalised mutual information and purity of two labelings, from their contingency table."""
    c = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    ra, rb = c.groupBy(a).agg(F.sum("n").alias("na")), c.groupBy(b).agg(F.sum("n").alias("nb"))
    t = c.agg(F.sum("n").alias("t"))
    j = c.join(ra, a).join(rb, b).crossJoin(F.broadcast(t))
    pair = lambda x: x * (x - 1) / 2
    cell = j.agg(F.sum(pair(F.col("n"))).alias("s"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.first("t").alias("t"))
    ent = lambda d, k, x: d.crossJoin(F.broadcast(t)).agg(F.sum(pair(F.col(k))).alias(f"s{x}"), (-F.sum(F.col(k) / F.col("t") * F.log(F.col(k) / F.col("t")))).alias(f"h{x}"))
    best = c.groupBy(a).agg(F.max("n").alias("m")).agg(F.sum("m").alias("pure"))
    r = cell.crossJoin(ent(ra, "na", "a")).crossJoin(ent(rb, "nb", "b")).crossJoin(best)
    expected = F.col("sa") * F.col("sb") / pair(F.col("t"))
    return r.select(((F.col("s") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"), (2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"), (F.col("pure") / F.col("t")).alias("purity"))


def student_p(t: str, df: str):
    """Two-sided p of Student's t, by the regularised incomplete beta function; one row a test."""

    def beta(a: float, b: float, x: float) -> float:
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        out = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                out *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return front * out / a

    @F.pandas_udf("double")
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        def one(x, n):
            if x != x or n != n or n <= 0:
                return None
            v = n / (n + x * x)
            return 1.0 if v >= 1 else 0.0 if v <= 0 else min(1.0, beta(n / 2, 0.5, v))

        return pd.Series([one(x, n) for x, n in zip(ts, dfs)], dtype="float64")

    return p(F.col(t), F.col(df))


def permutation_difference(df: DataFrame, by: str, n_perm: int = 200, seed: int = 42) -> DataFrame:
    """Share of label shuffles whose mean difference is at least the observed one; seeded by group."""
    import numpy as np

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "value"])
        v, one = pdf.value.to_numpy(float), (pdf.g == 1).to_numpy()
        key = int(pdf[by].iloc[0])
        if one.all() or not one.any():
            return pd.DataFrame({by: [], "difference": [], "p": []}).astype({by: "int64", "difference": "float64", "p": "float64"})
        gap = lambda m: v[m].mean() - v[~m].mean()
        rng = np.random.default_rng([seed, key])
        seen = gap(one)
        null = np.array([abs(gap(rng.permutation(one))) for _ in range(n_perm)])
        return pd.DataFrame([(key, seen, float((null >= abs(seen)).mean()))], columns=[by, "difference", "p"])

    return df.select(by, "g", "value").groupBy(by).applyInPandas(fit, f"{by} bigint, difference double, p double")


def fixed_effects(df: DataFrame, by: str, response: str, predictor: str, group: str) -> DataFrame:
    """Least squares of response on predictor with a dummy for each group, by key: slope, standard error, t and residual degrees of freedom."""
    import numpy as np

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        key = int(pdf[by].iloc[0])
        x, y = pdf[predictor].to_numpy(float), pdf[response].to_numpy(float)
        dummies = pd.get_dummies(pdf[group], drop_first=True).to_numpy(float)
        a = np.column_stack([x, np.ones(len(x)), dummies])
        dof = len(y) - np.linalg.matrix_rank(a)
        out = (key, len(y), None, None, None, int(dof))
        if dof > 0 and np.ptp(x) > 0:
            coef = np.linalg.lstsq(a, y, rcond=None)[0]
            res = y - a @ coef
            cov = np.linalg.pinv(a.T @ a) * float(res @ res) / dof
            se = math.sqrt(max(cov[0, 0], 0))
            out = (key, len(y), float(coef[0]), se, float(coef[0] / se) if se > 0 else None, int(dof))
        return pd.DataFrame([out], columns=[by, "n", "beta", "se", "t", "dof"])

    return df.groupBy(by).applyInPandas(fit, f"{by} bigint, n bigint, beta double, se double, t double, dof bigint")


def quantile_bin(df: DataFrame, column: str, n: int, name: str = "bin") -> DataFrame:
    """df with the number, from 0, of the one of n parts between quantiles (linear between ranks) that the column lies in; edges belong above."""
    edges = df.agg(F.percentile(column, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("__q"))  # one row
    j = df.crossJoin(F.broadcast(edges))
    return j.withColumn(name, F.when(F.col(column).isNotNull(), F.size(F.filter("__q", lambda q: q <= F.col(column))))).drop("__q")


def block_coverage(df: DataFrame, block: str, alpha: float, calibrating: int = 3, of: int = 5, least: int = 10) -> DataFrame:
    """One row (q, n_calibration, n_test, coverage): intervals q x std calibrated on some blocks of spots and rated on the others.

    df: (truth, pred, std, block).  Blocks are dealt by a hash of their name, `calibrating` of each `of` on average to the
    calibration; where either side has under `least` rows, the sides are changed, as with one block alone nothing else is left.
    """
    half = F.pmod(F.crc32(F.col(block).cast("string").cast("binary")), F.lit(of)) < calibrating
    n = df.agg(F.count_if(half).alias("a"), F.count_if(~half).alias("b")).first()
    if n.a < least or n.b < least:
        half = ~half
    score = F.abs(F.col("truth") - F.col("pred")) / F.greatest("std", F.lit(1e-12))
    own = df.where(half).select(score.alias("score"))
    m = n.b if (n.a < least or n.b < least) else n.a
    level = conformal_level(m, alpha)
    k = math.ceil(level * (m - 1)) + 1
    q = own.agg(F.percentile("score", F.lit((k - 1) / (m - 1) if m > 1 else 0.0)).alias("q"), F.count("*").alias("n_calibration"))
    test = df.where(~half).withColumn("score", score).crossJoin(F.broadcast(q))  # one row
    return test.groupBy("q", "n_calibration").agg(F.count("*").alias("n_test"), F.avg((F.col("score") <= F.col("q")).cast("double")).alias("coverage"))


def confident_spots(cells: DataFrame, levels: dict[str, float]) -> DataFrame:
    """(level, sample, spot): of each sample the most certain spots, ceil(n (1 - drop)) of n.

    cells: (sample, spot, gene, value, half), half being the width of the value's interval.  A spot's uncertainty is the mean over
    its unobserved values, over all where it has none; ties go to the smaller spot.
    """
    score = F.coalesce(F.avg(F.when(F.col("value").isNull(), F.col("half"))), F.avg("half"))
    s = cells.groupBy("sample", "spot").agg(F.round(score, 12).alias("u"))
    own = Window.partitionBy("sample")
    ranked = s.withColumn("k", F.row_number().over(own.orderBy(F.col("u").asc_nulls_last(), "spot"))).withColumn("n", F.count("*").over(own))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(d)).alias("drop")) for k, d in levels.items()]))
    return ranked.select("*", each.alias("l")).where(F.col("k") <= F.ceil(F.round(F.col("n") * (1 - F.col("l.drop")), 9))).select("l.level", "sample", "spot")


def retest(values: DataFrame, kept: DataFrame, group: str, alpha: float = 0.05) -> DataFrame:
    """(level, gene, n1, n2, u, p, padj, significant): rank tests between the two groups on the spots that each level keeps, adjusted within a level.

    values: (sample, spot, gene, value, group of 1 or 2); kept: (level, sample, spot).
    """
    j = values.where("value IS NOT NULL").join(kept, ["sample", "spot"]).withColumnRenamed(group, "g")
    t = rank_sum(j, ["level", "gene"]).withColumn("p", normal_p("z"))
    return adjust(t, ["level"]).withColumn("significant", F.col("padj") < alpha).select("level", "gene", "n1", "n2", "u", "p", "padj", "significant")


#: spots of a block, all pairs of which with another block's are compared in one task, and genes of a product of matrices
PAIR_BLOCK, GENES = 1024, 256


def pair_correlations(values: DataFrame, by: list[str], least: int) -> DataFrame:
    """(*by, pairs, flat, total): over a group's pairs of spots with `least` genes in common or more, how many there are,
    how many of them have no correlation since one side doesn't vary, and the others' sum of Pearson correlations.

    values: (*by, gene, spot, value).  A block of spots is compared with a block at a time by products of matrices, so no row a pair is
    made; work grows with the square of a group's spots, a task's memory doesn't.
    """
    known = values.where("value IS NOT NULL").select(*by, "gene", "spot", F.col("value").cast("double").alias("value"))
    n = known.groupBy(*by).agg(F.ceil(F.count_distinct("spot") / PAIR_BLOCK).alias("blocks"))
    one = known.groupBy(*by, "spot").agg(F.collect_list("gene").alias("genes"), F.collect_list("value").alias("values")).join(n, by)
    one = one.withColumn("own", F.pmod(F.xxhash64("spot"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    two = one.select(*by, "spot", "genes", "values", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key[-2:]
        pdf = pdf.sort_values("spot").reset_index(drop=True)
        genes, at = np.unique(np.concatenate(pdf.genes.to_list()), return_inverse=True)
        row, v = np.repeat(np.arange(len(pdf)), pdf.genes.str.len()), np.concatenate(pdf["values"].to_list())
        left, right = (np.flatnonzero(pdf.own == k) for k in (i, j))
        sums = np.zeros((6, len(left), len(right)))
        order = np.argsort(at, kind="stable")
        row, at, v = row[order], at[order], v[order] - v.mean()  # one shift for all leaves correlations as they are
        for g in range(0, len(genes), GENES):
            lo, hi = np.searchsorted(at, (g, g + GENES))
            x, seen = np.zeros((2, len(pdf), min(GENES, len(genes) - g)))
            x[row[lo:hi], at[lo:hi] - g], seen[row[lo:hi], at[lo:hi] - g] = v[lo:hi], 1.0
            a, b, p, q = x[left], x[right], seen[left], seen[right]
            for k, (s, t) in enumerate(((p, q), (a, q), (p, b), (a * a, q), (p, b * b), (a, b))):
                sums[k] += s @ t.T
        n, sx, sy, xx, yy, xy = sums
        pair = n >= max(least, 1)
        if i == j:
            pair &= np.arange(len(left))[:, None] < np.arange(len(right))
        n, sx, sy, xx, yy, xy = (m[pair] for m in sums)
        vx, vy, both = xx - sx * sx / n, yy - sy * sy / n, xy - sx * sy / n
        flat = (vx <= 1e-13 * xx) | (vy <= 1e-13 * yy)
        r = both[~flat] / np.sqrt(vx[~flat] * vy[~flat])
        return pd.DataFrame([(*key[:-2], int(pair.sum()), int(flat.sum()), float(r.sum()))], columns=[*by, "pairs", "flat", "total"])

    kinds = ", ".join(f"{b} {values.schema[b].dataType.simpleString()}" for b in by)
    parts = 4 * values.sparkSession.sparkContext.defaultParallelism
    # few rows but much work: a number of partitions that the planner leaves as it is
    return two.repartition(parts, *by, "i", "j").groupBy(*by, "i", "j").applyInPandas(compare, f"{kinds}, pairs bigint, flat bigint, total double").where("pairs > 0")
