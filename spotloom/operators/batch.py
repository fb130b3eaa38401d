"""Linear batch correction for any number of batches, keeping the effect of a condition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _design(spots: DataFrame, batch: str, keep: str | None) -> tuple[list, list, np.ndarray, np.ndarray, DataFrame]:
    """Batch levels, cells, and for each cell the rows of the kept block (orthonormal over all spots) and of the batch block, freed of the kept one.

    A cell is a (batch, kept) pair; there are as many as levels, so they are worked out by the driver.
    """
    cols = [F.col(batch).alias("b"), (F.col(keep) if keep else F.lit(0)).alias("p")]
    rows = spots.select(*cols).groupBy("b", "p").agg(F.count("*").alias("n")).collect()
    levels = lambda k: sorted({r[k] for r in rows if r[k] is not None})
    b_levels, p_levels = levels("b"), levels("p")
    n = np.array([r.n for r in rows], float)
    kept = np.array([[1.0, *(float(r.p == x) for x in p_levels[1:])] for r in rows]).reshape(len(rows), -1)
    own = np.array([[float(r.b == x) for x in b_levels[1:]] for r in rows]).reshape(len(rows), -1)
    q = kept
    if len(rows):
        w, v = np.linalg.eigh((kept * n[:, None]).T @ kept)
        good = w > 1e-10 * w.max()
        q = kept @ (v[:, good] / np.sqrt(w[good]))
    free = own - q @ ((q * n[:, None]).T @ own)
    free[np.abs(free) < 1e-9] = 0.0  # a batch that is a level: nothing is left to tell them apart
    numbered = spots.sparkSession.createDataFrame([(i, r.b, r.p) for i, r in enumerate(rows)], f"cell int, b {spots.schema[batch].dataType.simpleString()}, p {spots.schema[keep].dataType.simpleString() if keep else 'int'}")
    return b_levels, rows, q, free, numbered


def _effects(sums: DataFrame, q: np.ndarray, free: np.ndarray, own_levels: int) -> DataFrame:
    """(gene, used, gamma): effects of the batches but the first by least squares of least length, from a gene's sums by cell, many genes at once."""
    cells, need = len(q), max(3, q.shape[1] + free.shape[1] + 1)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, s = np.zeros((len(pdf), cells)), np.zeros((len(pdf), cells))
            for g, (at, ns, ss) in enumerate(zip(pdf["at"], pdf["n"], pdf["s"])):
                n[g, at], s[g, at] = ns, ss
            # values freed of the kept block; its basis is that of all spots, not of the gene's
            rest = s - n * ((s @ q) @ q.T)
            gram = np.einsum("gc,ci,cj->gij", n, free, free)
            gamma = np.einsum("gij,gj->gi", np.linalg.pinv(gram, rcond=1e-10, hermitian=True), rest @ free)
            used = n.sum(1) >= need
            gamma[~used] = 0.0
            yield pd.DataFrame({"gene": pdf.gene.to_numpy(), "used": used, "gamma": gamma.tolist()})

    grouped = sums.groupBy("gene").agg(F.collect_list("cell").alias("at"), F.collect_list("n").alias("n"), F.collect_list("s").alias("s"))
    return grouped.mapInPandas(solve, f"gene {sums.schema['gene'].dataType.simpleString()}, used boolean, gamma array<double>")


def correct(values: DataFrame, spots: DataFrame, batch: str = "batch", keep: str | None = None) -> DataFrame:
    """values (gene, spot, value) with `corrected`: less the effect of the spot's batch against the first batch.

    A gene's effects are the least squares fit, of least length where batches can't be told apart, of its values freed
    of the mean and of the levels of `keep`, which stay in the values.  Genes with fewer values than parameters and
    one more, or than three, and slides of one batch stay as they are; so do null values.  Spots without a batch or a level count
    as of the first.  Values are summed by (gene, batch, level) before they are shuffled; only those sums are solved.
    """
    levels, rows, q, free, numbered = _design(spots, batch, keep)
    if len(levels) < 2:
        return values.select("gene", "spot", "value", F.col("value").alias("corrected"))
    # as many rows as levels
    kept = (F.col(keep) if keep else F.lit(0)).alias("p")
    at = spots.select("spot", F.col(batch).alias("b"), kept).join(F.broadcast(numbered.withColumnsRenamed({"b": "b2", "p": "p2"})), F.col("b").eqNullSafe(F.col("b2")) & F.col("p").eqNullSafe(F.col("p2")))
    place = F.array_position(F.lit(levels[1:]), F.col("b"))
    at = at.select("spot", "cell", F.coalesce(place, F.lit(0)).cast("int").alias("nth"))
    j = values.select("gene", "spot", "value").join(at, "spot", "left")
    sums = j.where("value IS NOT NULL AND cell IS NOT NULL").groupBy("gene", "cell").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("s"))
    effect = _effects(sums, q, free, len(levels) - 1)
    off = F.when(F.coalesce(F.col("nth"), F.lit(0)) > 0, F.get("gamma", F.col("nth") - 1)).otherwise(0.0)
    return j.join(effect, "gene", "left").select("gene", "spot", "value", (F.col("value") - F.coalesce(off, F.lit(0.0))).alias("corrected"))
