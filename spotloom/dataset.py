"""One slide's tables under one roof: what is known of its genes and spots, and what was worked out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: tables of a saved dataset
_CELLS, _SPOTS, _SITES = "cells", "spots", "sites"


class Dataset:
    """cells (gene, spot, value, and a column for each layer), spots (spot, x, y, labels) and sites.

    Nothing is computed here: setters join columns to cells or spots, and refuse tables that name unknown genes
    or spots, or a cell twice; that check is one job.  A dataset does not change; setters return a new one.
    """

    def __init__(self, cells: DataFrame, spots: DataFrame, sites: DataFrame | None = None):
        for df, needed in ((cells, ("gene", "spot", "value")), (spots, ("spot", "x", "y"))):
            if missing := [c for c in needed if c not in df.columns]:
                raise ValueError(f"columns missing: {missing}")
        self.cells, self.spots, self.sites = cells, spots, sites

    @property
    def layers(self) -> list[str]:
        return [c for c in self.cells.columns if c not in ("gene", "spot", "value")]

    @property
    def labels(self) -> list[str]:
        return [c for c in self.spots.columns if c not in ("spot", "x", "y")]

    def has(self, name: str) -> bool:
        return name in self.layers or name in self.labels

    def get(self, name: str = "value") -> DataFrame:
        """(gene, spot, value) of a layer, (spot, label) of spots' labels, or the observed values."""
        if name in self.labels:
            return self.spots.select("spot", F.col(name).alias("label"))
        if name != "value" and name not in self.layers:
            raise KeyError(name)
        return self.cells.select("gene", "spot", F.col(name).alias("value"))

    def _checked(self, new: DataFrame, own: DataFrame, keys: list[str], what: str) -> None:
        met = new.groupBy(*keys).agg(F.count("*").alias("n")).join(own.select(*keys).withColumn("known", F.lit(True)), keys, "left")
        twice, unknown = met.agg(F.count_if(F.col("n") > 1), F.count_if(F.col("known").isNull())).first()
        if twice or unknown:
            raise ValueError(f"{what}: {twice} {' and '.join(keys)} more than once, {unknown} unknown")

    def with_layer(self, name: str, values: DataFrame, column: str = "value") -> "Dataset":
        """Values by gene and spot, such as an index, imputed values or their uncertainty; cells without one are null."""
        if name in ("gene", "spot", "value"):
            raise ValueError(f"a layer can't be named {name}")
        self._checked(values, self.cells, ["gene", "spot"], name)
        cells = self.cells.drop(name).join(values.select("gene", "spot", F.col(column).alias(name)), ["gene", "spot"], "left")
        return Dataset(cells, self.spots, self.sites)

    def with_labels(self, name: str, labels: DataFrame, column: str = "domain") -> "Dataset":
        if name in ("spot", "x", "y"):
            raise ValueError(f"labels can't be named {name}")
        self._checked(labels, self.spots, ["spot"], name)
        return Dataset(self.cells, self.spots.drop(name).join(labels.select("spot", F.col(column).alias(name)), "spot", "left"), self.sites)

    def with_sites(self, sites: DataFrame) -> "Dataset":
        return Dataset(self.cells, self.spots, sites)

    def _only(self, column: str, keep: DataFrame) -> "Dataset":
        keep = keep.select(column).distinct()
        part = lambda df: df if df is None or column not in df.columns else df.join(keep, column, "left_semi")
        return Dataset(part(self.cells), part(self.spots), part(self.sites))

    def with_genes(self, genes: DataFrame) -> "Dataset":
        """Only the genes of a table (gene)."""
        return self._only("gene", genes)

    def with_spots(self, spots: DataFrame) -> "Dataset":
        """Only the spots of a table (spot)."""
        return self._only("spot", spots)

    def status(self) -> DataFrame:
        """One row: n_genes, n_spots, n_cells, n_observed, and the filled cells of each layer."""
        c = self.cells.agg(F.count_distinct("gene").alias("n_genes"), F.count("*").alias("n_cells"), F.count("value").alias("n_observed"), *[F.count(x).alias(f"n_{x}") for x in self.layers])
        return self.spots.agg(F.count("*").alias("n_spots")).crossJoin(c)  # one row each

    def save(self, path: str) -> None:
        for name, df in ((_CELLS, self.cells), (_SPOTS, self.spots), (_SITES, self.sites)):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Dataset":
        """A saved dataset; one without sites has none."""
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_SITES}")
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return cls(spark.read.parquet(f"{path}/{_CELLS}"), spark.read.parquet(f"{path}/{_SPOTS}"), spark.read.parquet(f"{path}/{_SITES}") if there else None)

    @classmethod
    def pooled(cls, parts: dict[str, "Dataset"], label: str = "sample") -> "Dataset":
        """Several slides as one: spots are named slide and spot, and carry the slide's name; layers and labels of all are kept."""
        named = lambda df, k: df.withColumn("spot", F.concat(F.lit(f"{k}:"), F.col("spot").cast("string")))
        both = lambda a, b: a.unionByName(b, allowMissingColumns=True)
        cells = reduce(both, [named(d.cells, k) for k, d in parts.items()])
        spots = reduce(both, [named(d.spots, k).withColumn(label, F.lit(k)) for k, d in parts.items()])
        sites = [d.sites for d in parts.values() if d.sites is not None]
        return cls(cells, spots, reduce(both, sites).distinct() if sites else None)
