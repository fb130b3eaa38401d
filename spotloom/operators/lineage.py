"""Cutting the plans of iterations: tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; below a local one only where that is unset and everything runs on one machine."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="spotloom")
        _roots[app] = f"{top}/spotloom-tables-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, _roots[app])
    return _roots[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    if jvm is None or sc._jsc is None:  # the session has ended; the folder's own clean-up takes over
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: a lost executor costs no more than a reread.  It goes with drop(), or when the driver ends."""
    return cut_and_count(df)[0]


def cut_and_count(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """The written table, and aggregates of its rows that are read off as they are written."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{uuid.uuid4().hex}"
    seen = Observation() if sums else None
    watched = df.observe(seen, *[c.alias(n) for n, c in sums.items()]) if sums else df
    watched.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out, seen.get if sums else {}


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._written)
