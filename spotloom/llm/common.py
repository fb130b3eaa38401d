"""What the text operators share: shared tables, code shipping and a per-text Arrow map."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: "weakref.WeakSet" = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each context."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    folder = tempfile.mkdtemp(prefix="ship")
    out = os.path.join(folder, f"{name}_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for path, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(path, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, top)))
    sc.addPyFile(out)
    _shipped.add(sc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.  Where that is unset, an own one, if all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spotloom.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spotloom-shared")
        spark.conf.set("spotloom.shared.dir", path)
    return path


class Scratch:
    """Parquet tables in the shared folder.  They cut lineage: a lost executor costs no more than a reread.

    drop() removes those no longer needed; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/spotloom-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        if jvm is None or sc._jsc is None:
            return
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def save(self, df: DataFrame, partition_by: Iterable[str] = ()) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM is gone; the cluster's own clean-up of the folder takes over
            pass


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


_kept: dict = {}


def keep(key, make: Callable):
    """What make() gives, held in this worker process from task to task until forget() or another key."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def hand_back() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def forget() -> None:
    """Drop what a worker process holds from an earlier stage, and hand the memory back."""
    if _kept:
        _kept.clear()
        hand_back()


#: bytes of text that a task works on at a time
PART = 4 << 20


def slices(batch: pa.RecordBatch, text: int, most: int = PART):
    """The batch in runs of rows of at most `most` bytes of text, or one row."""
    size = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(size):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, keys: list[str], text: str, make: Callable[[], Callable[[list], dict]], out: T.StructType, most: int | None = None) -> DataFrame:
    """For each row the keys and what a function of the text's UTF-8 bytes gives.

    make() runs once for each task and returns a function from a list of bytes (None for null)
    to a dict of equally long lists by column of out.  No shuffle; rows keep their partition.
    With `most`, the function gets at most that many bytes of text at a time, or one text.
    """
    ship(df.sparkSession)
    src = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = T.StructType([src.schema[k] for k in keys] + list(out.fields))
    n_keys, fields = len(keys), [f.name for f in out.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        fn = make()
        for b in (part for batch in batches for part in (slices(batch, n_keys, most) if most else [batch])):
            if b.num_rows == 0:
                continue
            got = fn(b.column(n_keys).to_pylist())
            cols = [b.column(i).cast(arrow.field(i).type) for i in range(n_keys)]
            for i, f in enumerate(fields):
                v = got[f]
                t = arrow.field(n_keys + i).type
                cols.append(v.cast(t) if isinstance(v, pa.Array) else pa.array(v, type=t))
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return src.mapInArrow(run, schema)


#: bytes.translate tables
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: keeps 0-9, a-z and every byte beyond ASCII; A-Z become a-z, the rest spaces
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
