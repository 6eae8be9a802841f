"""Helpers that operators share: lineage is cut in the folder that the session names, Arrow batches go through Python functions."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of kept tables, and of rows that go to Python at a time in small_batches.
GROUP, BATCH = 8 << 20, 4 << 20


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder that the session names; sets one only where none is named, as in tests.
    Spark deletes it with the frame if spark.cleaner.referenceTracking.cleanCheckpoints says so."""
    shared(df.sparkSession)
    return df.checkpoint()


def shared(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is named, a temporary one on this machine, which only serves a local master;
    on a cluster other machines could not see it, so there it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarrymill-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Cuts lineage with a compressed Parquet table in the same shared folder; for large columns of which later steps read some.
    Row groups are small, as tasks hold one when they write and a column of one when they read. It is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", GROUP).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and checkpoints of frames that are gone. It does so only after the driver has collected its
    garbage, which in a loop of many small rounds may not come before the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python workers at most BATCH bytes (or one row) at a time, not 64 MB: an executor holds a
    batch several times, in the JVM's buffers, which double, and in each worker. What operators return doesn't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


_memories: list[Callable[[], None]] = []


def remembered(make: Callable) -> Callable:
    """make, cached; what it has made is forgotten in tasks that don't use it."""
    found = cache(make)
    _memories.append(found.cache_clear)
    return found


def forget() -> None:
    """Frees what earlier operators' tasks have remembered: Python workers outlive them."""
    for clear in _memories:
        clear()
    if _memories:
        released()


def released() -> None:
    """Gives memory that is free back to the machine: Python workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A text column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mapped(df: DataFrame, columns: list[str], schema: str, each: Callable[[pa.RecordBatch], Iterable[dict[str, object]]], rows: int = 10_000, remembers: bool = False) -> DataFrame:
    """Arrow batches of some columns, of so many rows at most, through `each`, which gives dicts of output columns for each batch.
    remembers: `each` uses what earlier tasks have remembered."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()
        for batch in (whole.slice(i, rows) for whole in batches for i in range(0, whole.num_rows, rows)):
            for out in each(batch):
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        released()

    return df.select(*columns).mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest node that each of n nodes reaches over the links a-b, by hooking and pointer jumping."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        labels = new
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
    return labels
