"""What the training-data operators share: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terrane.sources.fields import scratch, shared_dir

#: What separates words: a space or one of the control characters 9 to 13. ``bytes.split()`` splits on exactly these.
WHITE = b" \t\n\x0b\x0c\r"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2000 rows and 4 MB, so that a Python worker's memory does not depend on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


#: The operator that this Python worker served last, and what frees its caches.
_holder: list[tuple[str, Callable[[], None]]] = []


def take_over(name: str, forget: Callable[[], None]) -> None:
    """Says in a Python worker that the operator ``name`` works there now, and how what it keeps from task to task is freed.

    Workers serve one operator after another. What the one before kept goes, and its memory back to the system, so that caches of
    several operators never add up. Functions given must be a module's own, as others are copied to workers with what they refer to.
    """
    if _holder and _holder[0][0] != name:
        _holder[0][1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back by themselves
            ctypes.CDLL(None).malloc_trim(0)
    _holder[:] = [(name, forget)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read through Spark's own readers only."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts the lineage, survives lost executors."""
    bounded_batches(spark)
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application's shared folder. Results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
