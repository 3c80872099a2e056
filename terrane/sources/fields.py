"""Numeric fields as DataFrames (idx, v): from tables, from raw binary files, and back to files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Element types of raw files, by name.
KINDS = {"f32": ("<f4", "float"), "f64": ("<f8", "double"), "i32": ("<i4", "int"), "i64": ("<i8", "long")}


def indexed(df: DataFrame, key: str, value: Column) -> DataFrame:
    """(idx, v): rows numbered from 0 in order of a unique key, without a task that sees all rows.

    Rows are dealt by ranges of the key and numbered within a partition; the partitions' counts, one small row each, give the offsets.
    """
    dealt = df.select(F.col(key).alias("k"), value.alias("v")).repartitionByRange("k").sortWithinPartitions("k")
    local = dealt.select("v", F.monotonically_increasing_id().alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = local.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))  # one row a partition
    return local.join(offsets, F.shiftright("m", 33) == F.col("p")).select((F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("idx"), "v")


def coordinates(field: DataFrame, nx: int, ny: int) -> DataFrame:
    """x, y and z of a field; x runs fastest."""
    return field.withColumns({"x": F.col("idx") % nx, "y": F.expr(f"(idx div {nx}) % {ny}"), "z": F.expr(f"idx div {nx * ny}")})


def parse_dims(text: str, count: int | None = None) -> tuple[int, int, int]:
    """``XxYxZ`` (also with X, - or * between). The product must be the number of elements, if that is given."""
    parts = [int(p) for p in re.split(r"[xX*-]", text.strip())]
    if not 1 <= len(parts) <= 3 or min(parts) < 1:
        raise ValueError(f"bad dimensions: {text}")
    x, y, z = (*parts, 1, 1)[:3]
    if count is not None and x * y * z != count:
        raise ValueError(f"dimensions {text} hold {x * y * z} elements, the field has {count}")
    return x, y, z


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A session on one machine that has none gets a temporary one; a
    cluster without it is an error, as executors would write to disks of their own."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _local[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def _raw_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files below a path or pattern, with their sizes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(at) or []
    files = [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    out = [(f.getPath().toString(), f.getLen()) for f in files if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def read_raw(spark: SparkSession, path: str, kind: str, whole_bytes: int = 64 << 20) -> DataFrame:
    """(path, idx, v) of raw little-endian files. A size that is no multiple of the element's is an error.

    Files of up to ``whole_bytes`` come as one row each. A larger one is read in records, of as many elements as divide its number, by as
    many tasks as it has splits.
    """
    code, name = KINDS[kind]
    width, files = np.dtype(code).itemsize, _raw_files(spark, path)
    for file, size in files:
        if size % width:
            raise ValueError(f"{file}: {size} bytes are not a multiple of {width}")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                values = np.frombuffer(data, code)
                for at in range(0, len(values), 1 << 18):
                    part = values[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(first + at, first + at + len(part))), pa.array(part)], names=["path", "idx", "v"])

    parts = []
    if small := [f for f, size in files if size <= whole_bytes]:
        parts.append(spark.read.format("binaryFile").load(small).select("path", F.lit(0).cast("long").alias("first"), "content"))
    for file, size in files:
        if size > whole_bytes:
            n = size // width
            each = max(d for d in range(1, 1 << 14) if n % d == 0)
            records = spark.sparkContext.binaryRecords(file, each * width).zipWithIndex().map(lambda r, file=file, each=each: (file, r[1] * each, bytearray(r[0])))
            parts.append(spark.createDataFrame(records, "path string, first long, content binary"))
    return reduce(DataFrame.unionByName, parts).mapInArrow(decode, f"path string, idx long, v {name}")


def ordered_values(field: DataFrame, per_block: int) -> DataFrame:
    """(block, values): the values of every ``per_block`` positions as an array, in order of idx."""
    items = F.array_sort(F.collect_list(F.struct("idx", "v")))
    return field.groupBy(F.expr(f"idx div {per_block}").alias("block")).agg(items.alias("items")).select("block", F.col("items.v").alias("values"))


def flat_values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of arrays, and where each row's begin and the last ends."""
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    return column.flatten().to_numpy(zero_copy_only=False), offsets


def to_blocks(field: DataFrame, code: str, per_block: int) -> DataFrame:
    """(block, n, bytes): a field's elements as binary blocks of ``per_block`` elements, in order of idx.

    Integers are stored modulo the width; what a narrow unsigned width can hold neither as it is nor as a negative number is an error.
    """
    kind = np.dtype(code)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = flat_values(batch.column(1))
            if kind.kind != "f" and kind.itemsize < 8 and len(values) and (int(values.max()) >> 8 * kind.itemsize or int(values.min()) < -(1 << 8 * kind.itemsize - 1)):
                raise ValueError(f"values from {values.min()} to {values.max()} don't fit {8 * kind.itemsize} bits")
            raw = values.astype(kind) if kind.kind == "f" else values.astype(np.int64).view(np.uint64).astype(kind)
            data = [raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(data, pa.binary())], names=["block", "n", "bytes"])

    return ordered_values(field, per_block).mapInArrow(pack, "block long, n long, bytes binary")


def from_blocks(blocks: DataFrame, code: str, per_block: int) -> DataFrame:
    """(idx, v) of binary blocks; unsigned 64-bit values keep their bits in a long."""
    floating = np.dtype(code).kind == "f"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                v = np.frombuffer(data, code)
                v = v.astype(np.float64) if floating else v.astype(np.uint64).view(np.int64) if np.dtype(code).kind == "u" else v.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block * per_block + np.arange(len(v))), pa.array(v)], names=["idx", "v"])

    return blocks.select("block", "bytes").mapInArrow(unpack, f"idx long, v {'double' if floating else 'long'}")


def write_raw(field: DataFrame, path: str, kind: str, per_block: int = 1 << 18) -> int:
    """Writes the field's values in order of idx as one raw little-endian file, in any file system that Spark knows; the bytes written.

    Tasks make the blocks and sort them; the driver appends one block after the other, as a raw file has one end, and holds no more.
    """
    spark = field.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out, total = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True), 0
    try:
        for row in to_blocks(field, KINDS[kind][0], per_block).orderBy("block").toLocalIterator():
            out.write(row["bytes"])
            total += len(row["bytes"])
    finally:
        out.close()
    return total


def write_raw_blocks(field: DataFrame, path: str, kind: str, per_block: int = 1 << 20) -> None:
    """The field's bytes as Parquet rows (block, n, bytes), written by all tasks; a raw file is their concatenation."""
    to_blocks(field, KINDS[kind][0], per_block).write.mode("overwrite").parquet(path)


def read_raw_blocks(spark: SparkSession, path: str, kind: str, per_block: int = 1 << 20) -> DataFrame:
    """(idx, v) of ``write_raw_blocks``."""
    return from_blocks(spark.read.parquet(path), KINDS[kind][0], per_block)


def padded(field: DataFrame, count: int, multiple: int) -> DataFrame:
    """The field with zeros appended up to a multiple; the inverse is a filter on idx < count."""
    more = -count % multiple
    zeros = field.sparkSession.range(count, count + more).select(F.col("id").alias("idx"), F.lit(0).cast(field.schema["v"].dataType).alias("v"))
    return field.select("idx", "v").unionByName(zeros)
