"""Self-describing containers: a folder with the segments as Parquet, and a manifest that tells how to undo them.

The manifest has a magic word, a version, the pipeline, what each stage must know, and for each segment its rows, bytes and a CRC-32
that does not depend on the order of rows. It has a CRC of its own.
"""

from __future__ import annotations

import json
import warnings
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.plans.config import from_config
from terrane.plans.pipeline import Compressed, Pipeline

MAGIC, MAJOR, MINOR = "TERRANE", 1, 0


def _facts(rows: DataFrame) -> tuple[int, int, int]:
    """Rows, bytes and checksum: the sum modulo 2^32 of the CRC-32 of each row."""
    width = F.length("bytes") if "bytes" in rows.columns else F.lit(8)
    crc = F.crc32(F.to_json(F.struct(*sorted(rows.columns))).cast("binary"))
    r = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0)), F.coalesce(F.sum(crc), F.lit(0))).first()
    return r[0], r[1], r[2] % (1 << 32)


def align16(c):
    return F.expr(f"(({c} + 15) div 16) * 16")


def layout(manifest: DataFrame) -> DataFrame:
    """segment, data_size and byte_offset if the segments stood in one file: a head of 4 + 8 for each, then 16-byte slots."""
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # one row a segment
    head = F.lit(4) + 8 * F.count(F.lit(1)).over(Window.partitionBy())
    rows = manifest.withColumn("slot", align16("data_size")).withColumn("head", head)
    return rows.select("segment", "data_size", (align16("head") + F.coalesce(F.sum("slot").over(before), F.lit(0))).alias("byte_offset"))


def write(spark: SparkSession, pipe: Pipeline, data: Compressed, path: str) -> None:
    segments = []
    for (stage, port), rows in data.segments.items():
        rows.write.mode("overwrite").parquet(f"{path}/{stage}.{port}")
        n, size, crc = _facts(spark.read.parquet(f"{path}/{stage}.{port}"))
        segments.append({"stage": stage, "port": port, "rows": n, "bytes": size, "crc32": crc})
    body = {"magic": MAGIC, "major": MAJOR, "minor": MINOR, "pipeline": pipe.describe(), "known": data.known, "segments": segments}
    text = json.dumps(body, sort_keys=True)
    spark.createDataFrame([(text, zlib.crc32(text.encode()))], "manifest string, crc32 long").write.mode("overwrite").parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, verify: bool = True) -> tuple[Pipeline, Compressed]:
    """The pipeline and its segments. A wrong magic word, another major version or a failed checksum is an error, another minor version a warning."""
    row = spark.read.parquet(f"{path}/manifest").first()
    if row is None or zlib.crc32(row["manifest"].encode()) != row["crc32"]:
        raise ValueError("the manifest is damaged")
    body = json.loads(row["manifest"])
    if body.get("magic") != MAGIC:
        raise ValueError("not a container")
    if body["major"] != MAJOR:
        raise ValueError(f"version {body['major']}.{body['minor']} can't be read")
    if body["minor"] != MINOR:
        warnings.warn(f"the container has version {body['major']}.{body['minor']}, this library writes {MAJOR}.{MINOR}", stacklevel=2)
    segments = {}
    for s in body["segments"]:
        rows = spark.read.parquet(f"{path}/{s['stage']}.{s['port']}")
        if verify and _facts(rows) != (s["rows"], s["bytes"], s["crc32"]):
            raise ValueError(f"segment {s['stage']}.{s['port']} is damaged")
        segments[s["stage"], s["port"]] = rows
    return from_config(body["pipeline"]), Compressed(segments, body["known"])


def decompress(spark: SparkSession, path: str) -> DataFrame:
    pipe, data = read(spark, path)
    return pipe.decompress(data)
