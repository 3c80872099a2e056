"""Pipelines over streams: each micro-batch is a field of its own, coded block by block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrane.operators.quantizer import quantize


def quantized_stream(stream: DataFrame, eb: float, radius: int = 32768) -> DataFrame:
    """A stream (idx, v) with codes; an absolute bound needs no state. Other columns, such as a time, stay."""
    return quantize(stream, "abs", eb, radius)


def windowed_error(stream: DataFrame, time_column: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """The outlier share of a quantized stream in windows of event time; rows later than ``late`` are dropped."""
    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, width)).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("n_outliers"))


def compress_stream(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that hands every micro-batch and its number to ``work``, which may compress and write it."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
