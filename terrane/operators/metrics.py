"""What a reconstruction is worth, and what codes cost."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconstruction(original: DataFrame, back: DataFrame) -> DataFrame:
    """One row: n, mse, rmse, mae, max_error with its first index, value_range, psnr (infinite without error, 0 without range) and nrmse."""
    both = original.select("idx", F.col("v").cast("double").alias("o")).join(back.select("idx", F.col("v").cast("double").alias("r")), "idx")
    error = F.abs(F.col("o") - F.col("r"))
    top = F.max(F.struct(error.alias("e"), (-F.col("idx")).alias("i")))
    row = both.agg(F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("mse"), F.avg(error).alias("mae"), top.alias("top"), (F.max("o") - F.min("o")).alias("value_range"))
    inf = F.lit(float("inf"))
    psnr = F.when(F.col("value_range") == 0, 0.0).when(F.col("mse") == 0, inf).otherwise(20 * F.log10(F.when(F.col("value_range") > 0, F.col("value_range"))) - 10 * F.log10(F.when(F.col("mse") > 0, F.col("mse"))))
    nrmse = F.when(F.col("value_range") == 0, 0.0).otherwise(F.sqrt("mse") / F.col("value_range"))
    return row.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", F.col("top.e").alias("max_error"), (-F.col("top.i")).alias("max_error_index"), "value_range", psnr.alias("psnr"), nrmse.alias("nrmse"))


def within_bound(original: DataFrame, back: DataFrame, eb: float) -> DataFrame:
    """One row: the share of values whose error is at most eb."""
    both = original.select("idx", F.col("v").alias("o")).join(back.select("idx", F.col("v").alias("r")), "idx")
    return both.agg((100.0 * F.count_if(F.abs(F.col("o") - F.col("r")) <= eb) / F.count(F.lit(1))).alias("percent_within"))


def entropy(codes: DataFrame, column: str = "code") -> DataFrame:
    """One row: Shannon entropy in bits a symbol, from counts by symbol: log2 N - sum(c log2 c) / N."""
    counts = codes.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    return counts.agg(n.alias("n"), F.count(F.lit(1)).alias("n_symbols"), (F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("bits_per_symbol"))


def centred_histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """value, n for the values within ``bins`` of 0."""
    return rows.where(F.abs(column) <= bins).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def wide_histogram(rows: DataFrame, column: str, buckets: int) -> DataFrame:
    """bucket, n over ``buckets`` equal steps from the least value to the greatest, which one broadcast row gives."""
    span = rows.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    at = F.least(F.floor((F.col(column) - F.col("low")) * buckets / F.col("width")), F.lit(buckets - 1))
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    return rows.crossJoin(F.broadcast(span)).withColumn("width", width).groupBy(at.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, column: str, bins: int = 20, buckets: int = 40, least_share: float = 0.05) -> DataFrame:
    """low, n: the values within ``bins`` of 0 one by one, or, where these are at most ``least_share`` of all, ``buckets`` equal steps from
    the least value to the greatest. One row of counts reaches the driver."""
    share = rows.agg(F.count_if(F.abs(column) <= bins) / F.greatest(F.count(F.lit(1)), F.lit(1))).first()[0]
    if share > least_share:
        return centred_histogram(rows, column, bins).select(F.col("value").cast("double").alias("low"), "n")
    span = rows.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    step = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / buckets).otherwise(1.0 / buckets)
    return wide_histogram(rows, column, buckets).crossJoin(F.broadcast(span)).select((F.col("low") + F.col("bucket") * step).alias("low"), "n")


def compression(raw: DataFrame, coded: DataFrame) -> DataFrame:
    """One row: bytes of binary blocks before and after, and their ratio (infinite if nothing is left)."""
    size = lambda rows, name: rows.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0)).cast("long").alias(name))
    both = size(raw, "raw_bytes").crossJoin(F.broadcast(size(coded, "coded_bytes")))  # one row each
    ratio = F.when(F.col("coded_bytes") > 0, F.col("raw_bytes") / F.when(F.col("coded_bytes") > 0, F.col("coded_bytes"))).otherwise(F.lit(float("inf")))
    return both.select("raw_bytes", "coded_bytes", ratio.alias("ratio"))


def timed(actions: dict, raw_bytes: int) -> list[dict]:
    """Seconds and GB/s of each named action, run one after the other."""
    out = []
    for name, action in actions.items():
        start = time.perf_counter()
        action()
        seconds = time.perf_counter() - start
        out.append({"name": name, "seconds": seconds, "gb_per_s": raw_bytes / seconds / 1e9})
    return out
