"""Direct quantization of values with an absolute, range-relative or pointwise-relative bound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.numeric import as_float, half_even, mask, signed, unzigzag, zigzag


def value_range(field: DataFrame) -> DataFrame:
    """One row: base, the range of the values."""
    return field.agg((F.max("v") - F.min("v")).cast("double").alias("base"))


def with_bound(field: DataFrame, mode: str, eb: float, base: float | None = None) -> DataFrame:
    """The field with its absolute bound ``eb``: abs; noa (times the range, a zero range counts as 1); rel (times the largest magnitude).

    A ``base`` given saves the scan. Otherwise one row of a partial and final aggregate is broadcast.
    """
    if mode == "abs":
        return field.withColumn("eb", F.lit(as_float(eb)))
    if base:
        return field.withColumn("eb", F.lit(as_float(eb) * base))
    one = value_range(field) if mode == "noa" else field.agg(F.max(F.abs("v")).cast("double").alias("base"))
    one = one.select(F.when(F.col("base") > 0, F.lit(as_float(eb)) * F.col("base")).otherwise(F.lit(as_float(eb))).alias("eb"))
    return field.crossJoin(F.broadcast(one))  # a single row


def _outside(threshold: float) -> Column:
    return F.abs(F.col("v")) >= F.lit(threshold) if math.isfinite(threshold) else F.lit(False)


def quantize(field: DataFrame, mode: str = "abs", eb: float = 1e-4, radius: int = 32768, threshold: float = math.inf, use_zigzag: bool = False, code_bits: int = 32, base: float | None = None) -> DataFrame:
    """The field with q, is_outlier and code: q = value / (2 eb) in single precision, halves to even. Outliers have code 0 and keep their value.

    Other columns stay. NaN and infinities are outliers. Codes are two's complement of the code's width, or zigzag.
    """
    bounded = with_bound(field, mode, eb, base)
    scaled = F.col("v").cast("float") * (F.lit(1.0) / (F.lit(2.0) * F.col("eb"))).cast("float")
    bad = F.isnan("v") | (F.abs("v") == F.lit(math.inf)) | _outside(threshold)
    q = F.when(bad, F.lit(None)).otherwise(half_even(scaled))
    q = F.when(F.abs(q) < radius, q.cast("long"))
    rows = bounded.withColumn("q", q)
    code = zigzag(F.col("q"), code_bits) if use_zigzag else mask(F.col("q"), code_bits)
    return rows.withColumns({"is_outlier": F.col("q").isNull(), "code": F.coalesce(code, F.lit(0))})


def outliers(quantized: DataFrame, capacity: int | None = None) -> DataFrame:
    """idx and v of the outliers; with a strict capacity the first ones by idx only, and the rest is lost, as the flag says."""
    rows = quantized.where("is_outlier").select("idx", "v")
    return rows if capacity is None else rows.orderBy("idx").limit(capacity)


def outlier_report(quantized: DataFrame, capacity_share: float = 0.05) -> DataFrame:
    """n, n_outliers, capacity and how many outliers a strict capacity would drop."""
    n, k = F.count(F.lit(1)), F.count_if("is_outlier")
    cap = F.ceil(n * F.lit(capacity_share))
    return quantized.agg(n.alias("n"), k.alias("n_outliers"), cap.alias("capacity"), F.greatest(k - cap, F.lit(0)).alias("n_overflow"))


def dequantize(codes: DataFrame, kept: DataFrame, eb: float, use_zigzag: bool = False, code_bits: int = 32) -> DataFrame:
    """idx, v from codes (idx, code, and eb if it is a column) and outliers (idx, v): a left join on the position."""
    q = unzigzag(F.col("code")) if use_zigzag else signed(F.col("code"), code_bits)
    bound = F.col("eb") if "eb" in codes.columns else F.lit(as_float(eb))
    back = codes.select("idx", (q.cast("double") * 2 * bound).alias("r"))
    return back.join(kept.withColumnRenamed("v", "o"), "idx", "left").select("idx", F.coalesce("o", "r").alias("v"))


def quantize_rel(field: DataFrame, eb: float = 1e-3, radius: int = 1 << 20, threshold: float = math.inf) -> DataFrame:
    """Pointwise-relative: idx, v, bin, is_outlier, code. The bin of log2 |v| is verified against the bound; what fails is an outlier.

    Zeros, denormals, NaN, infinities and values at the threshold are outliers. code = ((|bin| << 2) | bin < 0 << 1 | v < 0) + 1; 0 is for outliers.
    """
    e = as_float(eb)
    step = 2 * math.log2(1 + e)
    size = F.abs(F.col("v").cast("double"))
    fine = ~F.isnan("v") & (size < F.lit(3.4028234663852886e38)) & (size >= F.lit(1.1754943508222875e-38)) & ~_outside(threshold)
    b = F.when(fine, half_even(F.log2(F.when(fine, size)) / F.lit(step)))
    near = F.pow(F.lit(2.0), b * F.lit(step))
    good = fine & (near >= size / F.lit(1 + e)) & (near <= size * F.lit(1 + e)) & (F.abs(b) < radius)
    rows = field.withColumn("bin", F.when(good, b.cast("long")))
    code = F.shiftleft(F.abs("bin"), 2) + F.when(F.col("bin") < 0, 2).otherwise(0) + F.when(F.col("v") < 0, 1).otherwise(0) + 1
    return rows.select("idx", "v", "bin", F.col("bin").isNull().alias("is_outlier"), F.coalesce(code, F.lit(0)).cast("long").alias("code"))


def dequantize_rel(codes: DataFrame, kept: DataFrame, eb: float) -> DataFrame:
    step = 2 * math.log2(1 + as_float(eb))
    c = F.col("code") - 1
    b = F.shiftright(c, 2) * F.when(c.bitwiseAND(F.lit(2)) != 0, -1).otherwise(1)
    value = F.when(F.col("code") != 0, F.pow(F.lit(2.0), b * F.lit(step)) * F.when(c.bitwiseAND(F.lit(1)) != 0, -1).otherwise(1))
    return codes.select("idx", value.alias("r")).join(kept.withColumnRenamed("v", "o"), "idx", "left").select("idx", F.coalesce("o", "r").alias("v"))


def check_in_place(eb: float, radius: int) -> None:
    """Whether every outlier's bits read as a number that no code has. Outliers have a magnitude of 2 eb (radius - 1/2) at least."""
    least = np.float32(2 * as_float(eb) * (radius - 1))
    if int(least.view(np.uint32)) >> 1 < radius:
        raise ValueError(f"with a bound of {eb} and a radius of {radius}, an outlier could read as a code")


def in_place(field: DataFrame, eb: float, radius: int = 32768) -> DataFrame:
    """idx, code: zigzag codes, with an outlier's single-precision bits in the place of its code.

    The decoder takes what is no code in range for an outlier; bounds and radii for which the two could be confused are an error.
    """
    check_in_place(eb, radius)

    @F.pandas_udf("long")
    def bits(v: pd.Series) -> pd.Series:
        return pd.Series(v.astype("float32").to_numpy().view("uint32").astype("int64"))

    rows = quantize(field, "abs", eb, radius, use_zigzag=True)
    return rows.select("idx", F.when(F.col("is_outlier"), bits(F.col("v").cast("double"))).otherwise(F.col("code")).alias("code"))


def from_in_place(codes: DataFrame, eb: float, radius: int = 32768) -> DataFrame:
    @F.pandas_udf("double")
    def value(c: pd.Series) -> pd.Series:
        return pd.Series(c.to_numpy().astype("uint32").view("float32").astype("float64"))

    raw = F.shiftrightunsigned("code", 1) >= radius
    return codes.select("idx", F.when(raw, value("code")).otherwise(unzigzag(F.col("code")).cast("double") * F.lit(2 * as_float(eb))).alias("v"))
