import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import numeric
from terrane.operators import coders, metrics, predictors, quantizer
from terrane.sources import fields


def field(spark, values, kind="long"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"idx long, v {kind}")


def back(df):
    return [r["v"] for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize("bits", [8, 16])
def test_zigzag_and_negabinary_are_exact_for_every_value(spark, bits):
    rows = spark.range(-(1 << bits - 1), 1 << bits - 1).select(F.col("id").alias("v"))
    for encode, decode in ((numeric.zigzag(F.col("v"), bits), numeric.unzigzag), (numeric.negabinary(F.col("v"), bits), lambda c: numeric.unnegabinary(c, bits))):
        out = rows.withColumn("u", encode).withColumn("b", decode(F.col("u")))
        r = out.agg(F.sum((F.col("b") != F.col("v")).cast("int")), F.min("u"), F.max("u"), F.countDistinct("u")).first()
        assert tuple(r) == (0, 0, (1 << bits) - 1, 1 << bits)


def test_64_bit_negabinary_wraps(spark):
    values = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 12345678901234567]
    rows = field(spark, values).withColumn("u", numeric.negabinary(F.col("v"), 64)).withColumn("b", numeric.unnegabinary(F.col("u"), 64))
    assert [r["b"] for r in rows.orderBy("idx").collect()] == values


def test_quantizer_bounds_zeros_and_special_values(spark):
    values = [0.0, 1.0, -2.5, 1e9, float("nan"), float("inf"), 3.25]
    rows = quantizer.quantize(field(spark, values, "double"), "abs", 0.125, 1000)
    got = {r["idx"]: r["is_outlier"] for r in rows.collect()}
    assert [got[i] for i in range(7)] == [False, False, False, True, True, True, False]
    restored = back(quantizer.dequantize(rows.select("idx", "code"), quantizer.outliers(rows), 0.125))
    assert np.allclose(restored, values, atol=0.126, equal_nan=True)
    rel = quantizer.quantize_rel(field(spark, values, "double"), 1e-3)
    assert rel.where("idx in (0, 4, 5) and not is_outlier").count() == 0
    for a, b in zip(values, back(quantizer.dequantize_rel(rel, quantizer.outliers(rel), 1e-3)), strict=True):
        assert a != a and b != b or a == b or abs(a - b) <= 1.5e-3 * abs(a)


def test_constant_field_has_no_range(spark):
    rows = quantizer.quantize(field(spark, [7.0] * 5, "double"), "noa", 0.5)
    assert rows.where("is_outlier").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 600])
def test_lossless_round_trips(spark, n):
    values = [(i * 7919) % 1000 - 500 for i in range(n)]
    rows = field(spark, values)
    assert back(predictors.unlorenzo(predictors.lorenzo(rows).select("idx", "delta"))) == values
    assert back(predictors.undifference(predictors.difference(rows, 0, 32, True, block=64), 0, 32, True)) == values
    assert back(coders.unrle(coders.rle(field(spark, [v // 300 for v in values]), block=64))) == [v // 300 for v in values]


def test_bitshuffle_planes_have_the_highest_bit_first(spark):
    rows = spark.range(1024).select(F.col("id").alias("idx"), F.lit(0x80000000).cast("long").alias("v"))
    planes = coders.bitshuffle(rows, 4, 4096)
    assert {(r["plane"], r["value"]) for r in planes.collect()} == {(p, 0xFFFFFFFF if p == 0 else 0) for p in range(32)}


@pytest.mark.parametrize("width", [1, 2, 4, 8])
def test_bitshuffle_bytes_agree_with_planes(spark, width):
    random = np.random.default_rng(width)
    values = random.integers(0, 1 << min(62, 8 * width), 1024).tolist()
    rows, size = field(spark, values), 1024 * width
    lanes = 8 if width == 8 else 4
    block = coders.bitshuffle_blocks(fields.to_blocks(rows, f"<u{width}", 1024), width, size)
    words = np.frombuffer(block.first()["bytes"], f"<u{lanes}").astype(np.uint64).view(np.int64).tolist()
    logical = [r["value"] for r in coders.bitshuffle(rows, width, size).orderBy("plane", "word").collect()]
    assert words == logical
    assert back(coders.unbitshuffle(coders.bitshuffle(rows, width, size), width, size)) == values
    assert back(fields.from_blocks(coders.unbitshuffle_blocks(block, width, size), f"<u{width}", 1024)) == values


@pytest.mark.parametrize("kind", ["zeros", "ones", "sparse", "random", "partial", "empty"])
def test_zero_elimination(kind):
    random = np.random.default_rng(3)
    data = {"zeros": bytes(16384), "ones": b"\1" * 16384, "sparse": bytes(9000) + b"\5" + bytes(7383), "random": random.bytes(16384), "partial": b"ab\0\0c" * 20, "empty": b""}[kind]
    assert coders.decode_chunk(coders.encode_chunk(data), len(data)) == data
    assert kind not in ("zeros", "sparse") or len(coders.encode_chunk(data)) < 100


def test_bitpack(spark):
    rows = field(spark, [1, 0, 3, 2, 1])
    assert back(coders.bitunpack(coders.bitpack(rows, 2), 2, 5)) == [1, 0, 3, 2, 1]
    assert coders.detect_nbits(rows).first()["nbits"] == 2
    with pytest.raises(ValueError):
        coders.check_nbits(12)


def test_huffman(spark):
    values = [0] * 900 + [1] * 90 + [5] * 10
    rows = field(spark, values)
    book = coders.codebook(rows, 6)
    assert back(coders.unhuffman(coders.huffman(rows, book), book)) == values
    with pytest.raises(ValueError, match="10 values"):
        coders.codebook(rows, 5)


def test_metrics(spark):
    a, b = field(spark, [0.0, 1.0, 3.0], "double"), field(spark, [0.0, 2.0, 2.0], "double")
    r = metrics.reconstruction(a, b).first()
    assert (r["n"], r["max_error"], r["max_error_index"], r["value_range"]) == (3, 1.0, 1, 3.0)
    assert metrics.reconstruction(a, a).first()["psnr"] == float("inf")


def test_raw_files(spark, tmp_path):
    (tmp_path / "a.f32").write_bytes(np.arange(5, dtype="<f4").tobytes())
    assert back(fields.read_raw(spark, str(tmp_path / "a.f32"), "f32")) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="multiple"):
        fields.read_raw(spark, str(tmp_path / "a.f32"), "f64").collect()
    assert fields.parse_dims("4x3", 12) == (4, 3, 1)
    with pytest.raises(ValueError):
        fields.parse_dims("4x3", 13)
