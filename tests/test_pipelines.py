import math

import pytest
from pyspark.sql import functions as F

from terrane.plans import config
from terrane.plans.pipeline import Bitpack, Huffman, LorenzoQuant, Pipeline, Rze
from terrane.sources import container


def smooth(spark, n=4096):
    return spark.range(n).select(F.col("id").alias("idx"), (50 * F.sin(F.col("id") * 0.01) + 20 * F.cos(F.col("id") * 0.003)).alias("v"))


def error(a, b):
    return a.join(b.withColumnRenamed("v", "r"), "idx").agg(F.max(F.abs(F.col("v") - F.col("r"))), F.count(F.lit(1))).first()


@pytest.mark.parametrize("name", ["predict_huffman", "lorenzo_bitpack", "quantize_diff_zeros", "speed"])
def test_presets_keep_their_bound(spark, name):
    rows, pipe = smooth(spark), config.preset(name, 1e-3)
    most, n = error(rows, pipe.decompress(pipe.compress(rows)))
    assert n == 4096 and most <= 1e-3 * 140 * 1.01


def test_chain(spark):
    rows, pipe = smooth(spark, 1000), config.from_chain("lorenzo->bitshuffle->rze", "abs", 0.01)
    most, n = error(rows, pipe.decompress(pipe.compress(rows)))
    assert n == 1000 and most <= 0.0101
    assert pipe.max_compressed_size(1000) > 4000
    with pytest.raises(ValueError):
        config.from_chain("lorenzo->nothing")


def test_two_dimensions(spark):
    rows = smooth(spark, 64 * 40).selectExpr("idx", "v", "idx % 64 as x", "idx div 64 as y", "0L as z")
    pipe = Pipeline((64, 40, 1))
    pipe.add("predict", LorenzoQuant(2, "abs", 0.01))
    most, n = error(rows.select("idx", "v"), pipe.decompress(pipe.compress(rows)))
    assert n == 64 * 40 and most <= 0.0101


def test_bad_graphs():
    with pytest.raises(ValueError, match="no stages"):
        Pipeline().finalize()
    p = Pipeline()
    p.add("a", LorenzoQuant())
    p.add("b", Rze())
    with pytest.raises(ValueError, match="more than one source"):
        p.finalize()
    with pytest.raises(ValueError, match="no port"):
        p.connect("b", "a", "nothing")
    p.connect("b", "a")
    with pytest.raises(ValueError, match="takes blocks"):
        p.finalize()
    p = Pipeline()
    p.add("a", Bitpack(8))
    p.add("b", Bitpack(8))
    p.connect("a", "b")
    p.connect("b", "a")
    with pytest.raises(ValueError, match="cycle"):
        p.finalize()
    with pytest.raises(ValueError, match="two stages"):
        p.add("a", Huffman())


def test_toml_round_trip(tmp_path):
    pipe = config.preset("quantize_diff_zeros")
    (tmp_path / "p.toml").write_text(config.dumps(pipe))
    again = config.load(str(tmp_path / "p.toml"))
    assert again.stages == pipe.stages and again.inputs == pipe.inputs
    assert again.stages["quantize"].outlier_threshold == math.inf


def test_container(spark, tmp_path):
    rows, pipe, path = smooth(spark, 2000), config.preset("predict_huffman"), str(tmp_path / "c")
    container.write(spark, pipe, pipe.compress(rows), path)
    most, n = error(rows, container.decompress(spark, path))
    assert n == 2000 and most <= 0.15
    spark.createDataFrame([(0, 5, b"x")], "block long, n long, bytes binary").write.mode("overwrite").parquet(f"{path}/code.out")
    with pytest.raises(ValueError, match="damaged"):
        container.read(spark, path)
    spark.createDataFrame([("{}", 1)], "manifest string, crc32 long").write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        container.read(spark, path)


def test_stream(spark, tmp_path):
    from terrane.streaming.batches import compress_stream, quantized_stream

    smooth(spark, 500).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("idx long, v double").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    compress_stream(quantized_stream(stream, 0.01), lambda df, i: df.select("idx", "code").write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 500
