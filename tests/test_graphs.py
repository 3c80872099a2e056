"""Graphs of stages with several inputs and outputs, configurations, files, and fields of odd shapes."""

import math
import warnings
import zlib
import json
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import metrics, quantizer
from terrane.plans import config
from terrane.plans.pipeline import INT, LorenzoQuant, Pipeline, Stage, level_seconds
from terrane.sources import container, fields
from terrane.streaming import batches


def field(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, v double")


def worst(rows, back):
    both = rows.join(back.withColumnRenamed("v", "r"), "idx").select("v", "r").collect()
    return len(both), max((0.0 if r["v"] == r["r"] or r["v"] != r["v"] else abs(r["v"] - r["r"]) for r in both), default=0.0)


@dataclass(frozen=True)
class Split(Stage):
    """Even positions and odd ones."""

    ports = {"even": INT, "odd": INT}

    def forward(self, rows, taken=frozenset()):
        pick = lambda k: rows.where(F.col("idx") % 2 == k).select(F.expr("idx div 2").alias("idx"), "v")
        return {"even": pick(0), "odd": pick(1)}, {}

    def inverse(self, ports, known):
        back = lambda p, k: ports[p].select((F.col("idx") * 2 + k).alias("idx"), "v")
        return back("even", 0).unionByName(back("odd", 1))


@dataclass(frozen=True)
class Scale(Stage):
    by: int = 3

    def forward(self, rows, taken=frozenset()):
        return {"out": rows.select("idx", (F.col("v") * self.by).alias("v"))}, {}

    def inverse(self, ports, known):
        return ports["out"].select("idx", F.expr(f"v div {self.by}").alias("v"))


@dataclass(frozen=True)
class Merge(Stage):
    n_inputs = 2

    def forward(self, first, second, taken=frozenset()):
        return {"out": first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))}, {}

    def inverse(self, ports, known):
        return [ports["out"].where(F.col("side") == k).select("idx", "v") for k in (0, 1)]


def test_split_scale_and_merge(spark):
    rows = spark.range(50).select(F.col("id").alias("idx"), (F.col("id") * 7).alias("v"))
    pipe = Pipeline()
    for name, stage in (("split", Split()), ("left", Scale(3)), ("right", Scale(5)), ("merge", Merge())):
        pipe.add(name, stage)
    pipe.connect("left", "split", "even")
    pipe.connect("right", "split", "odd")
    with pytest.raises(ValueError, match="1 of 2|0 of 2|more than one source"):
        pipe.finalize()
    pipe.connect("merge", ["left", "right"])
    with pytest.raises(ValueError, match="all of its inputs"):
        pipe.connect("merge", "left")
    data = pipe.finalize().compress(rows)
    assert list(data.segments) == [("merge", "out")] and data.segments["merge", "out"].agg(F.sum("v")).first()[0] == sum(7 * i * (5 if i % 2 else 3) for i in range(50))
    assert sorted(map(tuple, pipe.decompress(data).collect())) == [(i, 7 * i) for i in range(50)]
    assert level_seconds([{"level": 0, "seconds": 1.0}, {"level": 1, "seconds": 2.0}, {"level": 1, "seconds": 3.0}]) == {0: 1.0, 1: 3.0}
    assert [r["level"] for r in pipe.profile(rows)] == [0, 1, 1, 2]


@pytest.mark.parametrize("port,then", [("outlier_errors", ["Bitshuffle"]), ("outlier_indices", ["Difference", "Rle"])])
def test_stages_behind_outlier_ports(spark, port, then):
    """Positions there are dense, and the field comes back within its bound."""
    draw = np.random.default_rng(4)
    values = 50 * np.sin(np.arange(3000) * 0.01) + np.where(draw.random(3000) < 0.02, 5000 * draw.standard_normal(3000), 0)
    pipe = Pipeline()
    pipe.add("predict", LorenzoQuant(1, "abs", 0.01, 512))
    last = "predict"
    for kind in then:
        at = pipe.add(kind, config.make_stage(kind, {}))
        pipe.connect(at, last, port if last == "predict" else None)
        last = at
    rows = field(spark, values)
    n, most = worst(rows, pipe.decompress(pipe.compress(rows)))
    assert n == 3000 and most <= 0.0101
    spark.catalog.clearCache()


@pytest.mark.parametrize("values", [[0.0] * 5, [3.5] * 700, [1.0], [1.0, -2.0], [1.0, 2.0, 4.0], [1e-3, -1e-3, 5.0, 1e4]])
@pytest.mark.parametrize("name", ["predict_huffman", "quantize_diff_zeros"])
def test_odd_fields(spark, values, name):
    """Zeros, constants, one to four elements and a tight bound."""
    rows, pipe = field(spark, values), config.preset(name, 1e-3, "abs")
    n, most = worst(rows, pipe.decompress(pipe.compress(rows)))
    assert n == len(values) and most <= 1.01e-3 + 1e-6 * max(map(abs, values))


def test_nan_and_infinity_are_outliers(spark):
    rows = field(spark, [1.0, math.nan, math.inf, -math.inf, -0.0])
    back = {r["idx"]: r["v"] for r in config.from_config({"stage": [{"name": "q", "type": "Quantizer", "error_bound": 0.1}]}).decompress(config.from_config({"stage": [{"name": "q", "type": "Quantizer", "error_bound": 0.1}]}).compress(rows)).collect()}
    assert math.isnan(back[1]) and back[2] == math.inf and back[3] == -math.inf and abs(back[0] - 1) <= 0.101


CUSZ = """
[pipeline]
memory_strategy = "PREALLOCATE"
input_size = 32768
[[stage]]
name = "lrz"
type = "LorenzoQuant"
input_type = "float32"
code_type = "uint16"
error_bound = 1e-4
error_bound_mode = "NOA"
quant_radius = 512
outlier_capacity = 0.2
zigzag_codes = true
[[stage]]
name = "huf"
type = "Huffman"
input_type = "uint16"
bklen = 1024
encode_mode = "Fine"
inputs = [{from = "lrz", port = "codes"}]
"""

PFPL = """
[[stage]]
name = "quant"
type = "Quantizer"
input_type = "float32"
code_type = "uint32"
error_bound = 1e-3
error_bound_mode = "REL"
quant_radius = 32768
outlier_capacity = 0.1
zigzag_codes = true
[[stage]]
name = "diff"
type = "Difference"
input_type = "int32"
output_type = "uint32"
chunk_size = 16384
inputs = [{from = "quant", port = "codes"}]
[[stage]]
name = "bshuf"
type = "Bitshuffle"
element_width = 2
block_size = 16384
inputs = [{from = "diff", port = "output"}]
[[stage]]
name = "rze"
type = "RZE"
levels = 4
inputs = [{from = "bshuf", port = "output"}]
"""


@pytest.mark.parametrize("text,relative", [(CUSZ, False), (PFPL, True)])
def test_configurations_by_element_types(spark, text, relative):
    values = [50 * math.sin(0.01 * i) + 20 * math.cos(0.003 * i) for i in range(6000)]
    rows, pipe = field(spark, values), config.loads(text)
    back = pipe.decompress(pipe.compress(rows)).collect()
    span = max(values) - min(values)
    assert len(back) == 6000 and all(abs(r["v"] - values[r["idx"]]) <= (1.5e-3 * abs(values[r["idx"]]) if relative else 1.01e-4 * span) for r in back)
    assert config.loads(config.dumps(pipe)).stages == pipe.stages


@pytest.mark.parametrize("entry", [{"type": "RZE", "levels": 2}, {"type": "Bitpack", "nbits": 12}, {"type": "LorenzoQuant", "code_type": "int7"}, {"type": "Zigzag", "input_type": "int16", "output_type": "uint32"}, {"type": "Huffman", "encode_mode": "odd"}, {"type": "Quantizer", "error_bound_mode": "both"}, {"type": "Nothing"}, {"type": "Rle", "unknown": 1}])
def test_bad_options(entry):
    with pytest.raises(ValueError):
        config.from_config({"stage": [{"name": "a", **entry}]})


def test_modes_of_huffman_give_the_same_bytes(spark):
    rows = spark.range(2000).select(F.col("id").alias("idx"), (F.col("id") * F.col("id") % 7).alias("v"))
    made = []
    for mode in ("Coarse", "Fine"):
        data = config.from_config({"stage": [{"name": "h", "type": "Huffman", "bklen": 8, "encode_mode": mode}]}).compress(rows)
        made.append(sorted((r["block"], bytes(r["bytes"])) for r in data.segments["h", "out"].collect()))
    assert made[0] == made[1] and len(made[0]) == 3


def test_in_place_radii_that_could_be_confused_are_refused(spark):
    with pytest.raises(ValueError, match="read as a code"):
        quantizer.in_place(field(spark, [1e9]), 1e-4, 1 << 30)
    back = quantizer.from_in_place(quantizer.in_place(field(spark, [1e9, 0.01, -7e8]), 1e-4, 512), 1e-4, 512).orderBy("idx").collect()
    assert [r["v"] for r in back] == [1e9, pytest.approx(0.01, abs=1.01e-4), -7e8]


def test_values_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="don't fit 16 bits"):
        fields.to_blocks(spark.createDataFrame([(0, 70000)], "idx long, v long"), "<u2", 8).collect()


def test_raw_files(spark, tmp_path):
    values = np.arange(6000, dtype="<f4")
    (tmp_path / "a.f32").write_bytes(values.tobytes())
    for whole in (1 << 20, 100):  # as one row, and in records
        rows = fields.read_raw(spark, f"file://{tmp_path}/a.f32", "f32", whole).orderBy("idx").collect()
        assert [(r["idx"], r["v"]) for r in rows] == [(i, float(v)) for i, v in enumerate(values)]
    assert fields.write_raw(fields.read_raw(spark, f"file://{tmp_path}/a.f32", "f32").select("idx", "v"), f"file://{tmp_path}/b.f32", "f32", 512) == 24000
    assert (tmp_path / "b.f32").read_bytes() == values.tobytes()
    fields.write_raw_blocks(fields.read_raw(spark, f"file://{tmp_path}/a.f32", "f32").select("idx", "v"), f"file://{tmp_path}/blocks", "f32", 512)
    assert fields.read_raw_blocks(spark, f"file://{tmp_path}/blocks", "f32", 512).agg(F.sum("v")).first()[0] == values.astype(float).sum()
    (tmp_path / "bad.f32").write_bytes(b"12345")
    with pytest.raises(ValueError, match="multiple of 4"):
        fields.read_raw(spark, f"file://{tmp_path}/bad.f32", "f32")
    with pytest.raises(FileNotFoundError):
        fields.read_raw(spark, f"file://{tmp_path}/none.f32", "f32")


def test_versions_of_containers(spark, tmp_path):
    rows, pipe, path = field(spark, range(100)), config.preset("predict_huffman"), str(tmp_path / "c")
    container.write(spark, pipe, pipe.compress(rows), path)
    body = json.loads(spark.read.parquet(f"{path}/manifest").first()["manifest"])
    for key, value in (("minor", 9), ("major", 9), ("magic", "other")):
        text = json.dumps(body | {key: value})
        spark.createDataFrame([(text, zlib.crc32(text.encode()))], "manifest string, crc32 long").write.mode("overwrite").parquet(f"{path}/manifest")
        if key == "minor":
            with pytest.warns(UserWarning, match="1.9"):
                assert container.decompress(spark, path).count() == 100
        else:
            with pytest.raises(ValueError):
                container.read(spark, path)
    spark.createDataFrame([], "manifest string, crc32 long").write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="damaged"):
        container.read(spark, path)
    warnings.resetwarnings()


def test_a_quantized_stream_keeps_its_time(spark, tmp_path):
    rows = spark.range(300).selectExpr("id as idx", "cast(id as double) * 100 as v", "timestamp_seconds(id * 10) as at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    windows = batches.windowed_error(batches.quantized_stream(stream, 0.01, 512), "at")
    query = windows.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.table("windows").orderBy("window").collect()
    assert len(out) >= 7 and all(r["n"] == 30 for r in out) and out[1]["n_outliers"] == 30


def test_metrics_of_time_and_size(spark):
    seen = []
    rows = metrics.timed({"a": lambda: seen.append(1), "b": lambda: seen.append(2)}, 1000)
    assert [r["name"] for r in rows] == ["a", "b"] and seen == [1, 2] and all(r["gb_per_s"] > 0 for r in rows)
    pipe = config.preset("lorenzo_bitpack")
    assert pipe.max_compressed_size(1000) == int(1.05 * (4016 + 16 + 2 * 4016))
