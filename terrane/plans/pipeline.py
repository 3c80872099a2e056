"""Pipelines of stages: built as a graph, checked, run forward to segments and backward to the field."""

from __future__ import annotations

import math
import time
from dataclasses import asdict, dataclass, field, fields

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import numeric
from terrane.operators import coders, predictors, quantizer
from terrane.sources.fields import coordinates, from_blocks, indexed, padded, to_blocks

FLOAT, INT, BLOCKS = "float", "int", "blocks"


@dataclass(frozen=True)
class Stage:
    """One transformation. ``forward`` gives a DataFrame for each port and what the inverse must know; configurations never change.

    A stage takes one input, or ``n_inputs``; then ``forward`` gets them in the order of the connections and ``inverse`` gives a list.
    ``taken`` names the ports that other stages take: positions in these must be dense, from 0 without gaps.
    """

    takes = INT
    ports = {"out": INT}
    n_inputs = 1
    dims = 1
    align = 1  # elements that a whole unit of the stage has, for padding

    def forward(self, *rows: DataFrame, taken: frozenset[str] = frozenset()) -> tuple[dict[str, DataFrame], dict]:
        raise NotImplementedError

    def inverse(self, ports: dict[str, DataFrame], known: dict) -> DataFrame | list[DataFrame]:
        raise NotImplementedError


def _outlier_ports(kept: DataFrame, values: str, places: str, taken: frozenset[str], dense: Column) -> dict[str, DataFrame]:
    """Outliers (idx, v) as two ports of values and positions. Where no stage takes one, both stay at their positions; else they are
    numbered by rank, and values that another stage takes are made non-negative."""
    if not taken & {values, places}:
        return {values: kept, places: kept.select("idx", F.col("idx").alias("v"))}
    ranked = indexed(kept, "idx", F.struct("idx", dense.alias("v")))
    return {values: ranked.select("idx", "v.v"), places: ranked.select("idx", F.col("v.idx").alias("v"))}


def _outliers_back(values: DataFrame, places: DataFrame, known: dict, undo) -> DataFrame:
    rows = places.select("idx", F.col("v").alias("at")).join(values.select("idx", "v"), "idx").select(F.col("at").alias("idx"), "v")
    return rows.withColumn("v", undo(F.col("v"))) if known["dense"] else rows


def _capped(out: DataFrame, share: float, strict: bool) -> DataFrame:
    """With a strict capacity, outliers beyond the first ceil(n * share) by position are lost: their code of 0 is all that is left."""
    if not strict:
        return out
    lost = out.where("is_outlier").select("idx")
    room = math.ceil(out.count() * share)
    rank = indexed(lost, "idx", F.col("idx")).where(F.col("idx") >= room).select(F.col("v").alias("idx"), F.lit(True).alias("lost"))
    return out.join(rank, "idx", "left").withColumn("is_outlier", F.col("is_outlier") & F.col("lost").isNull()).drop("lost")


def _absolute(rows: DataFrame, mode: str, eb: float, base: float) -> float:
    """The absolute bound as a number, which the inverse must know."""
    if mode == "abs":
        return numeric.as_float(eb)
    if base:
        return numeric.as_float(eb) * base
    return quantizer.with_bound(rows, mode, eb).agg(F.max("eb")).first()[0] or numeric.as_float(eb)


@dataclass(frozen=True)
class LorenzoQuant(Stage):
    """Predicts and quantizes. All outliers are kept, however many; ``strict_capacity`` keeps the share ``outlier_capacity`` only."""

    dims: int = 1
    error_mode: str = "abs"
    error_bound: float = 1e-4
    quant_radius: int = 32768
    zigzag_codes: bool = False
    value_base: float = 0.0
    code_bits: int = 32
    outlier_capacity: float = 0.2
    strict_capacity: bool = False

    takes = FLOAT
    ports = {"codes": INT, "outlier_errors": INT, "outlier_indices": INT}

    def __post_init__(self):
        if 2 * self.quant_radius > 1 << self.code_bits:
            raise ValueError(f"codes of a radius of {self.quant_radius} don't fit {self.code_bits} bits")

    def forward(self, rows, taken=frozenset()):
        eb = _absolute(rows, self.error_mode, self.error_bound, self.value_base)
        out = predictors.lorenzo_quantize(rows, self.dims, "noa", 1.0, self.quant_radius, self.zigzag_codes, self.code_bits, base=eb)
        out = _capped(out, self.outlier_capacity, self.strict_capacity)
        place = [c for c in ("x", "y", "z") if c in rows.columns]
        codes = out.select("idx", F.col("code").alias("v"), *place)
        kept = out.where("is_outlier").select("idx", F.col("delta").alias("v"))
        ports = _outlier_ports(kept, "outlier_errors", "outlier_indices", taken, numeric.zigzag(F.col("v"), 64))
        return {"codes": codes, **ports}, {"eb": eb, "dense": bool(taken - {"codes"})}

    def inverse(self, ports, known):
        codes = ports["codes"].withColumnRenamed("v", "code")
        if self.dims > 1 and "x" not in codes.columns:
            codes = coordinates(codes, *known["dims"])
        kept = _outliers_back(ports["outlier_errors"], ports["outlier_indices"], known, numeric.unzigzag).withColumnRenamed("v", "delta")
        return predictors.lorenzo_reconstruct(codes, kept, self.dims, known["eb"], self.zigzag_codes, self.code_bits).select("idx", "v")


@dataclass(frozen=True)
class Quantizer(Stage):
    """Quantizes directly. ``inplace_outliers`` puts an outlier's bits where its code would be; there are no outlier ports then."""

    error_mode: str = "abs"
    error_bound: float = 1e-4
    quant_radius: int = 32768
    zigzag_codes: bool = False
    outlier_threshold: float = math.inf
    value_base: float = 0.0
    code_bits: int = 32
    outlier_capacity: float = 0.05
    strict_capacity: bool = False
    inplace_outliers: bool = False

    takes = FLOAT

    def __post_init__(self):
        if self.inplace_outliers and (self.error_mode == "rel" or math.isfinite(self.outlier_threshold)):
            raise ValueError("outliers in place take an absolute or range-relative bound and no threshold")

    @property
    def ports(self):
        return {"codes": INT} if self.inplace_outliers else {"codes": INT, "outlier_vals": FLOAT, "outlier_idxs": INT}

    def forward(self, rows, taken=frozenset()):
        if self.error_mode == "rel":
            out, eb = quantizer.quantize_rel(rows, self.error_bound, self.quant_radius, self.outlier_threshold), self.error_bound
        else:
            eb = _absolute(rows, self.error_mode, self.error_bound, self.value_base)
            if self.inplace_outliers:
                return {"codes": quantizer.in_place(rows, eb, self.quant_radius).select("idx", F.col("code").alias("v"))}, {"eb": eb}
            out = quantizer.quantize(rows, "noa", 1.0, self.quant_radius, self.outlier_threshold, self.zigzag_codes, self.code_bits, base=eb)
        out = _capped(out, self.outlier_capacity, self.strict_capacity)
        ports = _outlier_ports(quantizer.outliers(out), "outlier_vals", "outlier_idxs", taken, F.col("v"))
        return {"codes": out.select("idx", F.col("code").alias("v")), **ports}, {"eb": eb, "dense": bool(taken - {"codes"})}

    def inverse(self, ports, known):
        codes = ports["codes"].withColumnRenamed("v", "code")
        if self.inplace_outliers:
            return quantizer.from_in_place(codes, known["eb"], self.quant_radius)
        kept = _outliers_back(ports["outlier_vals"], ports["outlier_idxs"], known, lambda v: v)
        if self.error_mode == "rel":
            return quantizer.dequantize_rel(codes, kept, known["eb"])
        return quantizer.dequantize(codes.withColumn("eb", F.lit(known["eb"])), kept, 0.0, self.zigzag_codes, self.code_bits)


@dataclass(frozen=True)
class Lorenzo(Stage):
    """Lossless prediction: in blocks of 256 in one dimension, over the whole field in two or three."""

    bits: int = 32
    dims: int = 1

    def forward(self, rows, taken=frozenset()):
        place = [c for c in ("x", "y", "z") if c in rows.columns]
        values = rows.select("idx", numeric.signed(F.col("v"), self.bits).alias("v"), *place)
        return {"out": predictors.lorenzo(values, self.dims, self.bits).select("idx", numeric.mask(F.col("delta"), self.bits).alias("v"))}, {}

    def inverse(self, ports, known):
        d = ports["out"].select("idx", numeric.signed(F.col("v"), self.bits).alias("delta"))
        if self.dims > 1:
            d = coordinates(d, *known["dims"])
        return predictors.unlorenzo(d, self.dims, self.bits).select("idx", numeric.mask(F.col("v"), self.bits).alias("v"))


@dataclass(frozen=True)
class Difference(Stage):
    chunk: int = 0
    bits: int = 32
    negabinary: bool = False

    def forward(self, rows, taken=frozenset()):
        d = predictors.difference(rows, self.chunk, self.bits, self.negabinary)
        return {"out": d.select("idx", numeric.mask(F.col("d"), self.bits).alias("v"))}, {}

    def inverse(self, ports, known):
        d = ports["out"].select("idx", (F.col("v") if self.negabinary else numeric.signed(F.col("v"), self.bits)).alias("d"))
        return predictors.undifference(d, self.chunk, self.bits, self.negabinary).select("idx", numeric.mask(F.col("v"), self.bits).alias("v"))


@dataclass(frozen=True)
class Zigzag(Stage):
    bits: int = 32

    def forward(self, rows, taken=frozenset()):
        return {"out": rows.select("idx", numeric.zigzag(numeric.signed(F.col("v"), self.bits), self.bits).alias("v"))}, {}

    def inverse(self, ports, known):
        return ports["out"].select("idx", numeric.mask(numeric.unzigzag(F.col("v")), self.bits).alias("v"))


@dataclass(frozen=True)
class Negabinary(Stage):
    bits: int = 32

    def forward(self, rows, taken=frozenset()):
        return {"out": rows.select("idx", numeric.negabinary(numeric.signed(F.col("v"), self.bits), self.bits).alias("v"))}, {}

    def inverse(self, ports, known):
        return ports["out"].select("idx", numeric.mask(numeric.unnegabinary(F.col("v"), self.bits), self.bits).alias("v"))


@dataclass(frozen=True)
class Bitpack(Stage):
    """Packs the low ``nbits`` of each value; 0 takes as many as the largest value needs."""

    nbits: int = 16

    def __post_init__(self):
        if self.nbits:
            coders.check_nbits(self.nbits)

    def forward(self, rows, taken=frozenset()):
        facts = rows.agg(F.count(F.lit(1)).alias("count"), F.max("v").alias("max_v")).first()
        nbits = self.nbits or next(n for n in (1, 2, 4, 8, 16, 32, 64) if (facts["max_v"] or 0) < 1 << n)
        return {"out": coders.bitpack(rows, nbits).select(F.col("at").alias("idx"), F.col("byte").cast("long").alias("v"))}, {"count": facts["count"], "nbits": nbits}

    def inverse(self, ports, known):
        return coders.bitunpack(ports["out"].select(F.col("idx").alias("at"), F.col("v").alias("byte")), known["nbits"], known["count"])


@dataclass(frozen=True)
class Rle(Stage):
    ports = {"values": INT, "lengths": INT}

    def forward(self, rows, taken=frozenset()):
        runs = coders.rle(rows.select("idx", "v"))
        return {"values": runs.select(F.col("run_id").alias("idx"), "v"), "lengths": runs.select(F.col("run_id").alias("idx"), F.col("length").alias("v"))}, {}

    def inverse(self, ports, known):
        runs = ports["values"].join(ports["lengths"].withColumnRenamed("v", "length"), "idx").withColumnRenamed("idx", "run_id")
        return coders.unrle(runs)


@dataclass(frozen=True)
class Bitshuffle(Stage):
    """Bit planes of blocks. The values have ``value_width`` bytes, those of an element if 0; only their bytes are shuffled."""

    width: int = 4
    block_size: int = 16384
    value_width: int = 0

    ports = {"out": BLOCKS}

    @property
    def align(self):
        return self.block_size // (self.value_width or self.width)

    def forward(self, rows, taken=frozenset()):
        return {"out": coders.bitshuffle_blocks(to_blocks(rows, f"<u{self.value_width or self.width}", self.align), self.width, self.block_size)}, {}

    def inverse(self, ports, known):
        return from_blocks(coders.unbitshuffle_blocks(ports["out"], self.width, self.block_size), f"<u{self.value_width or self.width}", self.align)


@dataclass(frozen=True)
class Rze(Stage):
    takes = BLOCKS
    ports = {"out": BLOCKS}

    def forward(self, rows, taken=frozenset()):
        return {"out": coders.eliminate_zeros(rows)}, {}

    def inverse(self, ports, known):
        return coders.restore_zeros(ports["out"])


@dataclass(frozen=True)
class Huffman(Stage):
    """``encode_mode`` (Coarse or Fine) names how a device would run it; the bytes are the same."""

    bklen: int = 65536
    encode_mode: str = "Coarse"

    ports = {"out": BLOCKS}

    def __post_init__(self):
        if self.encode_mode.lower() not in ("coarse", "fine"):
            raise ValueError(f"unknown encode_mode {self.encode_mode}")

    def forward(self, rows, taken=frozenset()):
        book = coders.codebook(rows, self.bklen)
        return {"out": coders.huffman(rows, book)}, {"book": {str(s): list(x) for s, x in book.items()}}

    def inverse(self, ports, known):
        return coders.unhuffman(ports["out"], {int(s): tuple(x) for s, x in known["book"].items()})


STAGES = {c.__name__: c for c in (LorenzoQuant, Quantizer, Lorenzo, Difference, Zigzag, Negabinary, Bitpack, Rle, Bitshuffle, Rze, Huffman)}


@dataclass
class Compressed:
    """Segments by (stage, port), and what the inverse must know of each stage."""

    segments: dict[tuple[str, str], DataFrame]
    known: dict[str, dict] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Frees ports that several stages take, which are kept on the executors until then."""
        for rows in self.held:
            rows.unpersist()


class Pipeline:
    """add, connect, finalize; then compress and decompress. Ports that no stage takes are the pipeline's segments.

    With ``pad`` the field is filled up with zeros to a whole number of every stage's units, and cut again in ``decompress``.
    """

    def __init__(self, dims: tuple[int, int, int] | None = None, pad: bool = False) -> None:
        self.stages: dict[str, Stage] = {}
        self.inputs: dict[str, list[tuple[str, str]]] = {}
        self.dims, self.pad, self.order = dims, pad, None

    def add(self, name: str, stage: Stage) -> str:
        if name in self.stages:
            raise ValueError(f"two stages are named {name}")
        self.stages[name], self.order = stage, None
        return name

    def connect(self, stage: str, producer: str | list[str], port: str | None = None) -> None:
        """Connects a port of a producer, or the first port of each of several, to the next free input of the stage."""
        if not isinstance(producer, str):
            for p in producer:
                self.connect(stage, p)
            return
        for s in (stage, producer):
            if s not in self.stages:
                raise ValueError(f"no stage is named {s}")
        ports = self.stages[producer].ports
        port = {"output": "out"}.get(port, port) if port not in ports else port
        port = port or next(iter(ports))
        if port not in ports:
            raise ValueError(f"{producer} has no port {port}, only {', '.join(ports)}")
        if len(self.inputs.get(stage, [])) >= self.stages[stage].n_inputs:
            raise ValueError(f"{stage} has an input already" if self.stages[stage].n_inputs == 1 else f"{stage} has all of its inputs already")
        self.inputs.setdefault(stage, []).append((producer, port))
        self.order = None

    def finalize(self) -> Pipeline:
        """Checks the graph: one source, no stage left out, no cycle, all inputs connected, kinds of the edges agree."""
        if not self.stages:
            raise ValueError("the pipeline has no stages")
        sources = [s for s in self.stages if s not in self.inputs]
        if len(sources) != 1:
            raise ValueError("a cycle leaves no source" if not sources else f"more than one source: {', '.join(sources)}")
        order = list(sources)
        for _ in self.stages:
            order += [t for t, made in self.inputs.items() if t not in order and all(p in order for p, _ in made)]
        if len(order) < len(self.stages):
            raise ValueError("the graph has a cycle")
        for s, made in self.inputs.items():
            if len(made) < self.stages[s].n_inputs:
                raise ValueError(f"{s} has {len(made)} of {self.stages[s].n_inputs} inputs")
            for p, port in made:
                kind, takes = self.stages[p].ports[port], self.stages[s].takes
                if kind != takes:
                    raise ValueError(f"{s} takes {takes}, but {p}.{port} is {kind}")
        if self.dims is None and any(isinstance(x, Lorenzo) and x.dims > 1 for x in self.stages.values()):
            raise ValueError("lossless prediction in more dimensions needs the pipeline's dims")
        self.order = order
        return self

    def _taken(self) -> dict[tuple[str, str], int]:
        counts: dict[tuple[str, str], int] = {}
        for made in self.inputs.values():
            for k in made:
                counts[k] = counts.get(k, 0) + 1
        return counts

    def segments(self) -> list[tuple[str, str]]:
        taken = self._taken()
        return [(s, p) for s in self.order for p in self.stages[s].ports if (s, p) not in taken]

    def alignment(self) -> int:
        """Elements that the input is padded to a multiple of."""
        return math.lcm(*(s.align for s in self.stages.values()))

    def compress(self, rows: DataFrame) -> Compressed:
        """The segments, not computed yet. A port that several stages take is computed once, kept on the executors until ``release``."""
        if self.order is None:
            self.finalize()
        made, known, held, taken, count = {}, {}, [], self._taken(), None
        if self.pad:
            count = rows.count()
            rows = padded(rows, count, self.alignment())
        for s in self.order:
            stage = self.stages[s]
            inputs = [rows] if s not in self.inputs else [made[k] for k in self.inputs[s]]
            if stage.dims > 1 and self.dims:
                inputs = [coordinates(x, *self.dims[:2]) if "x" not in x.columns else x for x in inputs]
            ports, facts = stage.forward(*inputs, taken=frozenset(p for q, p in taken if q == s))
            for p, d in ports.items():
                if taken.get((s, p), 0) > 1:
                    held.append(d := d.persist(StorageLevel.MEMORY_AND_DISK))
                made[s, p] = d
            known[s] = facts | ({"dims": list(self.dims[:2])} if self.dims else {}) | ({"count": count} if count is not None and s == self.order[0] else {})
        return Compressed({k: made[k] for k in self.segments()}, known, held)

    def decompress(self, data: Compressed) -> DataFrame:
        """Backward from the segments: a stage's inverse gives the ports that it had taken. Of several that took one port, one gives it."""
        if self.order is None:
            self.finalize()
        ports = dict(data.segments)
        for s in reversed(self.order):
            back = self.stages[s].inverse({p: ports[s, p] for p in self.stages[s].ports}, data.known[s])
            if s not in self.inputs:
                return back.where(F.col("idx") < data.known[s]["count"]) if self.pad else back
            ports.update(zip(self.inputs[s], back if isinstance(back, list) else [back], strict=True))
        raise ValueError("the pipeline has no source")

    def max_compressed_size(self, n: int, width: int = 4) -> int:
        """Bytes that the segments can take at most, with 5 % on top."""
        size = {}
        for s in self.order or self.finalize().order:
            taken = n * width if s not in self.inputs else sum(size[k] for k in self.inputs[s])
            grow = {"Rle": 2.0, "Rze": 1.0 + 16 / 16384, "Huffman": 4.0}.get(type(self.stages[s]).__name__, 1.0)
            size.update({(s, p): int(taken * grow) + 16 for p in self.stages[s].ports})
        return int(1.05 * sum(size[k] for k in self.segments()))

    def profile(self, rows: DataFrame) -> list[dict]:
        """Seconds of each stage when its ports are computed in turn, with its level in the graph; ``level_seconds`` sums them up."""
        made, out, level = {}, [], {}
        for s in self.order or self.finalize().order:
            level[s] = 0 if s not in self.inputs else 1 + max(level[p] for p, _ in self.inputs[s])
            inputs = [rows] if s not in self.inputs else [made[k] for k in self.inputs[s]]
            if self.stages[s].dims > 1 and self.dims:
                inputs = [coordinates(x, *self.dims[:2]) if "x" not in x.columns else x for x in inputs]
            began = time.perf_counter()
            ports, _ = self.stages[s].forward(*inputs)
            for p, d in ports.items():
                made[s, p] = d.persist()
                d.count()
            out.append({"stage": s, "level": level[s], "seconds": time.perf_counter() - began})
        for d in made.values():
            d.unpersist()
        return out

    def describe(self) -> dict:
        """A dictionary that ``from_config`` reads."""
        stages = []
        for s in self.order or list(self.stages):
            entry = {"name": s, "type": type(self.stages[s]).__name__, **asdict(self.stages[s])}
            if s in self.inputs:
                entry["inputs"] = [{"from": p, "port": port} for p, port in self.inputs[s]]
            stages.append(entry)
        return {"pipeline": ({"dims": list(self.dims)} if self.dims else {}) | ({"pad": True} if self.pad else {}), "stage": stages}


def level_seconds(profile: list[dict]) -> dict[int, float]:
    """Seconds of each level of a profile: those of its slowest stage, as the stages of a level don't wait for each other."""
    out: dict[int, float] = {}
    for row in profile:
        out[row["level"]] = max(out.get(row["level"], 0.0), row["seconds"])
    return out


# Bits of element types, by the names that configurations have for them.
TYPE_BITS = {
    "uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64, "int8": 8, "int16": 16, "int32": 32, "int64": 64, "float32": 32, "float64": 64,
}

# Stage types that configurations write in capitals.
TYPE_NAMES = {"RLE": "Rle", "RZE": "Rze"}


def _bits(kind: str, name: str, allowed: str) -> int:
    if kind not in TYPE_BITS or kind not in allowed.split():
        raise ValueError(f"{name} doesn't take the type {kind}, only {', '.join(allowed.split())}")
    return TYPE_BITS[kind]


def _translated(kind: str, options: dict) -> dict:
    """Options in the words of element types as options of the stage here. Capacities of outliers are a report, not a limit, unless strict."""
    given = dict(options)
    mode = given.pop("error_bound_mode", None)
    if mode is not None:
        given["error_mode"] = mode.lower()
    if "error_mode" in given and given["error_mode"] not in ("abs", "noa", "rel"):
        raise ValueError(f"unknown error bound mode {mode or given['error_mode']}")
    taken, made = given.pop("input_type", None), given.pop("output_type", None)
    if kind in ("LorenzoQuant", "Quantizer"):
        if taken:
            _bits(taken, kind, "float32 float64")
        if code := given.pop("code_type", None):
            given["code_bits"] = _bits(code, kind, "uint8 uint16 uint32" if kind == "LorenzoQuant" else "uint16 uint32")
            if kind == "LorenzoQuant":  # codes of as many values as the type has
                given["quant_radius"] = min(given.get("quant_radius", 32768), 1 << (given["code_bits"] - 1))
    elif kind == "Lorenzo":
        if data := given.pop("data_type", None):
            given["bits"] = _bits(data, kind, "int8 int16 int32 int64")
    elif kind == "Difference":
        if taken:
            given["bits"] = _bits(taken, kind, "uint8 uint16 uint32 int8 int16 int32 int64")
            given["negabinary"] = bool(made) and made != taken
            if made and TYPE_BITS.get(made) != given["bits"]:
                raise ValueError(f"Difference can't make {made} of {taken}")
        if "chunk_size" in given:
            given["chunk"] = given.pop("chunk_size") // (given.get("bits", 32) // 8)
    elif kind in ("Zigzag", "Negabinary"):
        if taken:
            given["bits"] = _bits(taken, kind, "int8 int16 int32 int64")
            if made and TYPE_BITS.get(made) != given["bits"]:
                raise ValueError(f"{kind} can't make {made} of {taken}")
    elif kind == "Bitpack":
        if taken:
            _bits(taken, kind, "uint8 uint16 uint32")
    elif kind == "Rle":
        if data := given.pop("data_type", None):
            _bits(data, kind, "uint8 uint16 uint32 int32")
    elif kind == "Bitshuffle":
        if "element_width" in given:
            given["width"] = given.pop("element_width")
    elif kind == "Rze":
        if given.pop("chunk_size", coders.CHUNK) != coders.CHUNK or given.pop("levels", 4) != 4:
            raise ValueError(f"Rze has chunks of {coders.CHUNK} bytes and 4 levels")
    elif kind == "Huffman" and taken:
        _bits(taken, kind, "uint8 uint16 uint32")
    return given


def make_stage(kind: str, options: dict) -> Stage:
    kind = TYPE_NAMES.get(kind, kind)
    if kind not in STAGES:
        raise ValueError(f"unknown stage type {kind}")
    options = _translated(kind, options)
    allowed = {f.name for f in fields(STAGES[kind])}
    if unknown := set(options) - allowed:
        raise ValueError(f"{kind} has no option {', '.join(sorted(unknown))}")
    return STAGES[kind](**options)
