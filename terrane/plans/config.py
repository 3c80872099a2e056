"""Pipelines from dictionaries, TOML files, chain strings and presets."""

from __future__ import annotations

import json
import math
import tomllib

from terrane.plans.pipeline import BLOCKS, TYPE_BITS, Bitshuffle, Difference, Huffman, LorenzoQuant, Pipeline, Quantizer, Rle, Rze, make_stage


# Keys of a configuration's [pipeline] that tell a device how to run it; here Spark decides.
RUN_KEYS = ("input_size", "memory_strategy", "pool_multiplier", "num_streams")


def _value_bytes(entry: dict, by_name: dict[str, dict]) -> int:
    """Bytes of the values that a stage gives, as its configuration or that of the stages before it says; 0 if none does."""
    kind = entry.get("output_type") or entry.get("code_type") or entry.get("data_type") or entry.get("input_type")
    if kind in TYPE_BITS and entry["type"] not in ("Bitpack", "Huffman", "Bitshuffle"):
        return TYPE_BITS[kind] // 8
    return _value_bytes(by_name[entry["inputs"][0]["from"]], by_name) if entry.get("inputs") and entry["type"] != "Bitpack" else 0


def from_config(config: dict) -> Pipeline:
    """A pipeline from a dictionary: ``pipeline`` (dims, pad) and ``stage``, a list of stages with name, type, inputs and options.

    Element types, error_bound_mode, element_width, chunk_size, levels and encode_mode are taken as well as the stages' own options.
    """
    head = dict(config.get("pipeline", {}))
    dims, pad = head.pop("dims", None), head.pop("pad", False)
    if unknown := set(head) - set(RUN_KEYS):
        raise ValueError(f"a pipeline has no option {', '.join(sorted(unknown))}")
    pipe = Pipeline(tuple((*dims, 1, 1)[:3]) if dims else None, pad)
    entries = config.get("stage", [])
    by_name = {e.get("name"): e for e in entries}
    for entry in entries:
        for key in ("name", "type"):
            if key not in entry:
                raise ValueError(f"a stage has no {key}")
        options = {k: v for k, v in entry.items() if k not in ("name", "type", "inputs")}
        if entry["type"] == "Bitshuffle" and "element_width" in entry:
            options["value_width"] = _value_bytes(entry, by_name)
        pipe.add(entry["name"], make_stage(entry["type"], options))
    for entry in entries:
        for i in entry.get("inputs", []):
            if i["from"] not in by_name:
                raise ValueError(f"{entry['name']} takes its input from {i['from']}, which is no stage")
            pipe.connect(entry["name"], i["from"], i.get("port"))
    return pipe.finalize()


def loads(text: str) -> Pipeline:
    return from_config(tomllib.loads(text))


def load(path: str) -> Pipeline:
    with open(path, encoding="utf-8") as f:
        return loads(f.read())


def _value(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "inf" if v == math.inf else repr(v)
    if isinstance(v, list):
        return "[" + ", ".join("{ " + ", ".join(f"{k} = {_value(x)}" for k, x in e.items()) + " }" if isinstance(e, dict) else _value(e) for e in v) + "]"
    return json.dumps(v)


def dumps(pipe: Pipeline) -> str:
    """TOML that ``load`` reads back to an equal pipeline."""
    data = pipe.describe()
    lines = ["[pipeline]", *(f"{k} = {_value(v)}" for k, v in data["pipeline"].items())]
    for s in data["stage"]:
        lines += ["", "[[stage]]", *(f"{k} = {_value(v)}" for k, v in s.items())]
    return "\n".join(lines) + "\n"


def from_chain(chain: str, mode: str = "rel", eb: float = 1e-3, radius: int = 32768, dims: tuple[int, int, int] | None = None) -> Pipeline:
    """A linear pipeline from ``a->b->c``."""
    n = 1 if not dims else 1 + (dims[1] > 1) + (dims[2] > 1)
    makers = {
        "lorenzo": lambda: LorenzoQuant(n, mode, eb, radius),
        "quantizer": lambda: Quantizer(mode, eb, radius),
        "bitshuffle": Bitshuffle, "bshuf": Bitshuffle, "rze": Rze,
        "diff": Difference, "difference": Difference, "rle": Rle,
        "huffman": lambda: Huffman(2 * radius), "huf": lambda: Huffman(2 * radius),
    }
    pipe, last = Pipeline(dims), None
    for k, name in enumerate(x.strip() for x in chain.split("->")):
        if name == "none":
            continue
        if name not in makers:
            raise ValueError(f"unknown stage {name} in {chain}")
        stage = makers[name]()
        if name.startswith("huf") and isinstance(pipe.stages.get(last), LorenzoQuant):
            pipe.stages[last] = LorenzoQuant(n, mode, eb, radius, zigzag_codes=True)
        if stage.takes == BLOCKS and last is not None and BLOCKS not in pipe.stages[last].ports.values():
            raise ValueError(f"{name} needs a stage before it that makes blocks")
        at = pipe.add(f"{name}{k}", stage)
        if last is not None:
            pipe.connect(at, last)
        last = at
    return pipe.finalize()


def preset(name: str, eb: float = 1e-3, mode: str = "noa", radius: int = 512) -> Pipeline:
    """predict_huffman, lorenzo_bitpack, quantize_diff_zeros, quantizer_lorenzo_bitpack, speed."""
    predict = {"name": "predict", "type": "LorenzoQuant", "error_mode": mode, "error_bound": eb, "quant_radius": radius, "zigzag_codes": True}
    direct = {"name": "quantize", "type": "Quantizer", "error_mode": mode, "error_bound": eb, "quant_radius": 1 << 30, "zigzag_codes": False}
    after = lambda name, kind, source, **o: {"name": name, "type": kind, **o, "inputs": [{"from": source}]}
    stages = {
        "predict_huffman": [predict, after("code", "Huffman", "predict", bklen=2 * radius)],
        "lorenzo_bitpack": [predict, after("pack", "Bitpack", "predict", nbits=16)],
        "quantize_diff_zeros": [direct, after("diff", "Difference", "quantize", negabinary=True), after("shuffle", "Bitshuffle", "diff"), after("zeros", "Rze", "shuffle")],
        "quantizer_lorenzo_bitpack": [direct, after("predict", "Lorenzo", "quantize"), after("zigzag", "Zigzag", "predict"), after("pack", "Bitpack", "zigzag", nbits=32)],
        "speed": [direct, after("shuffle", "Bitshuffle", "quantize"), after("zeros", "Rze", "shuffle")],
    }
    if name not in stages:
        raise ValueError(f"unknown preset {name}")
    return from_config({"stage": stages[name]})
