"""Language identification by hierarchical discrimination (operator 4).

Texts become relative frequencies of hashed byte n-grams. A linear support vector machine for each pair of families predicts the
family; one-versus-one machines inside it separate its languages. The machines are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import bounded_batches, take_over

# Families of common languages by their two-letter codes.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "is", "af"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu"),
}

SIZE = 1 << 13

#: A text with this many different grams is long enough to be held against its language's centre, and unfamiliar below this share of what
#: the least alike of the fitting rows reaches. On held-out rows of the tables none is; other scripts are, and random bytes.
LONG, LEAST = 200, 0.6
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def forget() -> None:
    """Nothing is kept."""


def family(lang: str) -> str:
    """The family of a language; a language that no family lists is one of its own."""
    return next((f for f, members in FAMILIES.items() if lang in members), f"only-{lang}")


def features(text: bytes, size: int = SIZE) -> np.ndarray:
    """Indices of the hashed 1- to 4-byte grams of the whole text, lower-cased, without digits and signs."""
    x = np.frombuffer(text.translate(_LOWER), np.uint8).astype(np.uint32)
    x = np.where((x < 97) | ((x > 122) & (x < 128)), 32, x)
    x = np.concatenate(([32], x[np.flatnonzero(np.diff(x, prepend=0) | (x != 32))], [32])).astype(np.uint32)  # one space for many
    two = x[:-1] * np.uint32(256) + x[1:]
    three = two[:-1] * np.uint32(256) + x[2:]
    four = (three[:-1] * np.uint32(256)) + x[3:]
    mix = lambda v, m: (v * np.uint32(m)) >> np.uint32(32 - size.bit_length() + 1)
    return np.concatenate((mix(x + np.uint32(7), 2654435761), mix(two, 2246822519), mix(three, 3266489917), mix(four, 668265263)))


def vector(text: bytes, size: int = SIZE) -> np.ndarray:
    counts = np.sqrt(np.bincount(features(text, size), minlength=size)[:size].astype(np.float32))
    return counts / max(1e-9, float(np.sqrt(counts @ counts)))


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 60, seed: int = 7) -> np.ndarray:
    """A linear support vector machine (squared hinge loss) by dual coordinate descent; y is -1 or 1. The last weight is the bias."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    weight = np.where(y > 0, len(y) / max(1, (y > 0).sum()), len(y) / max(1, (y < 0).sum())) / 2 * cost
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    diagonal, square = 0.5 / weight, (x * x).sum(1)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(x)):
            gradient = y[i] * float(w @ x[i]) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / (square[i] + diagonal[i]))
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w


@dataclass
class Model:
    """langs, their families, a machine for each pair of families and each pair of languages inside one, and the languages' centres and floors."""

    langs: list[str]
    families: list[str]
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    size: int = SIZE
    centres: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.members = {f: [x for x in self.langs if family(x) == f] for f in self.families}
        self.pairs = sorted(self.machines)
        self.matrix = np.stack([self.machines[p] for p in self.pairs]) if self.pairs else np.zeros((0, self.size + 1), np.float32)

    def _vote(self, kinds: list[str], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The kind that wins most duels, ties by the sum of margins; the logistic value of its closest duel."""
        if len(kinds) == 1:
            return kinds[0], 1.0
        score = {k: [0, 0.0, np.inf] for k in kinds}
        for a, b in combinations(kinds, 2):
            m = margins.get((a, b), 0.0)
            for k, v in ((a, m), (b, -m)):
                score[k] = [score[k][0] + (v > 0), score[k][1] + v, min(score[k][2], v)]
        best = max(kinds, key=lambda k: (score[k][0], score[k][1]))
        return best, float(1 / (1 + np.exp(-3 * np.clip(score[best][2], -20, 20))))

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """The language, a score, and whether the text is like that language at all."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, False
        v = vector(text, self.size)
        margins = dict(zip(self.pairs, self.matrix[:, :-1] @ v + self.matrix[:, -1], strict=True))
        f, p = self._vote(self.families, margins)
        lang, q = self._vote(self.members[f], margins)
        centre, floor = self.centres.get(lang, (v, 0.0))
        return lang, p * q, bool(np.count_nonzero(v) < LONG or centre @ v >= floor)


def _sparse(v: np.ndarray) -> bytes:
    """The non-zero numbers of a vector: their places, then their values."""
    at = np.flatnonzero(v)
    return at.astype("<u2").tobytes() + v[at].astype("<f2").tobytes()


def _dense(rows: list[bytes], size: int) -> np.ndarray:
    x = np.zeros((len(rows), size), np.float32)
    for i, r in enumerate(rows):
        n = len(r) // 4
        x[i, np.frombuffer(r, "<u2", n)] = np.frombuffer(r, "<f2", n, 2 * n)
    return x


def _machine(size: int):
    """One machine from the rows of both of its sides; none if a side has no row. Where b is null, the centre of language a instead, and how
    like it a text must be at least: ``LEAST`` of what the least alike of the rows with ``LONG`` grams or more is."""

    def run(rows: pa.Table) -> pa.Table:
        a, b = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
        if b is None:
            x = _dense(sorted(rows.column("v").to_pylist()), size)
            centre = x.mean(0) / max(1e-9, float(np.linalg.norm(x.mean(0))))
            alike = (x @ centre)[(x > 0).sum(1) >= LONG]
            return pa.table({"a": [a], "b": pa.array([None], pa.string()), "w": [centre.astype("<f4").tobytes()], "floor": [LEAST * float(alike.min()) if len(alike) else 0.0]})
        rows = rows.sort_by([("side", "ascending"), ("v", "ascending")])
        y = np.where(np.array(rows.column("side").to_pylist(), dtype=object) == a, 1, -1)
        w = [fit_machine(_dense(rows.column("v").to_pylist(), size), y).astype("<f4").tobytes()] if abs(y.sum()) < len(y) else []
        return pa.table({"a": pa.array([a] * len(w), pa.string()), "b": pa.array([b] * len(w), pa.string()), "w": pa.array(w, pa.binary()), "floor": pa.array([None] * len(w), pa.float64())})

    return run


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_lang: int = 600, size: int = SIZE) -> Model:
    """Fits on about ``per_lang`` rows of each language, drawn evenly by a hash of key and text from all labelled rows.

    That is the documented bound of the fitting sample: the share drawn is ``per_lang`` of a language's rows, whatever their number, and
    equal rows are drawn once. Each machine is fitted in a task of its own, from vectors of whole texts; the driver gets the counts of
    the languages and the machines. Rows without a language, a text or a letter teach nothing. Without any labelled row the model
    knows no language and predicts ``und``.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(key_col).cast("string").alias("key"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    families = sorted({family(k) for k in langs})
    groups = [families, *[[k for k in langs if family(k) == f] for f in families]]
    duels = [[(a, b) for a, b in combinations(g, 2)] for g in groups]
    if not langs:
        return Model([], [], {}, size)
    sides = [(k, a, b, side) for k in langs for i, g in enumerate(duels) for a, b in g for side in (a, b) if side == (k if i else family(k))]
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("key", "text", F.lit(5)), F.lit(1 << 53)) < share * F.lit(float(1 << 53))).select("lang", "text").distinct()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("language", forget)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_sparse(vector(t.as_py(), size)) for t in b.column(1).cast(pa.binary())], pa.binary())], names=["lang", "v"])

    known = drawn.mapInArrow(vectors, "lang string, v binary")
    # a few rows for each language: which machines it teaches, and on which side
    sides += [(k, k, None, k) for k in langs]
    taught = known.join(F.broadcast(spark.createDataFrame(sides, "lang string, a string, b string, side string")), "lang").select("a", "b", "side", "v")
    fitted = taught.groupBy("a", "b").applyInArrow(_machine(size), "a string, b string, w binary, floor double").collect()
    weights = {(r["a"], r["b"]): np.frombuffer(bytes(r["w"]), "<f4") for r in fitted}
    centres = {a: (w, f) for (a, b), w, f in ((k, weights[k], r["floor"]) for k, r in (((r["a"], r["b"]), r) for r in fitted)) if b is None}
    return Model(langs, families, {k: w for k, w in weights.items() if k[1] is not None}, size, centres)


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, the text too, if not given) with ``lang_pred``, ``score`` and ``familiar``; columns of these names are replaced.

    The prediction reads the whole text and nothing else. A null text, or one without a letter, is ``und`` with score 0. A long
    text that is much less like the predicted language than all rows that it was learned from is not ``familiar``: it has a language that
    the model does not know, or none. Ties and repeated rows get the same answer each.
    """
    rest = [c for c in (keep if keep is not None else df.columns) if c.lower() not in ("lang_pred", "score", "familiar")]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("language", forget)
        own = shared.value
        for b in batches:
            found = [own.predict(t.as_py()) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], names=["row", "lang_pred", "score", "familiar"])

    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, lang_pred string, score double, familiar boolean")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "lang_pred", "score", "familiar")
