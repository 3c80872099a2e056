"""Quality rules kept as a bitmask ledger (operator 2).

Every rule is evaluated once for a document. The ledger holds one bit for each rule that failed and the measurements behind them.
A policy is a versioned mask of rules: it is applied, compared with others and ablated on the stored bits, without reading texts again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_no_letter_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails where the SQL condition on the measurements holds. ``bit`` never changes its meaning."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols_per_word", "10 * n_symbols > 2 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 35 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "words_without_letters", "2 * n_no_letter_words > n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[n] for n in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_trigrams"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))
STRICT_FORM = Policy("form-1", ("symbols_per_word", "duplicate_lines", "short_words", "long_words"))


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    words = text.split()
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, covered = Counter(windows), bytearray(n)
        for k, w in enumerate(windows):
            if counts[w] > 1:
                covered[k] = covered[k + 1] = covered[k + 2] = 1
        repeated = sum(covered)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = sum(map(bytes.isalpha, words))  # most words are plain ASCII; the others are looked at one by one
    if letters < n:
        letters += sum(1 for w in words if not w.isalpha() and any(map(str.isalpha, w.decode("utf-8", "replace"))))
    packed = b"".join(words)
    chars = len(packed) if packed.isascii() else len(packed.decode("utf-8", "replace"))
    return n, chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated, n - letters


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        rows = [measure(t.as_py() or b"") for t in texts]
        columns = zip(*rows, strict=True) if rows else [[]] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["key", *MEASURES])


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """The failure bits, from the measurements."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, the measurements and ``failed_bits``.

    A null text counts as an empty one and fails the rules on length only. Null ids, ties and repeated rows give a row each. Whatever
    other columns the table has are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(_measured, schema)
    return rows.withColumn("failed_bits", failures()).withColumnRenamed("key", id_col)


def passes(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policies(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """The ledger with one boolean column ``kept_<version>`` for each policy."""
    return rows.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablation(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """For each policy and each rule of it: documents failing the rule, failing only it, and kept if the rule were left out.

    The ledger is summed once to counts by distinct failure bits (at most 2 to the number of rules), and everything follows from them.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    wanted = [(p.version, p.mask, r.name, 1 << r.bit) for p in policies for r in RULES if r.name in p.rules]
    rules = F.broadcast(spark.createDataFrame(wanted, "version string, mask long, rule string, bit long"))
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    alone = hit == F.col("bit")
    return (
        counts.join(rules, F.col("n") > 0)
        .groupBy("version", "rule")
        .agg(
            total(hit.bitwiseAND(F.col("bit")) != 0)("n_failed"),
            total(alone)("n_failed_alone"),
            total(hit == 0)("n_kept"),
            total((hit == 0) | alone)("n_kept_without_rule"),
        )
    )
