"""The operators as queries over their whole tables: thin functions (spark, sf_dir) -> DataFrame that derive digests from real outputs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import bpe, chat, language, lines, media, neardup, packing, quality, sharding, substrings
from terrane.llm.common import table


def vocabulary(name: str, path: Callable[[str], str] | None = None) -> bytes:
    """A tokenizer's file, by ``path`` (name to place) or else where the public tokenizers are installed. The driver reads it and tasks get its bytes."""
    if path is None:
        from public_tokenizers import path
    with open(path(name), "rb") as f:
        return f.read()


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base = quality.passes(quality.BASE)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), (base & quality.passes(quality.STANDARD)).alias("kept"), "failed_bits", F.lit(quality.STANDARD.version).alias("policy"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose parts come in order, one after the other; states hold hashes only, however long one is."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    started, conv, state, done = False, None, None, []

    def close() -> None:
        n, turns, chars, loss, formatted = state
        done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    for batch in batches:
        for i in range(batch.num_rows):
            here = batch.column("conv_id")[i].as_py()
            if not started or here != conv:
                if started:
                    close()
                started, conv, state = True, here, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            body = batch.column("body")[i].as_py()
            for role, text in chat.parse(body):
                state[0] += 1
                state[1].update(role + b"\n" + text + b"\n")
            spans = zip(*(batch.column(c)[i].as_py() for c in ("text_starts", "text_lengths", "in_loss")), strict=True)
            for start, length, loss in spans:
                if loss:
                    text = chat.unescape(body[start : start + length])
                    state[2] += len(text.decode())
                    state[3].update(text)
            state[4] += len(body.decode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
            done = []
    if started:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    parts = chat.format_chats(turns).select("conv_id", "part", "body", "text_starts", "text_lengths", "in_loss")
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~_held_out()))
    return language.identify(docs, model, keep=["doc_id"]).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"]), ranks, public_tokenizers.PATTERN)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _with_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in batch.column("ids")]
        rest = [c for c in batch.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(crc, pa.int64())], names=[*rest, "ids_crc32"])


def packed_digest(packed: DataFrame) -> DataFrame:
    kind = packed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    return packed.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids").mapInArrow(_with_crc, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json").decode()))


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.find_copies(media.drawn_images(table(spark, sf_dir, "embeddings")))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.octet_length("text").cast("long").alias("n_bytes_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_quality_rules, op3_chat_formatting, op4_language_id, op5_byte_bpe, op6_packing, op7_media_copies, op8_minhash_neardup, op9_substring_dedup, op10_line_dedup)}
