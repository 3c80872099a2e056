"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, substring dedup, packing. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import language, lines, neardup, packing, queries, substrings
from terrane.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text is in a language that the model knows, as far as that can be told; the others go.

    Rejected are null texts, texts without a letter (``und``) and long texts unlike all that the model was fitted on; nothing else is
    judged, and short texts stay. Without any labelled row all texts with a letter stay. Repeated rows are judged alike, and a table
    without rows gives none.
    """
    model = language.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.identify(docs, model).where("lang_pred <> 'und' and familiar").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; all documents stay, those with null or empty texts and repeated rows too. A null source is a site of its own."""
    return lines.remove_boilerplate(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one document stays, that with the least id; of rows that repeat an id and a text, one.

    Documents without an id are told apart by their texts and stay only where no document with an id is in the component. Texts without
    a word are linked with nothing and stay, as often as they come.
    """
    named = docs.withColumn("__id", neardup.document_id("doc_id", "text"))
    found = written(spark, neardup.near_duplicates(named, size=5, percent=80, id_col="__id").where("n_shingles > 0").select(F.col("doc_id").alias("__id"), "component_id"), "components")
    gone = found.where("__id <> component_id").select("__id").distinct()
    repeated = found.where("__id = component_id").groupBy("__id").count().where("count > 1").select("__id")
    kept = named.join(gone, "__id", "left_anti")
    again = kept.join(repeated, "__id", "left_semi").dropDuplicates(["__id", "text"])
    return kept.join(repeated, "__id", "left_anti").unionByName(again).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document (by id) has are cut out of the later ones.

    Documents that have no word left go. Null ids, null or empty texts and texts without such a passage stay as they are.
    """
    return substrings.remove_passages(docs, substrings.repeated_passages(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; null and empty texts and repeated rows are documents too."""
    return queries.packed_digest(packing.pack(docs, queries.vocabulary("byte_bpe_50k.json").decode()))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: SQL has no way to say most stages; tests compare them with brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
