"""Line dedup by distinct-site spread (operator 10).

A line is boilerplate where it stands on many sites. Each line hash gets a HyperLogLog sketch of its sites, merged by aggregation; lines
whose estimate is near the threshold get an exact distinct count. Boilerplate goes from every document that has text of its own beside
it; a document made of such lines (nearly) alone is a copy of a whole document and is left to document-level dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import written

#: Estimates within this share of the threshold are counted exactly: five standard errors of a sketch of 2^12 registers.
NEAR = 0.08

#: Two documents with this share of their text in common are 0.8 alike (s / (2 - s)): what near-dedup links, and all that may be left to it.
COPIED = 8 / 9


#: A line from its first character that is not white space on: one match for each line that is not blank.
_SOLID = r"[^\x09-\x0D\x20][^\n]*"


def _lines(text: str) -> Column:
    """The lines of the text as they are compared: control characters are spaces, and none stand at the ends."""
    return F.transform(F.split(F.translate(F.col(text), "\t\x0b\x0c\r", "    "), "\n"), lambda x: F.trim(x))


def _hashes(text: str) -> Column:
    """The distinct 64-bit hashes of the text's lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _site(site_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n")))


def _spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """line, n_docs, n_sites of lines (line, site) on at least ``min_sites`` sites."""
    spread = lines.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("line")
    several = lines.join(spread, "line")
    sketched = several.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(12))).alias("estimate"), F.count(F.lit(1)).alias("n_docs"))
    wide = sketched.where(F.col("estimate") >= min_sites * (1 - NEAR) - 1)
    near = wide.where(F.col("estimate") <= min_sites * (1 + NEAR) + 1).select("line")
    exact = several.join(near, "line").groupBy("line").agg(F.count_distinct("site").alias("exact"))
    return wide.join(exact, "line", "left").select("line", "n_docs", F.coalesce("exact", "estimate").alias("n_sites")).where(F.col("n_sites") >= min_sites)


def line_spread(df: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = 5) -> DataFrame:
    """line, n_docs, n_sites of all lines on at least ``min_sites`` sites.

    Lines on a single site (least site = greatest site, summed before any exchange) need no sketch. A null site counts as one site of
    its own. Blank lines are no lines. The result is exact wherever the estimate is near the threshold; beyond it is the estimate.
    """
    return _spread(df.select(_site(site_col).alias("site"), F.explode(_hashes(text_col)).alias("line")), min_sites)


def remove_boilerplate(df: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = 5, max_share: float = COPIED) -> DataFrame:
    """``df`` with its text cleaned, and ``n_lines`` and ``n_removed_lines``; columns of these names are replaced.

    Lines are compared without white space at their ends. Of a document, its boilerplate lines go unless they hold more than
    ``max_share`` of its characters outside blank lines: such a document is a copy that near-dedup links. Null texts stay null, empty ones
    empty; blank lines are never removed. What a text loses depends on the text alone, so repeated rows and null ids are treated alike
    and each keeps its row. Texts are split once for the counts, into hashes that are written, and those with boilerplate once more.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed_lines")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).cast("string").alias("text"))
    key = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")]
    texts = df.select(F.col(text_col).cast("string").alias("text"), _site(site_col).alias("site")).where("text is not null")
    texts = written(spark, texts.select(*key, "site", _hashes("text").alias("lines")), "lines")
    marked = _spread(texts.select("site", F.explode("lines").alias("line")), min_sites).select("line")
    hits = texts.select("h1", "h2", F.explode("lines").alias("line")).join(marked, "line").groupBy("h1", "h2").agg(F.collect_set("line").alias("hit"))
    joined = rows.select("row", "text", *key).join(hits, ["h1", "h2"], "left")
    # a line and how it is compared, side by side
    pairs = F.arrays_zip(F.split("text", "\n").alias("own"), _lines("text").alias("bare"))
    marks = F.transform(pairs, lambda x: F.struct(x["own"].alias("own"), F.length(x["bare"]).alias("n"), ((x["bare"] != "") & F.array_contains("hit", F.xxhash64(x["bare"]))).alias("gone")))
    split = joined.select("row", "text", F.when(F.col("hit").isNotNull(), marks).alias("marks"))
    chars = lambda keep: F.aggregate("marks", F.lit(0).cast("long"), lambda n, x: n + F.when(keep(x), x["n"]).otherwise(0))
    cut = F.coalesce(chars(lambda x: x["gone"]) <= F.lit(max_share) * chars(lambda x: x["n"] > 0), F.lit(False))
    cleaned = split.select(
        "row",
        F.when(cut, F.array_join(F.transform(F.filter("marks", lambda x: ~x["gone"]), lambda x: x["own"]), "\n")).otherwise(F.col("text")).alias("cleaned"),
        F.coalesce(F.regexp_count("text", F.lit(_SOLID)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(cut, F.size(F.filter("marks", lambda x: x["gone"]))).otherwise(0).cast("long").alias("n_removed_lines"),
    )
    return cleaned.select(*[F.col("cleaned").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in rest], "n_lines", "n_removed_lines")
