"""MinHash near-dedup on bottom-k sketches (operator 8).

A document's set is hashed with one function; its sketch is the k smallest hashes. Inverted lists of retained values give pairs of
documents that overlap; the sketch of their union estimates the similarity and drops pairs that are far below the threshold; the
others are decided on their full sets. Documents with equal sets are one class from the start.

Which retained values make lists: two linked documents share, but for a chance below 1e-7, half of their k retained values (the k
smallest of the union lie in both with a chance of 0.8 each). So they share one among each one's k/2 + 1 rarest values, whatever the
order, if both use the same; sets within k values are whole in the sketch, and there the prefix that must be shared is exact. Values are
ordered by how many documents retain them, rarest first, which keeps common passages out of the lists.

No list gives all its pairs. The most typical document of a list is its head, and lists of one head are one group. Each member meets the
head: a star, as many pairs as memberships. What that leaves in several components is compared on full sets in blocks, and a block gives
only as many links as join components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import take_over, written
from terrane.llm.components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ODD = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Ids of documents to verify, up to this many (8 bytes each), are broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 40_000:
            self[word] = h
        return h


_words = _Hashes()


def forget() -> None:
    _words.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the whole text, A to Z lower-cased."""
    words = text.translate(_LOWER).split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` words, in order; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    total = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total + words[k : n - size + 1 + k] * ODD[k % 64])
    return total


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of the whole text as sorted 64-bit hashes."""
    return np.unique(grams(word_hashes(text), size))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(df: DataFrame, size: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (the set's size), same (128-bit digest of the set) and sketch (the k smallest hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("neardup", forget)
        for batch in batches:
            n, same, low = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                s = shingle_set(t.as_py() or b"", size)
                n.append(len(s))
                same.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                low.append(s[:k])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in low]))).astype(np.int32)
            values = np.concatenate([*low, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "n", "same", "sketch"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, same binary, sketch array<long>")


def _estimates(k: int, percent: int):
    """Keeps pairs that the sketch of their union cannot tell from similar ones: within six standard errors of the threshold."""
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column("sa"), batch.column("sb")
            for i in range(batch.num_rows):
                a, b = (c[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (left, right))
                union = np.union1d(a, b)
                if len(a) == k or len(b) == k:
                    union = union[:k]
                m = len(union)
                both = len(np.intersect1d(np.intersect1d(a, union, assume_unique=True), b, assume_unique=True))
                slack = 6 * np.sqrt(t * (1 - t) * m) if m == k else 0
                keep[i] = both >= t * m - slack - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def document_id(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id as a long or, where it is null, a number above 2^62 that follows from the text: below it, ids of documents are their own."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string"), F.lit(9)), 2))


def _full_sets(base: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, shingles: the full sets of the documents named, as they are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(batch.num_rows, batch.num_rows * (4 << 20) // max(1, batch.nbytes)))
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                sets = [shingle_set(t.as_py(), size).view(np.int64) for t in part.column(1).cast(pa.binary())]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["id", "shingles"])

    return _named(base, ids).mapInArrow(run, "id long, shingles array<long>")


def _named(base: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the documents named."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return base.where("text is not null").join(ids, "id").dropDuplicates(["id"]).select("id", "text")


def _lists(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """value, id, n, typical: the prefix of each sketch in order of rarity; ``typical`` is high for documents that others resemble."""
    posting = reps.where("n > 0").select("id", "n", F.explode("sketch").alias("value"))
    common = posting.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = posting.join(common, "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"), F.count(F.lit(1)).alias("shared"), F.sum("df").alias("typical"))
    # values that no other document retains stand first in the order and make no list: they only use up the prefix
    held = F.least(F.col("n"), F.lit(k))
    exact = F.col("n") * 100 <= k * percent  # every document similar to this one is whole in its sketch too
    prefix = held + 1 - F.when(exact, F.ceil(F.col("n") * percent / 100)).otherwise(k // 2)
    left = F.greatest(F.lit(0), prefix - (held - F.col("shared"))).cast("int")
    return ranked.select("id", "n", "typical", F.explode(F.slice("values", F.lit(1), left)).alias("v")).select("v.value", "id", "n", "typical")


def _groups(spark, lists: DataFrame) -> DataFrame:
    """head, head_n, id, n: the other members of all lists that have one head, each once."""
    least_last = F.struct("typical", (-F.col("id")).alias("order"), F.col("n").alias("n"))
    heads = written(spark, lists.groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.max(least_last).alias("h")).where("m > 1").select("value", (-F.col("h.order")).alias("head"), F.col("h.n").alias("head_n")), "heads")
    return written(spark, lists.select("value", "id", "n").join(heads, "value").where("id <> head").select("head", "head_n", "id", "n").distinct(), "groups")


def _fits(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _stars(size: int, percent: int):
    """Links of a head with its members: rows come by head, its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            a, b = [], []
            for h, member, i, text in zip(*(batch.column(c) for c in ("head", "member", "id", "text")), strict=True):
                s = shingle_set(text.as_py().encode(), size)
                if not member.as_py():
                    head, own = h.as_py(), s
                elif similar(own, s, percent):
                    a.append(head)
                    b.append(i.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _star_links(spark, groups: DataFrame, reps: DataFrame, base: DataFrame, size: int, k: int, percent: int, share: int = 256) -> DataFrame:
    """a, b: heads and those of their members that reach the threshold on full sets, after the estimate. Each text passes the exchange once for
    each of its heads, a head's own once for every ``share`` members, so that a large group is spread."""
    side = lambda s: reps.select(F.col("id").alias(s), F.col("sketch").alias(f"s{s}"))
    pairs = groups.where(_fits("n", "head_n", percent)).select(F.col("head").alias("a"), F.col("id").alias("b"))
    likely = written(spark, pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimates(k, percent), "a long, b long"), "likely")
    texts = written(spark, _named(base, likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "texts")
    widths = likely.groupBy(F.col("a").alias("head")).agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("w"))
    members = likely.withColumnRenamed("a", "head").join(widths, "head").select("head", F.pmod(F.xxhash64("b"), "w").cast("int").alias("salt"), F.lit(1).alias("member"), F.col("b").alias("id"))
    own = widths.select("head", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("head").alias("id"))
    rows = members.unionByName(own).join(texts, "id")
    return rows.repartition("head", "salt").sortWithinPartitions("head", "salt", "member").select("head", "member", "id", "text").mapInArrow(_stars(size, percent), "a long, b long")


def _counts(a: list[np.ndarray], b: list[np.ndarray], dense: int = 64, width: int = 2048) -> np.ndarray:
    """How many values each set of ``a`` shares with each of ``b``. Common values are counted by products of 0-1 matrices, others one by one."""
    sides = []
    for sets in (a, b):
        values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        sides.append((values, inverse, np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    _, xa, xb = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    at = []
    for (values, inverse, owner), x in zip(sides, (xa, xb), strict=True):
        column = np.full(len(values), -1)
        column[x] = np.arange(len(x))
        column = column[inverse]
        order = np.flatnonzero(column >= 0)
        order = order[np.argsort(column[order], kind="stable")]
        at.append((column[order], owner[order], np.bincount(column[order], minlength=len(x))))
    out = np.zeros((len(a), len(b)), np.float32)
    heavy = at[0][2] * at[1][2] > dense
    # values in few sets: every pair of their owners
    light = [(c[~heavy[c]], o[~heavy[c]]) for c, o, _ in at]
    if len(light[0][0]):
        n_b = at[1][2][light[0][0]]
        start = np.searchsorted(light[1][0], light[0][0])
        left = np.repeat(light[0][1], n_b)
        right = light[1][1][np.repeat(start, n_b) + np.arange(n_b.sum()) - np.repeat(np.cumsum(n_b) - n_b, n_b)]
        out += np.bincount(left * len(b) + right, minlength=out.size).reshape(out.shape)
    number = np.cumsum(heavy) - 1
    columns = [(number[c[heavy[c]]], o[heavy[c]]) for c, o, _ in at]
    for low in range(0, int(heavy.sum()), width):
        matrices = []
        for (c, o), n in zip(columns, (len(a), len(b)), strict=True):
            x = np.zeros((n, width), np.float32)
            here = slice(*np.searchsorted(c, (low, low + width)))
            x[o[here], c[here] - low] = 1
            matrices.append(x)
        out += matrices[0] @ matrices[1].T
    return out.astype(np.int64)


def _block_links(percent: int):
    """Links of two blocks (or within one) on full sets, as links of components: no more than join them."""

    def run(table: pa.Table) -> pa.Table:
        sides = []
        for docs in table.column("docs"):
            v = docs.values
            sets = v.field("shingles")
            sides.append((v.field("c").to_numpy(), [sets[i].values.to_numpy(zero_copy_only=False) for i in range(len(sets))]))
        (ca, a), (cb, b) = sides[0], sides[-1]
        both = _counts(a, b)
        n_a, n_b = (np.array([len(s) for s in x]) for x in (a, b))
        linked = (100 * both >= percent * (n_a[:, None] + n_b[None, :] - both)) & (ca[:, None] != cb[None, :])
        u, v = np.nonzero(linked)
        pairs = np.unique(np.stack((np.minimum(ca[u], cb[v]), np.maximum(ca[u], cb[v])), 1), axis=0) if len(u) else np.empty((0, 2), np.int64)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        out = []
        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((min(x, y), max(x, y)))
        return pa.table({s: pa.array([r[i] for r in out], pa.int64()) for i, s in enumerate("ab")})

    return run


def _rest_links(spark, groups: DataFrame, found: DataFrame, base: DataFrame, size: int, percent: int, block: int = 512, block_shingles: int = 1 << 17) -> DataFrame:
    """a, b: links between components of ``found`` within groups of three or more documents that the stars left in several."""
    members = groups.select("head", "id", "n").unionByName(groups.select("head", F.col("head").alias("id"), F.col("head_n").alias("n")).distinct())
    placed = members.join(found, F.col("id") == F.col("node"), "left").select("head", "id", "n", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("head").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("x"), F.max("c").alias("y")).where("m > 2 and x <> y").select("head")
    rest = written(spark, placed.join(mixed, "head"), "rest")
    sets = written(spark, _full_sets(base, rest.select("id").distinct(), size), "sets")
    # a shingle that no other of these documents has can't be shared: who has too many of them can't be linked here
    alone = sets.select("id", F.explode("shingles").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("id")).where("m = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    able = rest.join(alone, "id", "left").where((F.col("n") - F.coalesce("alone", F.lit(0))) * 100 >= F.col("n") * percent).select("head", "id", "n", "c")
    # a component with many members in a group has blocks of its own there, which don't meet each other; the others share blocks
    many = able.groupBy("head", "c").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= block // 2).select("head", "c", F.col("c").alias("own"))
    dealt = able.join(many, ["head", "c"], "left").withColumn("own", F.coalesce("own", F.lit(-(1 << 63)).cast("long")))
    widths = dealt.groupBy("head", "own").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("w"))
    blocks = dealt.join(widths, ["head", "own"]).withColumn("block", F.struct("own", F.pmod(F.xxhash64("id", "head"), "w").cast("int").alias("salt"))).join(sets, "id")
    blocks = written(spark, blocks.groupBy("head", "block").agg(F.collect_list(F.struct("c", "shingles")).alias("docs")), "blocks")
    others = blocks.groupBy("head").agg(F.collect_list("block").alias("others"))
    met = blocks.join(others, "head").select("head", "block", "docs", F.explode("others").alias("other"))
    met = met.where((F.col("block.own") != F.col("other.own")) | (F.col("block.own") == F.lit(-(1 << 63)).cast("long")))
    met = met.select("head", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "docs")
    return met.groupBy("head", "i", "j").applyInArrow(_block_links(percent), "a long, b long").distinct()


def near_duplicates(df: DataFrame, size: int = 4, percent: int = 80, k: int = 64, id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the components of all links of at least ``percent`` similarity.

    In each list the most typical document meets all others on full sets; where the members still lie in several components, documents of
    different components are compared in blocks of ``block``. Pairs within one component are left out, and documents most of whose
    shingles no other has, so no link that joins components is lost.
    Null or empty texts, and texts without words, have an empty set: no links, and a component of their own id. Ids must tell documents
    apart; rows with the same id and text are one document in links and still get a row each. A null id gets a null component.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = written(spark, sketches(df, size, k, id_col, text_col), "sketches")
    classes = sketched.where("n > 0 and id is not null").groupBy("same").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = written(spark, classes.select("same", "id", "n", "sketch"), "classes")
    groups = _groups(spark, written(spark, _lists(reps, k, percent), "lists"))
    found = components(written(spark, _star_links(spark, groups, reps, base, size, k, percent), "links"))
    joined = components(_rest_links(spark, groups, found, base, size, percent, block))
    joined = joined.select(F.col("node").alias("c"), F.col("component").alias("least"))
    ids = sketched.select("id", "n", "same")
    own = ids.join(reps.select("same", F.col("id").alias("rep")), "same", "left").join(found, F.col("rep") == F.col("node"), "left")
    own = own.withColumn("c", F.coalesce("component", "rep", "id")).join(joined, "c", "left")
    return own.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "c").alias("component_id"))
