"""Substring dedup by collinear chaining (operator 9).

Seeds are hashes of eight words around one that is left out, at every position: a passage with a word changed in every five has one
between any two changes, and equal words by chance are rare enough in a large corpus. They pass one exchange,
packed by bucket in some ten bytes each; a seed that lies in several documents points every later document to its first occurrence
(least document, then position), so a seed with n occurrences gives at most n - 1 matches. A bucket holds a seed's first occurrence of each
task that made seeds; the others stream past, so a frequent seed takes no more memory.
In each document, matches to one earlier document are chained in order of both positions, with costs for gaps, through a Fenwick tree.
The words around both sides of a chain are cut out once for all chains that need them, and aligned; what one earlier document covers
alone for long enough is a passage. Documents that are equal as a whole are one document from the start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import take_over, written
from terrane.llm.neardup import ODD, forget, mixed, word_hashes

_WORD = re.compile(r"[^\x20\x09-\x0D]+")

PASSAGE = "doc_id long, start_word long, end_word long, n_words long, n_equal_words long, sources array<long>"
MATCH = "doc long, at int, first_doc long, first_at int"

#: Words of a seed, as places from its first. The one left out may be changed, so changes five words apart leave seeds between them.
PLACES = (0, 1, 2, 3, 5, 6, 7, 8)

#: Documents with passages and their passages, up to this many together (some 60 bytes each), are broadcast; beyond it the join is shuffled.
BROADCAST_SPANS = 1_000_000

#: Windows begin and end at multiples of this many words, so that chains on one passage ask for the same one.
GRID = 64


def spaced(words: np.ndarray, places: tuple[int, ...] = PLACES) -> np.ndarray:
    """A 64-bit hash of the words at ``places`` from each position on, in order; none if there are too few words."""
    n = len(words) - places[-1]
    if n < 1:
        return words[:0]
    total = np.full(n, len(places), np.uint64)
    for k, p in enumerate(places):
        total = mixed(total + words[p : p + n] * ODD[k])
    return total


def _packed(docs: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> bytes:
    """Entries in order of documents, by columns: each document and its count once, positions and 48-bit seeds in planes."""
    first = np.flatnonzero(np.diff(docs, prepend=docs[0] - 1 if len(docs) else 0))
    counts = np.diff(np.append(first, len(docs)))
    parts = [np.array([len(docs), len(first)], "<u4"), docs[first].astype("<i8"), counts.astype("<u4"), (at & 0xFFFF).astype("<u2"), (at >> 16).astype("<u2")]
    parts += [(seeds & np.uint64(0xFFFFFFFF)).astype("<u4"), (seeds >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2")]
    return b"".join(x.tobytes() for x in parts)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """docs, at and seeds of ``_packed``."""
    n, d = np.frombuffer(blob, "<u4", 2).tolist()
    place, out = 8, []
    for kind, count in (("<i8", d), ("<u4", d), ("<u2", n), ("<u2", n), ("<u4", n), ("<u2", n)):
        out.append(np.frombuffer(blob, kind, count, place))
        place += out[-1].nbytes
    ids, counts, low, high, s_low, s_high = out
    return np.repeat(ids, counts), low.astype(np.int32) | high.astype(np.int32) << 16, s_low.astype(np.uint64) | s_high.astype(np.uint64) << np.uint64(32)


def _seeds(least: int, buckets: int, most: int = 1 << 18):
    """bucket, later, entries: the seeds of documents of ``least`` words or more, of about ``most`` words at a time, those that are the first of their kind among these and the later ones."""

    def flush(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        held.sort(key=lambda x: x[0])
        seeds = np.concatenate([h for _, h in held])
        docs = np.repeat(np.array([i for i, _ in held], np.int64), [len(h) for _, h in held])
        at = np.concatenate([np.arange(len(h), dtype=np.int32) for _, h in held])
        held.clear()
        key = ((seeds >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32) * 2 + 1
        key[np.unique(seeds, return_index=True)[1]] -= 1
        order = np.argsort(key, kind="stable")
        key, docs, at, seeds = key[order], docs[order], at[order], seeds[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        blobs = [_packed(docs[a:b], at[a:b], seeds[a:b]) for a, b in zip(first, np.append(first[1:], len(key)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array((key[first] // 2).astype(np.int32)), pa.array((key[first] % 2).astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "later", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("substrings", forget)
        held, n = [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = word_hashes(t.as_py())
                if len(words) >= max(least, PLACES[-1] + 1):
                    held.append((i, spaced(words)))
                    n += len(words)
                if n >= most:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _pointed(docs: np.ndarray, at: np.ndarray, first_docs: np.ndarray, first_at: np.ndarray, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Matches, where the first occurrence is in another document."""
    other = docs != first_docs
    columns = [docs[other], at[other].astype(np.int32), first_docs[other], first_at[other].astype(np.int32)]
    for low in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(c[low : low + most]) for c in columns], names=["doc", "at", "first_doc", "first_at"])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every seed's first occurrence, given to the others. A bucket holds its distinct seeds, of each task once; the later ones stream past."""
    bucket, held, firsts = None, [], None

    def settle() -> tuple[tuple, Iterator[pa.RecordBatch]]:
        docs, at, seeds = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(seeds, kind="stable")
        docs, at, seeds = docs[order], at[order], seeds[order]
        new = np.flatnonzero(np.diff(seeds, prepend=seeds[0] + np.uint64(1)))
        sizes = np.diff(np.append(new, len(seeds)))
        least = np.minimum.reduceat(docs, new)
        each = np.repeat(least, sizes)
        place = np.minimum.reduceat(np.where(docs == each, at, np.int32(2**31 - 1)), new)
        return (seeds[new], least, place), _pointed(docs, at, each, np.repeat(place, sizes))

    for batch in batches:
        for b, later, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if b != bucket:
                if held:
                    yield from settle()[1]
                bucket, held, firsts = b, [], None
            if not later:
                held.append(_unpacked(blob.as_py()))
                continue
            if firsts is None:
                firsts, out = settle()
                yield from out
                held = []
            docs, at, seeds = _unpacked(blob.as_py())
            found = np.searchsorted(firsts[0], seeds)
            yield from _pointed(docs, at, firsts[1][found], firsts[2][found])
    if held:
        yield from settle()[1]


def chains(anchors: list[tuple[int, int]], k: int, cost: float = 0.25, max_gap: int = 48) -> list[list[tuple[int, int]]]:
    """Collinear chains of (position, earlier position) anchors, best first, no anchor in two.

    score(i) = k + max(0, score(j) - cost * gaps between j and i) over all j that lie before i on both sides; a Fenwick tree over the
    earlier positions holds the best score(j) + cost * (its positions). As costs add up along a way, an anchor between j and i on both
    sides is always the better predecessor than j. A chain is cut where it steps over more than ``max_gap`` words on a side.
    """
    anchors = sorted(set(anchors))
    rank = {b: r for r, b in enumerate(sorted({b for _, b in anchors}), 1)}
    tree, owner = [float("-inf")] * (len(rank) + 1), [-1] * (len(rank) + 1)
    score, parent, entered = [], [], 0
    for a, b in anchors:
        while anchors[entered][0] < a:
            u, v = anchors[entered]
            value, r = score[entered] + cost * (u + v), rank[v]
            while r < len(tree) and tree[r] < value:
                tree[r], owner[r] = value, entered
                r += r & -r
            entered += 1
        best, j, r = float("-inf"), -1, rank[b] - 1
        while r:
            if tree[r] > best:
                best, j = tree[r], owner[r]
            r &= r - 1
        gain = best - cost * (a + b)
        score.append(k + max(0.0, gain))
        parent.append(j if gain > 0 else -1)
    used, found = [False] * len(anchors), []
    for i in sorted(range(len(anchors)), key=lambda x: (-score[x], x)):
        chain: list[tuple[int, int]] = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and (chain[-1][0] - anchors[i][0] > max_gap or chain[-1][1] - anchors[i][1] > max_gap):
                found.append(chain[::-1])
                chain = []
            chain.append(anchors[i])
            i = parent[i]
        if chain:
            found.append(chain[::-1])
    return found


def _bounded(rows: Iterator[tuple[int, tuple]], kinds: dict[str, pa.DataType], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``most`` numbers, however many rows come of one batch of documents; each row comes with its count."""
    out, held = [], 0
    for numbers, row in rows:
        out.append(row)
        held += numbers
        if held >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=[*kinds])
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=[*kinds])


_CHAIN = {"doc": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "first_doc": pa.int64(), "first_lo": pa.int32(), "first_hi": pa.int32(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32())}
CHAIN = "doc long, lo int, hi int, first_doc long, first_lo int, first_hi int, a array<int>, b array<int>"


def _thinned(other: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Of anchors that follow each other word by word on both sides, every k-th and the last: they cover the same words."""
    order = np.lexsort((a, a - b, other))
    other, a, d = other[order], a[order], (a - b)[order]
    new = np.ones(len(a) + 1, bool)
    new[1:-1] = (other[1:] != other[:-1]) | (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)
    at = np.arange(len(a))
    return order[((at - np.maximum.accumulate(np.where(new[:-1], at, 0))) % k == 0) | new[1:]]


def _sparser(other: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, step: int) -> np.ndarray:
    """Of anchors to one earlier position that overlap each other, the first, one for every ``step`` words, and the last.

    Overlapping words with one seed repeat themselves, as in a text of one word over and over, and all of their anchors say the same: the
    words around one of them, ``2 * step`` on each side, are aligned all the same.
    """
    order = np.lexsort((a, b, other))
    other, a, b = other[order], a[order], b[order]
    new = np.ones(len(a) + 1, bool)
    new[1:-1] = (other[1:] != other[:-1]) | (b[1:] != b[:-1]) | (a[1:] - a[:-1] >= k)
    slot = (a - a[np.maximum.accumulate(np.where(new[:-1], np.arange(len(a)), 0))]) // step
    return order[new[:-1] | new[1:] | (np.diff(slot, prepend=-1) != 0)]


def _by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Matches that come in order of documents: each document with its columns."""
    doc, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("doc", "first_doc", "at", "first_at")]
        if not len(columns[0]):
            continue
        starts = np.flatnonzero(np.diff(columns[0], prepend=columns[0][0]))
        for low, high in zip([0, *starts], [*starts, len(columns[0])], strict=True):
            if held and columns[0][low] != doc:
                yield doc, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            doc = int(columns[0][low])
            held.append([c[low:high] for c in columns[1:]])
    if held:
        yield doc, [np.concatenate(c) for c in zip(*held, strict=True)]


def _chained(k: int, reach: int):
    """Chains of each document, lone anchors too; and the windows around them."""

    def window(low: int, high: int) -> tuple[int, int]:
        return max(0, low - reach) // GRID * GRID, -(-(high + k + reach) // GRID) * GRID

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for doc, (others, a, b) in _by_doc(batches):
            kept = _sparser(others, a, b, k, reach // 2)
            others, a, b = others[kept], a[kept], b[kept]
            kept = _thinned(others, a, b, k)
            by: dict[int, list[tuple[int, int]]] = {}
            for other, p, q in zip(others[kept].tolist(), a[kept].tolist(), b[kept].tolist(), strict=True):
                by.setdefault(other, []).append((p, q))
            for other, anchors in by.items():
                for chain in chains(anchors, k, cost=k / 32):
                    p, q = [x for x, _ in chain], [y for _, y in chain]
                    yield 2 * len(chain) + 6, (doc, *window(p[0], p[-1]), other, *window(q[0], q[-1]), p, q)

    return lambda batches: _bounded(rows(batches), _CHAIN)


_WINDOW = {"doc": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "words": pa.binary()}


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a document in each of its windows, as 32-bit hashes."""

    def rows() -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            for doc, text, spans in zip(*(batch.column(c) for c in ("doc", "text", "spans")), strict=True):
                doc, words = doc.as_py(), word_hashes(text.as_py().encode()).astype("<u4")
                for lo, hi in sorted((x["lo"], x["hi"]) for x in spans.as_py()):
                    yield hi - lo, (doc, lo, hi, words[lo:hi].tobytes())

    return _bounded(rows(), _WINDOW)


def _equal_in_gap(x: np.ndarray, y: np.ndarray) -> int:
    """Words of a global alignment of two gaps that are equal: their longest common subsequence."""
    if len(x) == len(y) and (x == y).all():
        return len(x)
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == w)))
    return int(row[-1])


def _extend(x: np.ndarray, y: np.ndarray, drop: int = 6) -> tuple[int, int]:
    """How far x and y go on alike from their beginnings (1 for an equal word, -2 for another, until ``drop`` below the best), and equal words."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    same = x[:n] == y[:n]
    score = np.cumsum(np.where(same, 1, -2))
    best = np.maximum.accumulate(np.maximum(score, 0))
    stop = np.flatnonzero(best - score > drop)
    upto = int(stop[0]) if len(stop) else n
    if not upto or score[:upto].max() <= 0:
        return 0, 0
    far = int(score[:upto].argmax()) + 1
    return far, int(same[:far].sum())


def _pieces(x: np.ndarray, a: list[int], y: np.ndarray, b: list[int], k: int, identity: float) -> Iterator[tuple[int, int, int]]:
    """Start, end and equal words in ``x`` of the parts of a chain that are alike enough, ends extended.

    Anchors a in x and b in y are aligned with the gaps between them. A chain that is not alike enough as a whole is cut at its worst gap.
    """
    ends = [(a[0], a[0] + k, int((x[a[0] : a[0] + k] == y[b[0] : b[0] + k]).sum()), b[0], b[0] + k)]
    gaps = []  # words, equal words
    for u, v in zip(a[1:], b[1:], strict=True):
        p, q = ends[-1][1], ends[-1][4]
        skip = max(0, p - u, q - v)  # of the anchor's words, those that the one before covers on either side
        n = k - skip
        same = int((x[u + skip : u + k] == y[v + skip : v + k]).sum()) if n > 0 else 0
        s, t = u + min(skip, k), v + min(skip, k)
        gaps.append((max(0, s - p), _equal_in_gap(x[p:s], y[q:t])))
        ends.append((s, u + k, same, t, v + k))
    stack = [(0, len(ends))]
    while stack:
        low, high = stack.pop()
        back, same = _extend(x[: ends[low][0]][::-1], y[: ends[low][3]][::-1])
        on, more = _extend(x[ends[high - 1][1] :], y[ends[high - 1][4] :])
        start, end = ends[low][0] - back, ends[high - 1][1] + on
        equal = same + more + sum(e[2] for e in ends[low:high]) + sum(g[1] for g in gaps[low : high - 1])
        if equal >= identity * (end - start):
            yield start, end, equal
        elif high - low > 1:
            worst = max(range(low, high - 1), key=lambda i: identity * gaps[i][0] - gaps[i][1])
            stack += [(low, worst + 1), (worst + 1, high)]


def _aligned(k: int, min_words: int, identity: float):
    """Pieces of at least ``min_words`` words that one earlier document covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("doc", "first_doc", "lo", "first_lo", "a", "b", "words", "first_words")]
            for doc, other, lo, first_lo, a, b, x, y in zip(*columns, strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                for start, end, equal in _pieces(x, [p - lo for p in a], y, [q - first_lo for q in b], k, identity):
                    if end - start >= min_words:
                        out.append((doc, other, start + lo, end + lo, equal))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc", "first_doc", "start", "end", "equal"])

    return run


def _merged(slack: int):
    """Passages: pieces of one document that overlap or lie within ``slack`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, pieces in zip(batch.column("doc").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                spans: list[list] = []
                for p in sorted((p["start"], p["end"], p["equal"], p["first_doc"]) for p in pieces):
                    if spans and p[0] <= spans[-1][1] + slack:
                        own = spans[-1]
                        fresh = max(0, p[1] - max(p[0], own[1]))
                        own[2] += min(fresh, p[2])
                        own[1] = max(own[1], p[1])
                        own[3].add(p[3])
                    else:
                        spans.append([p[0], p[1], p[2], {p[3]}])
                out += [(doc, a, b, b - a, min(e, b - a), sorted(s)) for a, b, e, s in spans]
            if out:
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start_word", "end_word", "n_words", "n_equal_words", "sources"])

    return run


def _whole(min_words: int):
    """Copies of whole documents: one passage each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(t.as_py().split()) for t in batch.column("text").cast(pa.binary())]
            rows = [(d, 0, m, m, m, [f]) for d, f, m in zip(batch.column("doc").to_pylist(), batch.column("first_doc").to_pylist(), n, strict=True) if m >= min_words]
            if rows:
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start_word", "end_word", "n_words", "n_equal_words", "sources"])

    return run


def repeated_passages(df: DataFrame, min_words: int = 50, identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, n_words, n_equal_words, sources: passages of each document that an earlier document (by id) has too.

    A passage has at least ``min_words`` words that one earlier document has, at least ``identity`` of them equal ones of its alignment.
    It is found if it has a seed: always, if words are changed evenly, and in all of 4000 random draws of 60 to 100 words at identities
    from 0.8 on. A seed leads to its first occurrence only: a stretch of one word over and over is not found where the first document that
    has its seed has it in a shorter stretch. Passages that overlap are one; ``sources`` are the documents that they were aligned with. The first document of a passage keeps it and has no row for it, and a
    document equal to an earlier one is one passage. Words are compared with A to Z lower-cased, by 32-bit hashes in alignments. Null ids
    and null, empty or short texts have no passages; rows with the same id count as one document and must have one text; other columns
    are ignored.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    key = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(3), "text").alias("h2")]
    hashed = base.select("doc", *key)
    copies = hashed.join(hashed.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1"), ["h1", "h2"]).where("doc <> first_doc")
    copies = written(spark, copies.select("doc", "first_doc").distinct(), "copies")
    whole = base.join(copies, "doc").dropDuplicates(["doc"]).mapInArrow(_whole(min_words), PASSAGE)
    reps = base.join(copies.select("doc"), "doc", "left_anti")
    k = PLACES[-1] + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seeds = reps.select("doc", "text").mapInArrow(_seeds(int(identity * min_words), 2 * parts), "bucket int, later int, entries binary")
    seeds = seeds.repartitionById(parts, F.floor(F.col("bucket") / 2).cast("int")).sortWithinPartitions("bucket", "later")
    matches = seeds.mapInArrow(_matches, MATCH).repartition("doc").sortWithinPartitions("doc")
    found = written(spark, matches.mapInArrow(_chained(k, min_words), CHAIN), "chains")
    ends = F.array(F.struct("doc", "lo", "hi"), F.struct(F.col("first_doc").alias("doc"), F.col("first_lo").alias("lo"), F.col("first_hi").alias("hi")))
    spans = found.select(F.explode(ends).alias("w")).select("w.*").distinct().groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    windows = reps.join(spans, "doc").select("doc", "text", "spans").mapInArrow(_windows, "doc long, lo int, hi int, words binary")
    windows = written(spark, windows.dropDuplicates(["doc", "lo", "hi"]), "windows")
    first = windows.select(F.col("doc").alias("first_doc"), F.col("lo").alias("first_lo"), F.col("hi").alias("first_hi"), F.col("words").alias("first_words"))
    both = found.join(windows, ["doc", "lo", "hi"]).join(first, ["first_doc", "first_lo", "first_hi"])
    pieces = both.mapInArrow(_aligned(k, min_words, identity), "doc long, first_doc long, start long, end long, equal long")
    merged = pieces.groupBy("doc").agg(F.collect_list(F.struct("first_doc", "start", "end", "equal")).alias("pieces")).mapInArrow(_merged(2), PASSAGE)
    return merged.unionByName(whole)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if text and spans:
                starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
                kept, at = [], 0
                for a, b in sorted((s["start_word"], s["end_word"]) for s in spans):
                    kept.append(text[at : starts[min(a, len(starts) - 1)]])
                    at = max(at, starts[min(b, len(starts) - 1)])
                text = "".join([*kept, text[at:]])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def remove_passages(df: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the passages; documents that have no word left but had one go. Documents without a passage stay as they are.

    The passages are written, one row a document, and broadcast if they are few; else texts and passages meet in an exchange.
    """
    spark = df.sparkSession
    spans = passages.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    spans = written(spark, spans, "spans")
    size = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if size[0] + size[1] <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("__id"))
    joined = rows.join(spans, F.col("__id") == F.col("__doc"), "left")
    untouched = joined.where("spans is null").select("row", "text")
    cut = joined.where("spans is not null").select("row", "text", "spans").mapInArrow(_without, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    has_word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = untouched.unionByName(cut.where(has_word))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
