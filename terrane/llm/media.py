"""Copies among images by local descriptors (operator 7).

Corners are found at several scales, each gets an orientation and 256 binary intensity tests turned with it, in a patch of 31 pixels.
Corners whose descriptors differ in three bits at most match: these agree in one of four 64-bit words, so all of them meet in a table of
such words. Pairs of images whose matched corners follow one similarity transform are copies, cropped, brightened, turned or scaled.

Each table entry passes the exchange packed, in some fifty bytes, once for each of two rounds. The first gives the matches of the least
image of a word with the others, as many as entries. What it links is one class from then on, so a large group of copies does not give
all its pairs. Unrelated images have alike corners too, and more with every image, so the second round gives no matches: it gives each
corner the group of alike corners that it lies in within a word, if the group has several classes. Corners that match have a group in
common. An image needs ``LEAST`` places with a group, and two images that can be copies have the rarest group of those they share among
the groups that leave each of them as many places with that group or commoner ones. Only images that meet there are compared, corner by
corner, so no copy between two classes is lost.

The media column is (width, height, pixels): 8-bit grey values by rows. The corpus has no table of images, so ``drawn_images`` draws
one from every embedding, and an edited copy for some; the operator itself takes any table of this form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import written
from terrane.llm.components import components

SCALES = (1.0, 0.75, 0.5625)
RADIUS = 15
TABLES = 4
FAR = TABLES - 1

#: Matched corners at different places that a pair of images needs. Compared one with the other, 0.99 of drawn pictures have four in common
#: with their cropped and brightened copy (0.95 have six); of 180,000 unrelated pairs none has two.
LEAST = 4

IMAGE = "image_id long, width int, height int, pixels binary"
DESCRIBED = "image long, n int, places binary, bits binary"
MATCH = "a long, b long, p int, q int"
GROUPED = "image long, label long, corner int, token long"


def draw(vector: np.ndarray, side: int = 96) -> np.ndarray:
    """A picture of rectangles whose places and greys follow from the numbers of the vector."""
    random = np.random.default_rng(np.frombuffer(hashlib.blake2b(vector.astype("<f4").tobytes(), digest_size=16).digest(), np.uint32))
    image = np.full((side, side), 128.0)
    for _ in range(22):
        x, y, w, h = random.integers(0, side - 8), random.integers(0, side - 8), random.integers(8, 40), random.integers(8, 40)
        image[y : y + h, x : x + w] = random.integers(20, 220)
    return image.astype(np.uint8)


def edit(image: np.ndarray) -> np.ndarray:
    """A cropped and brightened copy."""
    h, w = image.shape
    return np.minimum(255, image[h // 10 : h - h // 20, w // 12 : w - w // 10].astype(np.int64) + 20).astype(np.uint8)


def drawn_images(vectors: DataFrame, every: int = 8) -> DataFrame:
    """image_id (2 * vec_id; the edited copy of every ``every``-th vector has the next odd number), width, height, pixels. A null vector has no picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid:
                    continue
                image = draw(v.values.to_numpy(zero_copy_only=False))
                rows.append((2 * i, image))
                if i % every == 3:
                    rows.append((2 * i + 1, edit(image)))
            for at in range(0, len(rows), 500):
                part = rows[at : at + 500]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), *(pa.array([r[1].shape[k] for r in part], pa.int32()) for k in (1, 0)), pa.array([r[1].tobytes() for r in part], pa.binary())], names=["image_id", "width", "height", "pixels"])

    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v")).mapInArrow(run, IMAGE)


def _resize(image: np.ndarray, scale: float) -> np.ndarray:
    h, w = (max(1, int(n * scale)) for n in image.shape)
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y, x = y.clip(0, image.shape[0] - 1), x.clip(0, image.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), image.shape[0] - 2), np.minimum(x.astype(int), image.shape[1] - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    rows = image[y0] * (1 - fy) + image[y0 + 1] * fy
    return rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx


def _blur(image: np.ndarray, n: int) -> np.ndarray:
    """The mean of n by n pixels, by sums over rows and columns."""
    pad = n // 2
    s = np.pad(image, pad + 1, mode="edge")[:-1, :-1].cumsum(0).cumsum(1)
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


@cache
def _pattern() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """256 pairs of points within the radius, and the offsets of the patch that gives the orientation."""
    random = np.random.default_rng(11)
    points = random.normal(0, RADIUS / 2.2, (256, 2, 2)).clip(-RADIUS + 2, RADIUS - 2)
    grid = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1].reshape(2, -1)
    return points[:, 0], points[:, 1], grid[:, (grid**2).sum(0) <= RADIUS**2]


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x, y, scale and angle of every corner, and its 256 bits as eight 32-bit words. Images too small for a patch have none."""
    corners, bits = [np.empty((0, 4), np.float32)], [np.empty((0, 8), np.uint32)]
    first, second, disc = _pattern()
    for scale in SCALES:
        level = _resize(image.astype(np.float64), scale) if scale < 1 and min(image.shape) > 1 else image.astype(np.float64)
        if min(level.shape) <= 2 * RADIUS + 3:
            continue
        gy, gx = np.gradient(_blur(level, 3))
        xx, yy, xy = (_blur(g, 5) for g in (gx * gx, gy * gy, gx * gy))
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        m = RADIUS + 1
        inner = response[m:-m, m:-m]
        around = np.max([response[m + a : response.shape[0] - m + a, m + b : response.shape[1] - m + b] for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2)], axis=0)
        y, x = np.nonzero((inner == around) & (inner > 2000))
        if not len(y):
            continue
        y, x = y + m, x + m
        patch = level[y[:, None] + disc[0], x[:, None] + disc[1]]
        angle = np.arctan2((patch * disc[0]).sum(1), (patch * disc[1]).sum(1))
        smooth, c, s = _blur(level, 5), np.cos(angle)[:, None], np.sin(angle)[:, None]
        look = lambda p: smooth[np.rint(y[:, None] + s * p[:, 1] + c * p[:, 0]).astype(int).clip(0, level.shape[0] - 1), np.rint(x[:, None] + c * p[:, 1] - s * p[:, 0]).astype(int).clip(0, level.shape[1] - 1)]  # noqa: B023, E731
        tests = look(first) < look(second) - 0.5
        corners.append(np.stack((x / scale, y / scale, np.full(len(x), scale), angle), 1).astype(np.float32))
        bits.append(np.packbits(tests, axis=1).view(">u4").astype(np.uint32))
    return np.concatenate(corners), np.concatenate(bits)


def _descriptors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each image that has corners: their number, places (x, y, scale, angle as 32-bit floats) and descriptors (32 bytes each)."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            w, h, data = (batch.column(c)[i].as_py() for c in ("width", "height", "pixels"))
            at, bits = describe(np.frombuffer(data, np.uint8).reshape(h, w))
            if len(at):
                rows.append((batch.column("image_id")[i].as_py(), len(at), at.astype("<f4").tobytes(), bits.astype(">u4").tobytes()))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["image", "n", "places", "bits"])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _entries(buckets: int, most: int = 1 << 18):
    """bucket, table, entries: every corner's entry in each of the tables, packed: images, their labels, corners and descriptors."""

    def flush(held: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        bits = np.frombuffer(b"".join(b for _, _, b in held), "<u8").reshape(-1, TABLES)
        sizes = [len(b) // 32 for _, _, b in held]
        image, label = (np.repeat(np.array([r[k] for r in held], np.int64), sizes) for k in (0, 1))
        corner = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        for table in range(TABLES):
            bucket = (_mixed(bits[:, table]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1))
            for low, high in zip(first, np.append(first[1:], len(order)), strict=True):
                own = order[low:high]
                yield int(bucket[order[low]]), table, b"".join(x[own].tobytes() for x in (image, label, corner, bits))

    def packed(held: list) -> pa.RecordBatch:
        columns = zip(*flush(held), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "table", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("image", "label", "bits")), strict=True):
                held.append(row)
                n += len(row[2]) // 32
                if n >= most:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return run


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    """image, label, corner and descriptors of all entries."""
    out = []
    for blob in blobs:
        n = len(blob) // 52
        out.append([np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<i8", n, 8 * n), np.frombuffer(blob, "<i4", n, 16 * n), np.frombuffer(blob, "<u8", TABLES * n, 20 * n).reshape(n, TABLES)])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal sorted keys begins, and its length."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


def _close(bits: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[u] ^ bits[v]).sum(1) <= FAR


def _all_pairs(start: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within each run, some ``most`` at a time."""
    place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    after = np.repeat(start + size, size) - place - 1  # how many later ones each meets
    ends = np.cumsum(after)
    low = 0
    while low < len(place):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
        n = after[low:high]
        u = np.repeat(place[low:high], n)
        yield u, u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
        low = high


def _near_in(bits: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one word that are close and have different labels. What lies in many entries is told apart by parts of the other
    words: of as many parts as tables, two close descriptors agree in one."""
    parts = np.array_split(np.arange(bits.shape[1] * 4), TABLES)
    quarters = bits.view("<u2")
    for number, part in enumerate(parts):
        key = np.ascontiguousarray(quarters[:, part]).view(f"V{2 * len(part)}").ravel()
        order = np.argsort(key, kind="stable")
        start, size = _spans(key[order])
        several = size > 1
        for u, v in _all_pairs(start[several], size[several]):
            u, v = order[u], order[v]
            fresh = label[u] != label[v]
            for earlier in parts[:number]:
                fresh &= (quarters[u][:, earlier] != quarters[v][:, earlier]).any(1)
            u, v = u[fresh], v[fresh]
            close = _close(bits, u, v)
            yield u[close], v[close]


def _united(group: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each one's group, once u and v are in one."""
    while (group[u] != group[v]).any():
        np.minimum.at(group, np.maximum(group[u], group[v]), np.minimum(group[u], group[v]))
        while (group[group] != group).any():
            group = group[group]
    return group


def _alike(kinds: np.ndarray, table: int, step: int, small: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of descriptors, sorted by their word of this table, whose groups join up all that are close and first meet in this table.

    Of words with more than ``small`` descriptors those are compared that agree in a part of the other words too, as two close ones do; where
    still more agree, they are one group without being compared, so the work grows with the descriptors. A group may be too large, never too small.
    """

    def close(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = _close(kinds, u, v) & (kinds[u, :table] != kinds[v, :table]).all(1)
        return u[keep], v[keep]

    start, size = _spans(kinds[:, table])
    few = (size > 1) & (size <= small)
    yield from (close(u, v) for u, v in _all_pairs(start[few], size[few], step))
    large = np.flatnonzero(np.repeat(size > small, size))
    quarters = np.ascontiguousarray(np.delete(kinds[large], table, 1)).view("<u2")
    words = kinds[large, table].copy().view("<u2").reshape(-1, 4)
    for part in np.array_split(np.arange(quarters.shape[1]), TABLES):
        key = np.concatenate((words, quarters[:, part]), 1)
        key = key.view(f"V{2 * key.shape[1]}").ravel()
        order = np.argsort(key, kind="stable")
        start, size = _spans(key[order])
        order, few = large[order], (size > 1) & (size <= small)
        yield from (close(order[u], order[v]) for u, v in _all_pairs(start[few], size[few], step))
        many = np.repeat(size > small, size)
        yield order[np.repeat(start, size)[many]], order[many]


def _met(mode: str, step: int = 1 << 20, small: int = 256):
    """What corners of the buckets have in common, some ``step`` pairs compared at a time: matches with the least image of each word
    (``stars``), the group of each corner that is alike to others of different labels (``groups``, as ``GROUPED``), at most one row an
    entry; or all matches between images of different labels, each once (``all``), which are as many as pairs."""

    def groups(table: int, image: np.ndarray, label: np.ndarray, corner: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((*bits.T, bits[:, table]))
        start, size = _spans(bits[order, table])
        order = order[np.repeat(np.minimum.reduceat(label[order], start) != np.maximum.reduceat(label[order], start), size)]
        image, label, corner, bits = image[order], label[order], corner[order], bits[order]
        first, size = _spans(np.ascontiguousarray(bits).view("V32").ravel())
        kinds, group = bits[first], np.arange(len(first))
        for u, v in _alike(kinds, table, step, small):
            group = _united(group, u, v)
        own = np.repeat(group, size)
        low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(low, own, label)
        np.maximum.at(high, own, label)
        # equal descriptors meet in the first table
        live = (low < high) & ((np.bincount(group, minlength=len(first)) > 1) | (table == 0))
        token = np.full(len(first), table, np.uint64)
        for k in range(TABLES):
            token = _mixed(token * np.uint64(31) + kinds[group, k])
        keep = live[own]
        return [image[keep], label[keep], corner[keep], token.view(np.int64).repeat(size)[keep]]

    def bucket(table: int, blobs: list[bytes]) -> Iterator[list[np.ndarray]]:
        image, label, corner, bits = _unpacked(blobs)
        if mode == "groups":
            yield groups(table, image, label, corner, bits)
            return
        order = np.lexsort((corner, image, bits[:, table]))
        image, label, corner, bits = image[order], label[order], corner[order], bits[order]
        start, size = _spans(bits[:, table])
        if mode == "stars":
            head = np.repeat(start, size)
            v = np.flatnonzero(image != image[head])
            found = [(head[v], v)]
        else:
            several = (size > 1) & (np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start))
            paired, large = several & (size <= small), several & (size > small)
            rest = np.delete(np.arange(TABLES), table)
            found = ((u[other], v[other]) for u, v in _all_pairs(start[paired], size[paired], step) for other in [label[u] != label[v]])
            found = chain(found, ((u + a, v + a) for a, n in zip(start[large], size[large], strict=True) for u, v in _near_in(np.ascontiguousarray(bits[a : a + n][:, rest]), label[a : a + n])))
        for u, v in found:
            # each match in the first table that has it
            keep = _close(bits, u, v) & ((bits[u, :table] != bits[v, :table]).all(1) if mode == "all" else True)
            u, v = u[keep], v[keep]
            swap = image[u] > image[v]
            u, v = np.where(swap, v, u), np.where(swap, u, v)
            yield [image[u], image[v], corner[u], corner[v]]

    names = [c.split()[0] for c in (GROUPED if mode == "groups" else MATCH).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "table", "entries")), strict=True))
        for b, table, blob in chain(rows, [(None, None, None)]):
            if (b, table) != here and held:
                yield from (pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=names) for x in bucket(here[1], held) if len(x[0]))
                held = []
            here = b, table
            held.append(blob)

    return run


def consensus(matches: np.ndarray, near: float = 3.0, loose: float = 8.0) -> int:
    """The most matches (x, y, scale, angle of both sides) that follow one similarity transform, each corner counted once.

    Each match proposes the transform of its scales and angles. As an angle is known to a few degrees only, the matches that follow it
    loosely give a better one by least squares, and what follows that within ``near`` pixels counts.
    """
    a, b = (matches[:, k] + 1j * matches[:, k + 1] for k in (0, 4))
    grow = matches[:, 2] / matches[:, 6] * np.exp(1j * (matches[:, 7] - matches[:, 3]))
    best = 0
    for i in range(len(matches)):
        for alpha, origin, image, reach in ((grow[i], a[i], b[i], near), (None, None, None, near)):
            if alpha is None:
                close = np.abs(b - b[i] - grow[i] * (a - a[i])) < loose
                origin, image = a[close].mean(), b[close].mean()
                spread = (np.abs(a[close] - origin) ** 2).sum()
                if spread < 1:
                    continue
                alpha = (np.conj(a[close] - origin) * (b[close] - image)).sum() / spread
            held = np.abs(b - image - alpha * (a - origin)) < reach
            if held.sum() > best:
                best = max(best, min(len(np.unique(np.rint(side[held] / 4))) for side in (a, b)))
    return best


def _all_matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of descriptors of two images that are close."""
    p, q = [], []
    for low in range(0, len(a), 512):
        u, v = np.nonzero(np.bitwise_count(a[low : low + 512, None] ^ b[None]).sum(2) <= FAR)
        p.append(u + low)
        q.append(v)
    return np.concatenate(p), np.concatenate(q)


def _agreeing(least: int):
    """Keeps pairs of images of whose corners ``least`` follow one transform; all corners of both are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, *sides in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "places_a", "places_b", "bits_a", "bits_b")), strict=True):
                p, q = _all_matches(*(np.frombuffer(x, "<u8").reshape(-1, TABLES) for x in sides[2:]))
                first, second = (np.frombuffer(x, "<f4").reshape(-1, 4) for x in sides[:2])
                agree = consensus(np.concatenate((first[p], second[q]), 1)) if len(p) >= least else 0
                if agree >= least:
                    out.append((a, b, agree))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "n_corners"])

    return run


def _matches(described: DataFrame, labels: DataFrame | None, mode: str) -> DataFrame:
    """Matches of corners p and q of images a and b, or the groups of corners, as ``_met`` gives them."""
    spark = described.sparkSession
    corners = described.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-corners * TABLES // 1_000_000))
    if labels is None:
        rows = described.select("image", F.lit(0).cast("long").alias("label"), "bits")
    else:
        rows = described.join(labels, F.col("image") == F.col("node"), "left").select("image", F.coalesce("component", "image").alias("label"), "bits")
    entries = rows.mapInArrow(_entries(parts), "bucket int, table int, entries binary").repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "table")
    return entries.mapInArrow(_met(mode), GROUPED if mode == "groups" else MATCH)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """image, label, place, token: the groups of every place of an image, numbered as ``consensus`` tells places apart."""
    for batch in batches:
        for image, label, data, found in zip(*(batch.column(c).to_pylist() for c in ("image", "label", "places", "found")), strict=True):
            at = np.frombuffer(data, "<f4").reshape(-1, 4)
            _, place = np.unique(np.rint((at[:, 0] + 1j * at[:, 1]) / 4), return_inverse=True)
            own = sorted({(int(place[f["corner"]]), f["token"]) for f in found})
            yield pa.RecordBatch.from_arrays([pa.array([image] * len(own), pa.int64()), pa.array([label] * len(own), pa.int64()), pa.array([o[0] for o in own], pa.int32()), pa.array([o[1] for o in own], pa.int64())], names=["image", "label", "place", "token"])


def matched_images(described: DataFrame, pairs: DataFrame, least: int = LEAST) -> DataFrame:
    """a, b, n_corners: those of the pairs (a, b) at least ``least`` of whose matched corners follow one transform."""
    side = lambda s: described.select(F.col("image").alias(s), F.col("places").alias(f"places_{s}"), F.col("bits").alias(f"bits_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_agreeing(least), "a long, b long, n_corners long")


def _enough(matches: DataFrame, least: int) -> DataFrame:
    return matches.groupBy("a", "b").agg(F.count_distinct("p").alias("n")).where(F.col("n") >= least).select("a", "b")


def _ranked(rows: DataFrame, least: int) -> DataFrame:
    """Rows whose group has several labels, of images with ``least`` places; rank orders groups, rare ones first, and last is the highest
    rank of an image from which on it has as many places."""
    spark = rows.sparkSession
    shared = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    ranked = written(spark, rows.join(shared, "token").select("image", "label", "place", "token", F.struct("n", "token").alias("rank")), "ranked")
    highest = ranked.groupBy("image", "place").agg(F.max("rank").alias("rank")).groupBy("image").agg(F.sort_array(F.collect_list("rank"), asc=False).alias("ranks"))
    return written(spark, ranked.join(highest.where(F.size("ranks") >= least).select("image", F.col("ranks")[least - 1].alias("last")), "image"), "places")


def _rest(described: DataFrame, labels: DataFrame, least: int = LEAST) -> DataFrame:
    """a, b: pairs of images with different labels that may have ``least`` matches at different places.

    Two images with so many share a group at as many places of each. The rarest of these groups has that many places at its rank or above
    in both images, so they meet in it. Leaving out images with too few places lets groups go, and more images with them; it is done twice.
    """
    spark = described.sparkSession
    found = written(spark, _matches(described, labels, "groups"), "groups")
    several = found.groupBy("image", "label").agg(F.collect_list(F.struct("corner", "token")).alias("found"), F.count_distinct("corner").alias("n")).where(F.col("n") >= least)
    rows = several.drop("n").join(described.select("image", "places"), "image").mapInArrow(_places, "image long, label long, place int, token long")
    rows = _ranked(_ranked(written(spark, rows, "places"), least).drop("rank", "last"), least)
    rare = written(spark, rows.where("rank <= last").select("token", "label", "image").distinct(), "rare")
    # classes meet first, so images of one class are not compared with each other
    side = lambda s: rare.select("token", F.col("label").alias(f"label_{s}"), F.col("image").alias(s))
    classes = lambda s: side(s).select("token", f"label_{s}").distinct()
    meet = classes("a").join(classes("b"), "token").where("label_a < label_b")
    pairs = meet.join(side("a"), ["token", "label_a"]).join(side("b"), ["token", "label_b"])
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def find_copies(images: DataFrame) -> DataFrame:
    """image_id and class_id (the least image reachable over copies) of every image.

    Images with equal pixels are one class from the start, however many they are. Null, empty or broken pixels (not width times height
    bytes) and images too small for a patch match nothing; such an image is a class of its own. Rows that repeat an id get a row each;
    a null id has the class of the images with its pixels, else null. Other columns are ignored.
    """
    spark = images.sparkSession
    digest = F.sha2(F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit("|"), F.hex("pixels")), 256)
    good = F.coalesce((F.col("width") > 0) & (F.length("pixels") == F.col("width").cast("long") * F.col("height")), F.lit(False))
    all_rows = written(spark, images.select("image_id", F.when(good, digest).alias("same"), "width", "height", "pixels"), "images")
    reps = all_rows.where("same is not null").groupBy("same").agg(F.min("image_id").alias("rep"))
    one = all_rows.where("image_id is not null").join(reps, "same").where("image_id = rep").dropDuplicates(["same"])
    described = written(spark, one.select("image_id", "width", "height", "pixels").mapInArrow(_descriptors, DESCRIBED), "descriptors")
    links = written(spark, matched_images(described, _enough(_matches(described, None, "stars"), LEAST)).select("a", "b"), "stars")
    rest = matched_images(described, _rest(described, components(links))).select("a", "b")
    found = components(links.unionByName(rest))
    out = all_rows.select("image_id", "same").join(reps, "same", "left").join(found, F.col("rep") == F.col("node"), "left")
    return out.select("image_id", F.coalesce("component", "rep", "image_id").alias("class_id"))
