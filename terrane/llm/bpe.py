"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue (operator 5).

Each merge rank has a bucket of positions in a linked list of symbols. A bitmap of the non-empty buckets, with two more levels above
it, gives the next rank by find-first-set; entries whose pair is gone are skipped when they come up. All positions of a rank are merged
together, over a whole batch of pre-tokens or one very long one. Words that come again are looked up, in caches of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A space between white space and white space or the end: only there do the pattern's matches depend on more than a word and the space before it.
_WIDE = re.compile(r"\s (?:\s|\Z)")


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to ranks, from the content of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class RankQueue:
    """Positions by rank. ``pop`` gives the lowest rank that has any, with all of its positions."""

    def __init__(self, n_ranks: int) -> None:
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [positions]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(positions)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            self.push(rank, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) + (word & -word).bit_length() - 1
        word = self.low[b]
        rank = (b << 6) + (word & -word).bit_length() - 1
        self.low[b] &= word - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Merger:
    """Encodes pre-tokens by ranks, many at once: their linked lists lie end to end in one set of arrays, behind stoppers, and share the queue.

    Merging every leftmost pair of the lowest rank of all lists is what each list alone would do: a merge makes pairs of other ranks only.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.n_ranks = max(ranks.values(), default=0) + 1
        get = ranks.get
        pairs = {(get(t[:k]) * self.n_ranks + get(t[k:])): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)
        self.single = np.array([get(bytes([b]), -1) for b in range(256)], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, or -1. Stoppers are -1 and pair with nothing."""
        wanted = left * self.n_ranks + right
        at = np.searchsorted(self.keys, wanted)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.values[at], -1)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, packed as little-endian 32-bit numbers."""
        found: list[bytes | None] = [None] * len(pieces)
        rest = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                found[k] = whole.to_bytes(4, "little")
            elif piece:
                rest.append(k)
            else:
                found[k] = b""
        if rest:
            for k, ids in zip(rest, self._merge([pieces[k] for k in rest]), strict=True):
                found[k] = ids
        return found

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        ends = np.cumsum([len(p) + 1 for p in pieces])  # where each list's stopper stands; node 0 is a stopper too
        n = int(ends[-1]) + 1
        token = np.full(n, -1, np.int64)
        inner = np.ones(n, bool)
        inner[0] = False
        inner[ends] = False
        token[inner] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.append(self._rank(token[:-1], token[1:]), -1)
        queue = RankQueue(self.n_ranks)
        start = np.flatnonzero(pair >= 0)
        if len(start):
            queue.push_all(pair[start], start)
        while (entry := queue.pop()) is not None:
            rank, at = entry
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # of pairs that share a symbol, every other one from the left
                    run = np.cumsum(np.concatenate(([True], ~chained)))
                    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
                    at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            after[at], before[follow], token[at] = follow, at, rank
            pair[gone], token[gone] = -1, -2
            anew = np.concatenate((before[at], at))
            ranks = self._rank(token[anew], token[after[anew]])
            pair[anew] = ranks
            good = ranks >= 0
            if good.any():
                if good.sum() == 1:
                    k = int(good.argmax())
                    queue.push(int(ranks[k]), anew[k : k + 1])
                else:
                    queue.push_all(ranks[good], anew[good])
        alive = np.flatnonzero(token >= 0)
        packed = token[alive].astype("<u4").tobytes()
        cuts = [0, *(4 * np.searchsorted(alive, ends)).tolist()]
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Cache:
    """Strings to packed ids, in two generations of bounded size; what is used again comes back from the old one."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], most: int = 150_000, longest: int = 48) -> None:
        self.make, self.most, self.longest = make, most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ready(self, needed: set[str]) -> dict[str, bytes]:
        """A dictionary that has all the needed strings, until the next call."""
        if len(self.young) + len(needed) > self.most:
            self.old = {k: v for k, v in self.young.items() if len(k) <= self.longest}
            self.young = {}
        todo = []
        for key in needed.difference(self.young):
            found = self.old.get(key)
            if found is None:
                todo.append(key)
            else:
                self.young[key] = found
        if todo:
            self.young.update(zip(todo, self.make(todo), strict=True))
        return self.young


class Words:
    """Encodes texts word by word. ``make`` encodes many strings at once; ids are packed as little-endian 32-bit numbers."""

    def __init__(self, make: Callable[[list[str]], list[bytes]]) -> None:
        self.make = make
        self.cache = Cache(lambda words: make([" " + w for w in words]))

    def encode(self, texts: list[str]) -> list[bytes]:
        wide = [k for k, t in enumerate(texts) if _WIDE.search(t)]
        found = dict(zip(wide, self.make([texts[k] for k in wide]), strict=True)) if wide else {}
        needed: set[str] = set()
        heads = []
        for k, t in enumerate(texts):
            if k in found:
                heads.append("")
            else:
                head, *rest = t.split(" ")
                heads.append(head)
                needed.update(rest)
        ids = self.cache.ready(needed).__getitem__
        heads = self.make(heads)
        return [found[k] if k in found else heads[k] + b"".join(map(ids, t.split(" ")[1:])) for k, t in enumerate(texts)]


class Encoder:
    """A rank vocabulary with its pattern."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        self.ranks = load_ranks(vocabulary)
        self.split, self.merger = regex.compile(pattern).findall, Merger(self.ranks)
        self.pieces = Cache(lambda new: self.merger.encode([p.encode("utf-8", "surrogatepass") for p in new]))
        self.words = Words(self._strings)
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _strings(self, strings: list[str]) -> list[bytes]:
        split = [self.split(s) for s in strings]
        ids = self.pieces.ready({p for pieces in split for p in pieces}).__getitem__
        return [b"".join(map(ids, pieces)) for pieces in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.words.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.bytes[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


_encoders: dict[bytes, Encoder] = {}


def encoder(vocabulary: bytes, pattern: str) -> Encoder:
    """The encoder of a vocabulary; a Python worker keeps it, with its caches, from task to task."""
    key = hashlib.blake2b(vocabulary + pattern.encode(), digest_size=16).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, pattern)
    return _encoders[key]


def id_lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as a column of int lists."""
    offsets = np.concatenate(([0], np.cumsum([len(p) >> 2 for p in packed]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _mapped(df: DataFrame, column: str, kind: str, source: str, cast: str, work, slice_bytes: int, keep: list[str] | None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all if not given) and ``column``, made by ``work`` from the Arrow column ``source``, in slices of
    about ``slice_bytes``. The source goes to the workers once, and comes back only if it is kept."""
    names = [c for c in (df.columns if keep is None else keep) if c.lower() != column]
    rest = [c for c in names if c != source]
    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{source}`").cast(cast).alias("x"))
    back = source in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = work()
        for batch in batches:
            step = max(1, min(batch.num_rows, batch.num_rows * slice_bytes // max(1, batch.column(1).nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = [part.column(0), *([part.column(1)] if back else []), apply(part.column(1))]
                yield pa.RecordBatch.from_arrays(made, names=["row", *(["x"] if back else []), "y"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {f'x {cast}, ' if back else ''}y {kind}")
    return out.select(*[F.col("x").alias(c) if c == source else F.col(f"row.`{c}`").alias(c) for c in names], F.col("y").alias(column))


def encode(df: DataFrame, vocabulary: bytes, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all if not given) with ``ids``, the token ids of the whole text; a column of that name is replaced.

    Null and empty texts have no ids. Other columns, null ids, ties and repeated rows pass as they are. The vocabulary (about a
    megabyte) goes to the executors as a broadcast variable, so they need no file.
    """
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, pattern))

    def work():
        own = encoder(*shared.value)
        return lambda texts: id_lists(own.encode([t or "" for t in texts.to_pylist()]))

    return _mapped(df, "ids", "array<int>", text_col, "string", work, 4 << 20, keep)


def decode(df: DataFrame, vocabulary: bytes, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``decoded``, the bytes of the ids. Null ids give null; an empty list gives no bytes."""
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, pattern))

    def work():
        own = encoder(*shared.value)
        return lambda lists: pa.array([None if not x.is_valid else own.decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)) for x in lists], pa.binary())

    return _mapped(df, "decoded", "binary", ids_col, "array<int>", work, 4 << 20, keep)
