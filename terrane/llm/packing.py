"""Packing by shortest-pack-first over the length histogram (operator 6).

Documents become token ids and are cut into pieces of at most a sequence's length. Lengths are placed longest first, each on the
shortest packs that have room, on counts of packing patterns alone: the work depends on the number of lengths, not of documents.
A placement covers a range of ranks within one length, so pieces find their sequence and offset by length and rank.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.llm.bpe import Merger, Words, id_lists
from terrane.llm.common import take_over, written

#: Rank offsets up to this many rows (some 140 bytes each once built) are broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000

#: Texts with a run of white space of this length or more don't go through the fast core as a whole.
LONG_SPACE = 100_000
_SPACES = re.compile(r"\s{%d}" % LONG_SPACE)

PIECE = "doc_id {0}, start long, length long, doc_tokens long, ids array<int>, part int, local_rank long"


class Tokenizer:
    """The ids of a byte-level BPE file of the tokenizers library.

    The library itself encodes texts that hold one of its added tokens. All others have the same ids from its ranks in tiktoken, five
    times as fast; a test compares the two.
    """

    def __init__(self, definition: str) -> None:
        import tiktoken
        import tokenizers

        self.own = tokenizers.Tokenizer.from_str(definition)
        kinds = [(json.loads(definition).get(k) or {}).get("type") for k in ("normalizer", "pre_tokenizer", "model")]
        if kinds != [None, "ByteLevel", "BPE"] or json.loads(definition)["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE definition: {kinds}")
        added = {t.content for t in self.own.get_added_tokens_decoder().values()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {bytes(_BYTES[c] for c in token): i for token, i in self.own.get_vocab(False).items() if token not in added}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = sorted(added)
        self.fast = fast.encode_ordinary
        self.opens = np.zeros(max(ranks.values(), default=0) + 1, bool)  # tokens that begin with a space
        for token, i in ranks.items():
            self.opens[i] = token[:1] == b" "
        self.words = Words(self._strings)
        self.split, self.ranks, self.merger = regex.compile(pattern).findall, ranks, None

    def _one(self, text: str) -> bytes:
        """The ids of one string. Runs of white space of hundreds of thousands of characters, which the fast core can't take, go through the rank queue."""
        if len(text) < LONG_SPACE or not _SPACES.search(text):
            return np.array(self.fast(text), "<u4").tobytes()
        self.merger = self.merger or Merger(self.ranks)
        return b"".join(self.merger.encode([p.encode() for p in self.split(text)]))

    def _strings(self, strings: list[str]) -> list[bytes]:
        """Strings that are a space and a word without white space go through as one text, and are told apart by their spaces."""
        plain = [k for k, s in enumerate(strings) if len(s) > 1 and s[0] == " " and len(s.split()) == 1 and not s[1].isspace() and not s[-1].isspace()]
        if len(plain) < 100:
            return [self._one(s) for s in strings]
        ids = np.array(self.fast("".join([strings[k] for k in plain])), "<u4")
        cuts = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
        packed, found = ids.tobytes(), dict.fromkeys(range(len(strings)))
        found.update((k, packed[a:b]) for k, a, b in zip(plain, cuts[:-1], cuts[1:], strict=True))
        return [self._one(strings[k]) if x is None else x for k, x in found.items()]

    def encode(self, texts: list[str]) -> list[bytes]:
        special = {k for k, t in enumerate(texts) for a in self.added if a in t}
        found = self.words.encode([t if k not in special else "" for k, t in enumerate(texts)])
        for k in special:
            found[k] = np.array(self.own.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()
        return found


def _byte_characters() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_BYTES = _byte_characters()
_tokenizers: dict[str, Tokenizer] = {}


def forget() -> None:
    _tokenizers.clear()


def tokenizer(definition: str) -> Tokenizer:
    """The tokenizer of a definition; a Python worker keeps it, with its caches, until it works for another operator."""
    take_over("packing", forget)
    key = hashlib.blake2b(definition.encode(), digest_size=16).hexdigest()
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(definition)
    return _tokenizers[key]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, first rank, count, first sequence, offset) and the number of sequences.

    Lengths are taken longest first. Each goes on the packs with the most room left, counted as patterns: a run of sequences that are
    filled alike. Where a length runs out within a run, the run is split in two.
    """
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, count)
    placements, sequences, roomiest = [], 0, 0
    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while n:
            while roomiest and not open_runs[roomiest]:
                roomiest -= 1
            if roomiest < length:
                first, count, room = sequences, n, capacity
                sequences += n
            else:
                first, count = open_runs[room := roomiest].pop()
                if count > n:
                    open_runs[room].append((first + n, count - n))
                    count = n
            placements.append((length, rank, count, first, capacity - room))
            if room > length:
                open_runs[room - length].append((first, count))
                roomiest = max(roomiest, room - length)
            n, rank = n - count, rank + count
    return placements, sequences


def _pieces(shared, capacity: int, end: int, slice_bytes: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = tokenizer(shared.value), np.zeros(capacity + 1, np.int64)
        part, tail = TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "local_rank"]
        for whole in batches:
            step = max(1, min(whole.num_rows, whole.num_rows * slice_bytes // max(1, whole.column(1).nbytes)))
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                rows: list[tuple] = []
                for k, ids in enumerate(own.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids += tail
                    n = len(ids) >> 2
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        rows.append((k, start, length, n, ids[4 * start : 4 * (start + length)], int(seen[length])))
                        seen[length] += 1
                at, start, length, total, packed, rank = (list(c) for c in zip(*rows, strict=True))
                long = lambda c: pa.array(c, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), long(start), long(length), long(total), id_lists(packed), pa.array([part] * len(at), pa.int32()), long(rank)], names=names)

    return run


def pack(df: DataFrame, definition: str, capacity: int = 2048, end: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The pieces of all documents: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    A document's ids are those of its whole text and then ``end``; a null or empty text has ``end`` alone. Pieces are cut at multiples
    of ``capacity``. Every sequence is filled without gaps from offset 0 and is padded to ``capacity``; sequences number from 0 without
    gaps. Null ids, ties and repeated rows are documents of their own; other columns are ignored; no rows give no pieces.
    The pieces are written once to the shared folder. Their rank within a length is the rank in their task, which is written with them,
    plus the count of that length in the tasks before.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(definition)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(spark, rows.mapInArrow(_pieces(shared, capacity, end), PIECE.format(kind)), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).persist()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placements, _ = shortest_pack_first(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    # one placement uses up a length or a run, and a length splits one run at most: under three placements for each length
    placed = F.broadcast(spark.createDataFrame(placements, "of long, first_rank long, n long, first_sequence long, offset long"))
    here = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    return ranked.join(placed, here).select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame, capacity: int = 2048, pad: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id and ``capacity`` ids, padded with ``pad``."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most capacity pieces of one token
    ids = F.flatten(F.transform(ordered, lambda x: x["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids")).select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), F.lit(capacity) - F.size("ids"))).alias("ids"))
