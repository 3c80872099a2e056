"""Run-length, bit packing, bit shuffling, zero elimination and Huffman coding. Logical results are plain DataFrame operations; bytes are made
block by block in numpy."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.numeric import low_bits
from terrane.operators.predictors import prefix_sum, with_before
from terrane.sources.fields import flat_values, ordered_values, to_blocks

CHUNK = 16384  # bytes of a zero-elimination chunk
PART = 768  # symbols of a Huffman partition


def _mapped(blocks: DataFrame, work: Callable[[bytes], bytes]) -> DataFrame:
    """Blocks (block, n, bytes) with every block's bytes replaced by work(bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [work(x) for x in b.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("n"), pa.array(done, pa.binary())], names=["block", "n", "bytes"])

    return blocks.select("block", "n", "bytes").mapInArrow(run, "block long, n long, bytes binary")


# run lengths


def rle(field: DataFrame, block: int = 4096) -> DataFrame:
    """run_id, v, length of the runs over the whole field. Run numbers are a prefix sum of the changes; a run may span blocks."""
    rows = with_before(field.select("idx", "v"), "v", block)
    changed = rows.select("idx", "v", (~F.col("v").eqNullSafe(F.col("before")) | (F.col("idx") == 0)).cast("long").alias("c"))
    runs = prefix_sum(changed, "c", block, ("v",))
    return runs.groupBy((F.col("s") - 1).alias("run_id")).agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("length"))


def unrle(runs: DataFrame) -> DataFrame:
    """idx, v: the first position of each run is the sum of the lengths before it."""
    ends = prefix_sum(runs.select(F.col("run_id").alias("idx"), "length", "v"), "length", keep=("v", "length"))
    rows = ends.select("v", (F.col("s") - F.col("length")).alias("low"), F.col("s").alias("end"))
    # a long run is cut at block ends and the cuts are dealt anew, so no row makes more than a block
    cuts = rows.select("v", "low", "end", F.explode(F.sequence(F.expr(f"low div {CHUNK}"), F.expr(f"(end - 1) div {CHUNK}"))).alias("c")).repartition("c")
    low, high = F.greatest("low", F.col("c") * CHUNK), F.least("end", (F.col("c") + 1) * CHUNK)
    return cuts.select(F.explode(F.sequence(low, high - 1)).alias("idx"), "v")


def rle_size(runs: DataFrame, width: int) -> DataFrame:
    """One row: n_runs and the bytes of count, values (padded to 4) and lengths."""
    n = F.count(F.lit(1))
    return runs.agg(n.alias("n_runs"), (4 + F.expr(f"((count(1) * {width} + 3) div 4) * 4") + 4 * n).alias("n_bytes"))


# bit packing


def check_nbits(nbits: int, width: int = 64) -> int:
    if nbits < 1 or nbits > width or nbits & (nbits - 1):
        raise ValueError(f"nbits must be a power of two up to {width}, not {nbits}")
    return nbits


def bitpack(field: DataFrame, nbits: int) -> DataFrame:
    """at, byte: the low ``nbits`` of each value, dense, the first value in the lowest bits; wider ones little-endian."""
    check_nbits(nbits)
    v = low_bits(F.col("v"), nbits)
    if nbits >= 8:
        k = nbits // 8
        byte = F.posexplode(F.array(*[F.shiftrightunsigned(v, 8 * b).bitwiseAND(F.lit(255).cast("long")) for b in range(k)]))
        return field.select("idx", byte.alias("b", "byte")).select((F.col("idx") * k + F.col("b")).alias("at"), "byte")
    per = 8 // nbits
    part = F.expr(f"shiftleft(v, cast((idx % {per}) * {nbits} as int))")
    return field.select("idx", v.alias("v")).groupBy(F.expr(f"idx div {per}").alias("at")).agg(F.sum(part).alias("byte"))


def bitunpack(packed: DataFrame, nbits: int, count: int) -> DataFrame:
    """idx, v with zeros above ``nbits``; ``count`` tells padding from values."""
    check_nbits(nbits)
    if nbits >= 8:
        k = nbits // 8
        part = F.expr(f"shiftleft(byte, cast((at % {k}) * 8 as int))")
        return packed.groupBy(F.expr(f"at div {k}").alias("idx")).agg(F.bit_or(part).alias("v"))
    per = 8 // nbits
    rows = packed.select("at", "byte", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("slot"))
    v = F.expr(f"shiftrightunsigned(byte, slot * {nbits}) & {(1 << nbits) - 1}")
    return rows.select((F.col("at") * per + F.col("slot")).alias("idx"), v.alias("v")).where(F.col("idx") < count)


def detect_nbits(field: DataFrame) -> DataFrame:
    """One row: max_v and the least power of two of bits that holds it (1 if all are zero)."""
    most = F.max("v")
    steps = F.lit(64)
    for n in (32, 16, 8, 4, 2, 1):
        steps = F.when(most < F.lit(1 << n), n).otherwise(steps)
    return field.agg(most.alias("max_v"), steps.cast("int").alias("nbits"))


# bit shuffling


def bitshuffle(field: DataFrame, width: int, block_bytes: int = 16384) -> DataFrame:
    """block, plane, word, value: the bit matrix of each block transposed, plane 0 holding the highest bits.

    A word takes 32 elements (64 for 8-byte values). Within a word, element e is bit e for 1- and 2-byte values, and the bit counted
    from the top for wider ones. Elements after the last whole block are not in the result; ``bitshuffle_tail`` gives them.
    """
    _check_block(width, block_bytes)
    bits, lanes, per = 8 * width, 64 if width == 8 else 32, block_bytes // width
    rows = field.select(F.expr(f"idx div {per}").alias("block"), F.expr(f"(idx % {per}) div {lanes}").alias("word"), F.expr(f"cast(idx % {lanes} as int)").alias("e"), "v")
    whole = field.agg(F.expr(f"(max(idx) + 1) div {per}").alias("blocks"))
    rows = rows.join(F.broadcast(whole), F.col("block") < F.col("blocks"))  # one row
    at = F.col("e") if width <= 2 else F.lit(bits - 1) - F.col("e")
    planes = [F.bit_or(F.expr(f"shiftleft(shiftrightunsigned(v, {bits - 1 - p}) & 1L, at)")).alias(str(p)) for p in range(bits)]
    words = rows.withColumn("at", at.cast("int")).groupBy("block", "word").agg(*planes)
    return words.select("block", "word", F.posexplode(F.array(*[F.col(str(p)) for p in range(bits)])).alias("plane", "value"))


def unbitshuffle(planes: DataFrame, width: int, block_bytes: int = 16384) -> DataFrame:
    """idx, v from (block, plane, word, value)."""
    _check_block(width, block_bytes)
    bits, lanes, per = 8 * width, 64 if width == 8 else 32, block_bytes // width
    at = "e" if width <= 2 else f"{bits - 1} - e"
    lane_bits = F.expr(f"transform(sequence(0, {lanes - 1}), e -> shiftrightunsigned(value, {at}) & 1L)")
    rows = planes.select("block", "word", "plane", F.posexplode(lane_bits).alias("e", "bit"))
    v = F.bit_or(F.expr(f"shiftleft(bit, {bits - 1} - plane)"))
    return rows.groupBy("block", "word", "e").agg(v.alias("v")).select((F.col("block") * per + F.col("word") * lanes + F.col("e")).alias("idx"), "v")


def _check_block(width: int, block_bytes: int) -> None:
    if width not in (1, 2, 4, 8) or block_bytes % (1024 * width):
        raise ValueError("a block must be a multiple of 1024 elements of 1, 2, 4 or 8 bytes")


def bitshuffle_tail(field: DataFrame, width: int, block_bytes: int = 16384) -> DataFrame:
    """idx, v of the elements after the last whole block, unchanged."""
    per = block_bytes // width
    whole = field.agg(F.expr(f"((max(idx) + 1) div {per}) * {per}").alias("first"))
    return field.join(F.broadcast(whole), F.col("idx") >= F.col("first")).select("idx", "v")  # one row


def _transposed(width: int, block_bytes: int, back: bool) -> Callable[[bytes], bytes]:
    lanes, bits = (64 if width == 8 else 32), 8 * width

    def work(data: bytes) -> bytes:
        if len(data) < block_bytes:
            return data
        x = np.frombuffer(data, f">u{width}" if not back else f"<u{lanes // 8}")
        if not back:
            m = np.unpackbits(np.frombuffer(data, f"<u{width}").astype(f">u{width}").view(np.uint8)).reshape(-1, lanes, bits).transpose(2, 0, 1)
            m = m if width > 2 else m[:, :, ::-1]
            return np.packbits(np.ascontiguousarray(m), axis=2).view(f">u{lanes // 8}").astype(f"<u{lanes // 8}").tobytes()
        m = np.unpackbits(x.astype(f">u{lanes // 8}").view(np.uint8)).reshape(bits, -1, lanes)
        m = m if width > 2 else m[:, :, ::-1]
        return np.packbits(np.ascontiguousarray(m.transpose(1, 2, 0)).reshape(-1, bits), axis=1).view(f">u{width}").astype(f"<u{width}").tobytes()

    return work


def bitshuffle_blocks(blocks: DataFrame, width: int, block_bytes: int = 16384) -> DataFrame:
    """Binary blocks with their bit planes one after the other; a short last block stays as it is."""
    _check_block(width, block_bytes)
    return _mapped(blocks, _transposed(width, block_bytes, False))


def unbitshuffle_blocks(blocks: DataFrame, width: int, block_bytes: int = 16384) -> DataFrame:
    _check_block(width, block_bytes)
    return _mapped(blocks, _transposed(width, block_bytes, True))


# zero elimination


def _levels(data: np.ndarray) -> tuple[bytes, list[np.ndarray], np.ndarray]:
    """Non-zero bytes, and for each repeat-elimination level the kept bytes; the last bitmap stays whole."""
    full = np.zeros(CHUNK, np.uint8)
    full[: len(data)] = data
    keep = full != 0
    bitmap = np.packbits(keep, bitorder="little")
    kept = []
    for _ in range(3):
        keep_map = np.diff(bitmap, prepend=np.uint8(0)) != 0
        kept.append(bitmap[keep_map])
        bitmap = np.packbits(keep_map, bitorder="little")
    return full[keep].tobytes(), kept, bitmap


def encode_chunk(data: bytes) -> bytes:
    """[flag][non-zero bytes][kept bytes of bitmaps 1 to 3][bitmap 4][u16 counts]; flag 1: the chunk as it is; an all-zero chunk is empty."""
    x = np.frombuffer(data, np.uint8)
    values, kept, last = _levels(x)
    if not values:
        return b""
    body = values + b"".join(k.tobytes() for k in kept) + last.tobytes()
    head = np.array([len(values), *(len(k) for k in kept)], "<u2").tobytes()
    return b"\1" + data if len(body) + len(head) >= len(data) else b"\0" + head + body


def decode_chunk(data: bytes, size: int) -> bytes:
    if not data:
        return bytes(size)
    if data[0] == 1:
        return data[1:]
    counts = np.frombuffer(data[1:9], "<u2").astype(int)
    x = np.frombuffer(data[9:], np.uint8)
    ends = np.cumsum(counts)
    parts = np.split(x, ends)
    bitmap = parts[4]
    for kept, width in zip(parts[3:0:-1], (32, 256, 2048), strict=True):
        mask = np.unpackbits(bitmap, bitorder="little")[:width].astype(bool)
        at = np.cumsum(mask)
        bitmap = np.where(at > 0, np.concatenate(([0], kept))[at], 0).astype(np.uint8)
    out = np.zeros(CHUNK, np.uint8)
    out[np.unpackbits(bitmap, bitorder="little").astype(bool)] = parts[0]
    return out[:size].tobytes()


def eliminate_zeros(blocks: DataFrame) -> DataFrame:
    """Blocks of up to 16384 bytes, each coded on its own; n becomes the block's size in bytes."""
    return _mapped(blocks.withColumn("n", F.length("bytes").cast("long")), encode_chunk)


def restore_zeros(coded: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [decode_chunk(x, n) for x, n in zip(b.column("bytes").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("n"), pa.array(done, pa.binary())], names=["block", "n", "bytes"])

    return coded.select("block", "n", "bytes").mapInArrow(run, "block long, n long, bytes binary")


SIZES = "chunk long, n_nonzero long, kept1 long, kept2 long, kept3 long, size long"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for chunk, data in zip(b.column("block").to_pylist(), b.column("bytes").to_pylist(), strict=True):
            values, kept, last = _levels(np.frombuffer(data, np.uint8))
            counts = [len(values), *map(len, kept)]
            body = sum(counts) + len(last) + 2
            rows.append((chunk, *counts, 2 if not values else len(data) if body >= CHUNK - 2 else body))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, names=["chunk", "n_nonzero", "kept1", "kept2", "kept3", "size"])


def chunk_sizes(data: DataFrame) -> DataFrame:
    """chunk, n_nonzero, kept1, kept2, kept3 and size of each 16384-byte chunk of (idx, v) bytes.

    Size is 2 for an all-zero chunk; else the parts, 4 bytes of the last bitmap and 2 of the size itself, or the chunk as it is when
    that is no shorter.
    """
    return to_blocks(data, "<u1", CHUNK).mapInArrow(_sizes, SIZES)


def stream_offsets(sizes: DataFrame) -> DataFrame:
    """chunk, size, byte_offset: where each chunk starts behind the stream's head, by a prefix sum, and the padded total."""
    ends = prefix_sum(sizes.select(F.col("chunk").alias("idx"), "size"), "size", keep=("size",))
    head = ends.agg((8 + 4 * F.count(F.lit(1))).alias("head"), F.max("s").alias("body"))
    rows = ends.crossJoin(F.broadcast(head))  # one row
    return rows.select(F.col("idx").alias("chunk"), "size", (F.col("head") + F.col("s") - F.col("size")).alias("byte_offset"), F.expr("((head + body + 3) div 4) * 4").alias("total_bytes"))


# Huffman


def histogram(field: DataFrame, n_symbols: int) -> DataFrame:
    """symbol, freq of the values in [0, n_symbols); others are left out."""
    return field.where((F.col("v") >= 0) & (F.col("v") < n_symbols)).groupBy(F.col("v").cast("long").alias("symbol")).agg(F.count(F.lit(1)).alias("freq"))


def out_of_range(field: DataFrame, n_symbols: int) -> DataFrame:
    """One row: how many values no symbol stands for."""
    return field.agg(F.count_if((F.col("v") < 0) | (F.col("v") >= n_symbols)).alias("n_out_of_range"))


def code_lengths(freq: dict[int, int]) -> dict[int, int]:
    """Lengths of an optimal prefix code; ties by the least symbol. A single symbol takes one bit."""
    if len(freq) == 1:
        return dict.fromkeys(freq, 1)
    heap = [(n, s, (s,)) for s, n in sorted(freq.items())]
    heapq.heapify(heap)
    length = dict.fromkeys(freq, 0)
    while len(heap) > 1:
        n, s, a = heapq.heappop(heap)
        m, t, b = heapq.heappop(heap)
        for x in a + b:
            length[x] += 1
        heapq.heappush(heap, (n + m, min(s, t), a + b))
    return length


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol: (length, code), in order of length, then symbol."""
    code, last, book = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        book[symbol] = (n, code)
        code, last = code + 1, n
    return book


def codebook(field: DataFrame, n_symbols: int) -> dict[int, tuple[int, int]]:
    """The canonical code of the field's symbols. At most ``n_symbols`` counts reach the driver. A value out of range is an error."""
    if n_symbols > 1 << 20:
        raise ValueError("more than 2^20 symbols")
    inside = (F.col("v") >= 0) & (F.col("v") < n_symbols)
    counts = {r[0]: r[1] for r in field.groupBy(F.when(inside, F.col("v").cast("long")).alias("symbol")).agg(F.count(F.lit(1))).collect()}
    if bad := counts.pop(None, 0):
        raise ValueError(f"{bad} values are outside [0, {n_symbols})")
    return canonical(code_lengths(counts)) if counts else {}


def _encode_part(symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    n = lengths[symbols]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    bits = (np.repeat(codes[symbols], n) >> (np.repeat(n, n) - 1 - at).astype(np.uint64)) & np.uint64(1)
    raw = np.packbits(bits.astype(np.uint8)).tobytes()
    return raw + bytes(-len(raw) % 4)


def huffman(field: DataFrame, book: dict[int, tuple[int, int]]) -> DataFrame:
    """block, n, bytes: the bit stream of every 768 symbols, padded to 32-bit cells."""
    top = max(book, default=0) + 1
    lengths, codes = np.zeros(top, np.int64), np.zeros(top, np.uint64)
    for s, (n, c) in book.items():
        lengths[s], codes[s] = n, c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, at = flat_values(b.column("values"))
            parts = [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(np.diff(at).astype(np.int64)), pa.array([_encode_part(p, lengths, codes) for p in parts], pa.binary())], names=["block", "n", "bytes"])

    return ordered_values(field.select("idx", F.col("v").cast("long").alias("v")), PART).mapInArrow(run, "block long, n long, bytes binary")


def _decode_parts(data: list[bytes], n: np.ndarray, symbols: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbols of all parts, the k-th of each in one step: the next 56 bits of a part lie between the starts of two codes."""
    sizes = np.array([len(x) for x in data], np.int64)
    raw = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    place = (np.cumsum(sizes) - sizes) * 8
    out = np.zeros((len(data), int(n.max(initial=0))), np.int64)
    for k in range(out.shape[1]):
        here = np.flatnonzero(k < n)
        at = place[here]
        word = raw[(at >> 3)[:, None] + np.arange(8)].copy().view(">u8").ravel().astype(np.uint64)
        found = np.searchsorted(starts, (word << (at & 7).astype(np.uint64)) >> np.uint64(8), side="right") - 1
        out[here, k] = symbols[found]
        place[here] += lengths[found]
    return out[np.arange(out.shape[1])[None, :] < n[:, None]]


def unhuffman(coded: DataFrame, book: dict[int, tuple[int, int]]) -> DataFrame:
    """idx, v. Codes of up to 56 bits can be decoded, which takes fields of 10^11 elements to exceed."""
    rows = sorted((c << (56 - n), s, n) for s, (n, c) in book.items() if n <= 56)
    if len(rows) < len(book):
        raise ValueError("a code has more than 56 bits")
    starts, symbols, lengths = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.uint64, np.int64, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                n = b.column("n").to_numpy()
                values = _decode_parts(b.column("bytes").to_pylist(), n, symbols, lengths, starts)
                first = np.repeat(b.column("block").to_numpy() * PART, n)
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)), pa.array(values)], names=["idx", "v"])

    return coded.select("block", "n", "bytes").mapInArrow(run, "idx long, v long")
