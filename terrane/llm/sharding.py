"""Sharding by histogram sort (operator 1), in DataFrame operations only.

Rows are ordered by (63-bit hash of the text, 63-bit hash of the id), so equal texts stand together. Each round counts the exact
bytes and rows that lie below candidate key boundaries, by one aggregation over a narrow key table, and narrows the interval of every
splitter to the cell that holds its target. When all splitters meet their tolerance, rows go through one exchange.

A splitter is first sought among text hashes alone, so that a group of equal texts stays in one shard; it goes on to the id hash
inside one group only when that group is larger than the tolerance. Rows equal in text and id cannot be told apart and stay together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP = 1 << 63

#: Counts of parts of pieces, up to this many (some 100 bytes each), are broadcast; beyond it the join is shuffled.
BROADCAST_PARTS = 500_000


@dataclass
class Splitter:
    """The key (h, d) that splits off ``target`` bytes. ``lo`` to ``hi`` is the interval that is left, of h or, inside one h, of d."""

    target: int
    tolerance: int
    inside: int | None = None
    lo: int = 0
    hi: int = TOP
    below: tuple[int, int] = (0, 0)  # bytes, rows below lo
    key: tuple[int, int] | None = None
    at: tuple[int, int] = (0, 0)  # bytes, rows below key

    def settle(self, point: int, below: tuple[int, int]) -> None:
        self.key = (point, 0) if self.inside is None else (self.inside, point)
        self.at = below


def _tree(values: list, leaf, less, lo: int = 0, hi: int | None = None) -> Column:
    """A balanced tree of comparisons: leaf(i), i being the number of values that are not above the row."""
    hi = len(values) if hi is None else hi
    if lo == hi:
        return leaf(lo)
    mid = (lo + hi) // 2
    return F.when(less(values[mid]), _tree(values, leaf, less, lo, mid)).otherwise(_tree(values, leaf, less, mid + 1, hi))


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def _round(keys: DataFrame, active: list[Splitter], probes: int) -> None:
    """One counting pass. Narrows or settles every active splitter."""
    spans = sorted({(s.inside is not None, s.inside or 0, s.lo, s.hi) for s in active})
    each = max(16, probes // len(spans))
    flat = [x for x in spans if not x[0]]
    h, d = F.col("h"), F.col("d")
    nothing = F.lit(None).cast("struct<i:int,j:long>")

    def cell(i: int, col: Column) -> Column:
        _, _, lo, hi = spans[i]
        step = math.ceil((hi - lo) / each)
        j = F.expr(f"({'d' if spans[i][0] else 'h'} - {lo}L) div {step}L")
        here = F.struct(F.lit(i).alias("i"), j.alias("j"))
        return here if hi == TOP else F.when(col < _lit(hi), here).otherwise(nothing)

    found = _tree([x[2] for x in flat], lambda i: nothing if not i else cell(i - 1, h), lambda v: h < _lit(v))
    for i in range(len(flat), len(spans)):
        inside, lo = spans[i][1], spans[i][2]
        found = F.when((h == _lit(inside)) & (d >= _lit(lo)), cell(i, d)).otherwise(found)
    counts: dict[int, dict[int, tuple[int, int]]] = {}
    for r in keys.select(found.alias("c"), "size").where("c is not null").groupBy("c").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect():
        counts.setdefault(r["c"]["i"], {})[r["c"]["j"]] = (r["bytes"], r["rows"])
    for s in active:
        i = spans.index((s.inside is not None, s.inside or 0, s.lo, s.hi))
        step, cells, (b, n) = math.ceil((s.hi - s.lo) / each), counts.get(i, {}), s.below
        last = max(cells, default=0)
        for j in sorted(cells):
            db, dn = cells[j]
            if b + db > s.target or j == last:
                left, right = s.lo + j * step, min(s.hi, s.lo + (j + 1) * step)
                if abs(b - s.target) <= s.tolerance:
                    s.settle(left, (b, n))
                elif abs(b + db - s.target) <= s.tolerance:
                    s.settle(right, (b + db, n + dn))
                elif dn > 1 and right - left > 1:
                    s.lo, s.hi, s.below = left, right, (b, n)
                elif dn > 1 and s.inside is None:
                    s.inside, s.lo, s.hi, s.below = left, 0, TOP, (b, n)
                else:
                    s.settle(*((left, (b, n)) if s.target - b <= b + db - s.target else (right, (b + db, n + dn))))
                break
            b, n = b + db, n + dn
        else:
            s.settle(s.lo, s.below)


def splitters(keys: DataFrame, wanted: list[tuple[int, int]], probes: int = 8192, rounds: int = 40) -> list[Splitter]:
    """Exact splitters of ``keys`` (h, d, size) for ``wanted`` (target bytes, tolerance). At most ``probes`` counts reach the driver in a round."""
    found = [Splitter(*w) for w in wanted]
    for _ in range(rounds):
        active = [s for s in found if s.key is None]
        if not active:
            break
        _round(keys, active, probes)
    return found


def shard(df: DataFrame, n_shards: int = 8, text_col: str = "text", id_col: str = "doc_id", tolerance: float = 0.001, piece_bytes: int = 32 << 20, max_pieces: int = 512) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1, byte sizes equal within ``tolerance`` of a shard) and ``slot`` (gapless from 0 in it).

    The size of a row is the UTF-8 length of its text plus 1; a null text has no bytes and an empty one neither, both get size 1.
    Null ids are a key like any other. Ties and repeated rows share a key and stay together. An empty table gives an empty result.
    Columns of the input named ``shard`` or ``slot`` are replaced. A shard is exchanged and sorted in pieces of about ``piece_bytes``, so
    no task holds a whole shard: up to ``max_pieces`` between counted boundaries; where more are needed, each of these is cut in even
    parts of its range of hashes, which hold as much each, as a text that is large by itself has pieces of its own.
    """
    rest = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    h, d = F.shiftrightunsigned(F.xxhash64(text_col), 1), F.shiftrightunsigned(F.xxhash64(id_col), 1)
    keys = df.select(h.alias("h"), d.alias("d"), size.alias("size")).persist(StorageLevel.MEMORY_AND_DISK)
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("t")).first()["t"]
    needed = max(1, math.ceil(total / n_shards / piece_bytes))
    part = min(max(1, max_pieces // n_shards), needed)
    parts = math.ceil(needed / part)  # of a piece
    wanted = []
    for k in range(1, n_shards * part):
        slack = total / n_shards * tolerance if k % part == 0 else total / n_shards / part / 20
        wanted.append((round(total * k / (n_shards * part)), int(slack)))
    cuts = splitters(keys, wanted) if total else []
    ends = [(s.key, s.at) for s in cuts]
    outer = [((0, 0), (0, 0)), *ends[part - 1 :: part], ((TOP, 0), (total, 0))]
    for k, end in enumerate(ends):  # a looser inner boundary must not pass its neighbours
        if (k + 1) % part:
            ends[k] = min(max(end, ends[k - 1] if k else end, outer[k // part]), outer[k // part + 1])
    starts, shard_start = [0], 0
    for k, (_, at) in enumerate(ends, 1):
        if k % part == 0:
            shard_start = at[1]
        starts.append(at[1] - shard_start)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), h.alias("h"), d.alias("d"))

    def less(key: tuple[int, int]) -> Column:
        at, inside = key
        if at >= TOP or (at == TOP - 1 and inside >= TOP):
            return F.lit(True)
        if inside >= TOP:
            return F.col("h") <= _lit(at)
        first = F.col("h") < _lit(at)
        return first if inside == 0 else first | ((F.col("h") == _lit(at)) & (F.col("d") < _lit(inside)))

    piece = _tree([k for k, _ in ends], F.lit, less)
    rows = rows.withColumn("piece", piece)
    base = F.element_at(F.array(*[_lit(x) for x in starts]), F.col("piece") + 1)
    place = [F.col("piece")]
    if parts > 1:
        spans = []
        for (low, first), (high, last) in zip([(0, 0), *(k for k, _ in ends)], [*(k for k, _ in ends), (TOP, 0)], strict=True):
            inside = low == high
            spans.append((inside, first if inside else low, max(1, (last - first if inside else high + 1 - low))))
        of = lambda i, kind: F.element_at(F.array(*[F.lit(x[i]).cast(kind) for x in spans]), F.col("piece") + 1)
        at = (F.when(of(0, "boolean"), F.col("d")).otherwise(F.col("h")) - of(1, "decimal(20,0)")) / of(2, "double")
        cell = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(at.cast("double") * parts))).cast("int")
        earlier = Window.partitionBy("piece").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = keys.withColumn("piece", piece).select("piece", cell.alias("cell")).groupBy("piece", "cell").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.select("piece", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        rows = rows.withColumn("cell", cell)
        rows = rows.join(F.broadcast(counts) if (len(ends) + 1) * parts <= BROADCAST_PARTS else counts, ["piece", "cell"])
        base, place = base + F.col("before"), [F.col("piece"), F.col("cell")]
    else:
        keys.unpersist()
    order = F.row_number().over(Window.partitionBy(*place).orderBy("h", "d")).cast("long") - 1
    return rows.select("row", (F.col("piece") / part).cast("int").alias("shard"), (base + order).alias("slot")).select("row.*", "shard", "slot")


def shard_sizes(sharded: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows and bytes of each shard."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes"))
