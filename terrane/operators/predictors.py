"""Predictors: fused predict-and-quantize in 1 to 3 dimensions, lossless prediction, differences; and their inverses.

Blocks restart by definition of the format, so every window has the block as its key. Only the unchunked difference runs through the
whole field; its inverse is a prefix sum in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.numeric import half_away, mask, negabinary, signed, unnegabinary, unzigzag, zigzag
from terrane.operators.quantizer import with_bound

LINE = 1024  # elements of a fused 1-D block
LOSSLESS = 256  # elements of a lossless 1-D block
TILES = {2: 32, 3: 8}  # edge of a fused tile
EDGE = {2: 128, 3: 32}  # edge of the tiles that a lossless prediction over the whole field is dealt in; results don't depend on it

AXES = ("x", "y", "z")


def _div(c: str, n: int) -> Column:
    return F.expr(f"{c} div {n}")


def _keys(dims: int, tile: int | None) -> dict[str, Column]:
    """What makes a tile, by axis; nothing if the whole field is one."""
    return {f"t{a}": _div(a, tile) for a in AXES[:dims]} if tile else {}


def _along(rows: DataFrame, dims: int, tile: int | None, value: str, step) -> DataFrame:
    """Applies ``step(column, window)`` along x, then y, then z, within a tile."""
    keys = _keys(dims, tile)
    rows = rows.withColumns(keys)
    for axis in AXES[:dims]:
        across = [a for a in AXES[:dims] if a != axis]
        rows = rows.withColumn(value, step(F.col(value), Window.partitionBy(*keys, *across).orderBy(axis)))
    return rows.drop(*keys)


def _step_back(c: Column, w) -> Column:
    return c - F.coalesce(F.lag(c).over(w), F.lit(0))


def _running(c: Column, w) -> Column:
    return F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def lorenzo_quantize(field: DataFrame, dims: int = 1, mode: str = "abs", eb: float = 1e-4, radius: int = 32768, use_zigzag: bool = False, code_bits: int = 16, base: float | None = None) -> DataFrame:
    """The field with p (value / (2 eb), halves away from zero), delta (p less its neighbours in the block), is_outlier and code.

    In 2 and 3 dimensions the field has x, y (and z), and blocks are tiles of 32 and 8; delta is the inclusion-exclusion over the
    neighbours, as differences along each axis in turn. An outlier keeps its delta, and the next element still sees the true p.
    """
    rows = with_bound(field, mode, eb, base)
    rows = rows.withColumn("p", half_away(F.col("v") * (F.lit(1.0) / (F.lit(2.0) * F.col("eb")))).cast("long")).withColumn("delta", F.col("p"))
    if dims == 1:
        rows = rows.withColumn("delta", _step_back(F.col("p"), Window.partitionBy(_div("idx", LINE)).orderBy("idx")))
    else:
        rows = _along(rows, dims, TILES[dims], "delta", _step_back)
    out = F.abs("delta") >= radius
    code = zigzag(F.col("delta"), code_bits) if use_zigzag else mask(F.col("delta"), code_bits)
    return rows.withColumn("is_outlier", out).withColumn("code", F.when(out, F.lit(0)).otherwise(code).cast("long"))


def lorenzo_reconstruct(codes: DataFrame, kept: DataFrame, dims: int, eb: Column | float, use_zigzag: bool = False, code_bits: int = 16) -> DataFrame:
    """idx, p, v from codes (with idx, code, and x, y, z in more dimensions) and outliers (idx, delta)."""
    delta = unzigzag(F.col("code")) if use_zigzag else signed(F.col("code"), code_bits)
    rows = codes.join(kept.select("idx", F.col("delta").alias("o")), "idx", "left").withColumn("p", F.coalesce("o", delta))
    if dims == 1:
        rows = rows.withColumn("p", _running(F.col("p"), Window.partitionBy(_div("idx", LINE)).orderBy("idx")))
    else:
        rows = _along(rows, dims, TILES[dims], "p", _running)
    bound = eb if isinstance(eb, Column) else F.lit(float(eb))
    return rows.withColumn("v", F.col("p").cast("double") * 2 * bound).drop("o", "code")


def _with_halo(rows: DataFrame, dims: int, edge: int) -> DataFrame:
    """Rows by tile (keys tx, ty, tz), each tile with copies (``own`` false) of the elements just before it on every axis. One pass, one exchange."""
    tiles = F.array(F.struct(*[_div(a, edge).alias(f"t{a}") for a in AXES[:dims]], F.lit(True).alias("own")))

    def after(axis: str):
        return lambda t: t.withField(f"t{axis}", t[f"t{axis}"] + 1).withField("own", F.lit(False))

    for axis in AXES[:dims]:
        beyond = F.transform(tiles, after(axis))
        tiles = F.concat(tiles, F.when(F.col(axis) % edge == edge - 1, beyond).otherwise(F.slice(beyond, 1, 0)))
    return rows.withColumn("t", F.explode(tiles)).select(*rows.columns, "t.*").repartition(*[f"t{a}" for a in AXES[:dims]])


def _summed(rows: DataFrame, dims: int, axis: str, value: str, edge: int) -> DataFrame:
    """The running sum of ``value`` along ``axis`` over the whole field: within tiles, then over the tiles' sums, one for ``edge`` elements.

    The sums are taken from the running sums, so both read one exchange and the rows are computed once.
    """
    keys, across = [f"t{a}" for a in AXES[:dims]], [a for a in AXES[:dims] if a != axis]
    dealt = rows.withColumns({f"t{a}": _div(a, edge) for a in AXES[:dims]}).repartition(*keys)
    inside = dealt.withColumn("inner", _running(F.col(value), Window.partitionBy(*keys, *across).orderBy(axis)))
    sums = inside.groupBy(*keys, *across).agg(F.max_by("inner", axis).alias("s"))
    before = Window.partitionBy(*[k for k in keys if k != f"t{axis}"], *across).orderBy(f"t{axis}").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, *across, F.sum("s").over(before).alias("offset"))
    return inside.join(offsets, [*keys, *across]).withColumn(value, F.col("inner") + F.coalesce("offset", F.lit(0))).drop("inner", "offset", *keys)


def lorenzo(field: DataFrame, dims: int = 1, bits: int = 32) -> DataFrame:
    """Lossless prediction of integers, wrapping at the width: blocks of 256 in one dimension, the whole field in two or three.

    There each axis in turn takes the difference to the element before, in tiles that have copies of the elements before them.
    """
    if dims == 1:
        out = field.withColumn("delta", _step_back(F.col("v"), Window.partitionBy(_div("idx", LOSSLESS)).orderBy("idx")))
    else:
        keys = [f"t{a}" for a in AXES[:dims]]
        out = _with_halo(field.withColumn("delta", F.col("v").cast("long")), dims, EDGE[dims])
        for axis in AXES[:dims]:
            out = out.withColumn("delta", _step_back(F.col("delta"), Window.partitionBy(*keys, *[a for a in AXES[:dims] if a != axis]).orderBy(axis)))
        out = out.where("own").drop("own", *keys)
    return out.withColumn("delta", signed(F.col("delta").cast("long"), bits))


def unlorenzo(deltas: DataFrame, dims: int = 1, bits: int = 32) -> DataFrame:
    """v from deltas; in two and three dimensions running sums along each axis, in two levels."""
    if dims == 1:
        out = deltas.withColumn("v", _running(F.col("delta"), Window.partitionBy(_div("idx", LOSSLESS)).orderBy("idx")))
    else:
        out = deltas.withColumn("v", F.col("delta"))
        for axis in AXES[:dims]:
            out = _summed(out, dims, axis, "v", EDGE[dims])
    return out.withColumn("v", signed(F.col("v").cast("long"), bits))


def with_before(rows: DataFrame, value: str, block: int) -> DataFrame:
    """The rows with ``before``, the ``value`` at the position before, null at the first.

    Blocks get a copy of the last element of the block before, so no window spans the field and the rows are computed once.
    """
    here = _div("idx", block)
    blocks = F.when(F.col("idx") % block == block - 1, F.array(here, here + 1)).otherwise(F.array(here))
    dealt = rows.withColumn("b", F.explode(blocks)).withColumn("before", F.lag(value).over(Window.partitionBy("b").orderBy("idx")))
    return dealt.where(F.col("b") == here).drop("b")


def difference(field: DataFrame, chunk: int = 0, bits: int | None = 64, to_negabinary: bool = False, block: int = 4096) -> DataFrame:
    """idx, d: each value less the one before, restarting every ``chunk`` elements (0: never). ``bits`` None is for floats."""
    rows = field.select("idx", "v")
    if chunk:
        rows = rows.withColumn("before", F.lag("v").over(Window.partitionBy(_div("idx", chunk)).orderBy("idx")))
    else:
        rows = with_before(rows, "v", block)
    d = F.col("v") - F.coalesce("before", F.lit(0))
    if bits is not None:
        d = signed(d.cast("long"), bits)
    return rows.select("idx", (negabinary(d, bits) if to_negabinary else d).alias("d"))


def prefix_sum(rows: DataFrame, value: str, block: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """idx, the inclusive running sum s over the whole field, and the columns ``keep``.

    Three levels: within blocks, over the blocks of a block of blocks, and over these, of which there is one for every ``block`` squared
    positions: only there a window has no key. Each level's sums are taken from its running sums, so both read one exchange.
    """
    dealt = rows.select("idx", F.col(value).alias("s"), *keep).withColumn("b", _div("idx", block))
    inner = dealt.withColumn("s", _running(F.col("s"), Window.partitionBy("b").orderBy("idx")))
    sums = inner.groupBy("b").agg(F.max_by("s", "idx").alias("sum")).withColumn("t", _div("b", block))
    own = sums.withColumn("upto", _running(F.col("sum"), Window.partitionBy("t").orderBy("b")))
    tops = own.groupBy("t").agg(F.max_by("upto", "b").alias("top"))
    tops = tops.select("t", F.sum("top").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    offsets = own.join(tops, "t").select("b", (F.col("upto") - F.col("sum") + F.coalesce("before", F.lit(0))).alias("offset"))
    return inner.join(offsets, "b").select("idx", (F.col("s") + F.col("offset")).alias("s"), *keep)


def undifference(rows: DataFrame, chunk: int = 0, bits: int | None = 64, from_negabinary: bool = False) -> DataFrame:
    """idx, v from differences d."""
    d = unnegabinary(F.col("d"), bits) if from_negabinary else F.col("d")
    rows = rows.select("idx", d.alias("d"))
    if chunk:
        out = rows.select("idx", _running(F.col("d"), Window.partitionBy(_div("idx", chunk)).orderBy("idx")).alias("v"))
    else:
        out = prefix_sum(rows, "d").withColumnRenamed("s", "v")
    return out if bits is None else out.withColumn("v", signed(F.col("v").cast("long"), bits))
