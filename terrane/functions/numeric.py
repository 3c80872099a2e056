"""Integer and float expressions that wrap at a width, as columns. 64-bit intermediate values; no Python on the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def long(x: int) -> Column:
    """A 64-bit literal, of any bit pattern."""
    x &= (1 << 64) - 1
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def mask(c: Column, bits: int) -> Column:
    return c if bits >= 64 else c.bitwiseAND(long((1 << bits) - 1))


def signed(c: Column, bits: int) -> Column:
    """The low ``bits`` of a long as a signed number."""
    return c if bits >= 64 else F.shiftright(F.shiftleft(c, 64 - bits), 64 - bits)


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64, in halves, so that ANSI overflow checks never trigger."""
    low = a.bitwiseAND(long(0xFFFFFFFF)) + b.bitwiseAND(long(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(long(0xFFFFFFFF)))


def zigzag(c: Column, bits: int = 64) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    c = c.cast("long")
    return mask(F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63)), bits)


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-(c.bitwiseAND(long(1))))


def negabinary(c: Column, bits: int = 32) -> Column:
    """Base -2: (n + M) ^ M with M = ...1010 of the width."""
    m = long(0xAAAAAAAAAAAAAAAA & ((1 << bits) - 1))
    total = wrapping_add(c.cast("long"), m) if bits == 64 else c.cast("long") + m
    return mask(total, bits).bitwiseXOR(m)


def unnegabinary(c: Column, bits: int = 32) -> Column:
    m = 0xAAAAAAAAAAAAAAAA & ((1 << bits) - 1)
    back = c.bitwiseXOR(long(m))
    return wrapping_add(back, long(-m)) if bits == 64 else signed(back - long(m), bits)


def low_bits(c: Column, nbits: int) -> Column:
    return mask(c.cast("long"), nbits)


def as_float(x: float) -> float:
    """A number as single precision holds it."""
    return float(np.float32(x))


def float_lit(x: float) -> Column:
    return F.lit(as_float(x)).cast("float")


def half_away(c: Column) -> Column:
    """Rounds to the nearest integer, halves away from zero."""
    return F.round(c.cast("double"), 0)


def half_even(c: Column) -> Column:
    return F.rint(c.cast("double"))
