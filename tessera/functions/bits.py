"""Bit sets in longs, and permutations of arrays, as native column expressions. Bit 0 is the lowest; sets have up to 63 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bit(k: Column | int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(k) if isinstance(k, int) else k).cast("int"))


def span(lo: Column | int, hi: Column | int) -> Column:
    """The bits from lo up to but without hi."""
    return _bit(hi) - _bit(lo)


def put(x: Column, bits: Column) -> Column:
    return x.bitwiseOR(bits)


def clear(x: Column, bits: Column) -> Column:
    return x.bitwiseAND(F.bitwise_not(bits))


def flip(x: Column, bits: Column) -> Column:
    return x.bitwiseXOR(bits)


def has(x: Column, k: Column | int) -> Column:
    return x.bitwiseAND(_bit(k)) != 0


def count(x: Column) -> Column:
    return F.bit_count(x)


def every(x: Column, size: int) -> Column:
    return x == span(0, size)


def first(x: Column) -> Column:
    """The lowest bit that is set; null for the empty set."""
    low = x.bitwiseAND(-x)
    return F.when(x != 0, F.bit_count(low - 1))


def following(x: Column, k: Column | int) -> Column:
    """The lowest bit above k that is set; null where there is none."""
    return first(clear(x, _bit(k) + (_bit(k) - 1)))


def permuted(values: Column, order: Column) -> Column:
    """Place i has what stood at order[i]."""
    return F.transform(order, lambda i: F.element_at(values, i + 1))


def unpermuted(values: Column, order: Column) -> Column:
    """Place order[i] has what stood at i."""
    return F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda i: F.element_at(values, F.array_position(order, i).cast("int")))
