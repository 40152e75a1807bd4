"""Variable-length integers: with a unary length prefix, and the two forms whose first byte tells small values from lengths."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most that one to five bytes hold in the 32-bit form.
VARINT32_TOP = (244, 2291, 67827, 16777215, 4294967295)


def write_varint(v: int) -> bytes:
    """One to nine bytes: the number of leading one bits of the first byte is the number of bytes that follow."""
    if not 0 <= v < 1 << 64:
        raise ValueError("outside 64 bits")
    more = next((k for k in range(8) if v < 1 << 7 * (k + 1)), 8)
    if more == 8:
        return b"\xff" + v.to_bytes(8, "big")
    lead = 0xFF << (8 - more) & 0xFF
    return (lead << 8 * more | v).to_bytes(more + 1, "big")


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, position after it)."""
    more = 8 - (data[at] ^ 0xFF).bit_length()
    whole = int.from_bytes(data[at : at + more + 1], "big")
    return (whole & ((1 << 64) - 1) if more == 8 else whole & ((1 << 7 * (more + 1)) - 1)), at + more + 1


def varint_length(v: Column) -> Column:
    """Bytes of a non-negative long in the unary-prefix form."""
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(v < F.lit(1 << 7 * k), F.lit(k)).otherwise(out)
    return out


def varint32_length(v: Column) -> Column:
    """Bytes of an unsigned 32-bit value in the 32-bit form."""
    out = F.lit(5)
    for k in range(4, 0, -1):
        out = F.when(v <= F.lit(VARINT32_TOP[k - 1]), F.lit(k)).otherwise(out)
    return out


def _small(v: int, one: int, two: int) -> bytes | None:
    """One byte up to `one`, two bytes with a first byte up to `two`, three bytes for the 65,536 values beyond."""
    if v <= one:
        return bytes([v])
    top = (two - one) * 256 + one
    if v < top:
        return bytes([(v - one) // 256 + one + 1, (v - one) % 256])
    if v < top + 65536:
        return bytes([two + 1, *divmod(v - top, 256)])
    return None


def _unsmall(data: bytes, at: int, one: int, two: int) -> tuple[int, int]:
    first = data[at]
    if first <= one:
        return first, at + 1
    if first <= two:
        return one + 256 * (first - one - 1) + data[at + 1], at + 2
    return (two - one) * 256 + one + 256 * data[at + 1] + data[at + 2], at + 3


def write_varint64(v: int) -> bytes:
    """One to nine bytes, little-endian beyond three."""
    if not 0 <= v < 1 << 64:
        raise ValueError("outside 64 bits")
    small = _small(v, 240, 248)
    if small is not None:
        return small
    n = -(-v.bit_length() // 8)
    return bytes([247 + n]) + v.to_bytes(n, "little")


def read_varint64(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, position after it)."""
    if data[at] <= 249:
        return _unsmall(data, at, 240, 248)
    n = data[at] - 247
    return int.from_bytes(data[at + 1 : at + 1 + n], "little"), at + 1 + n


def write_varint32(v: int) -> bytes:
    """One to five bytes, little-endian beyond three."""
    if not 0 <= v <= VARINT32_TOP[-1]:
        raise ValueError("outside 32 bits")
    small = _small(v, 244, 252)
    if small is not None and v <= VARINT32_TOP[2]:
        return small
    n = 3 if v <= VARINT32_TOP[3] else 4
    return bytes([251 + n]) + v.to_bytes(n, "little")


def read_varint32(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, position after it)."""
    if data[at] <= 253:
        return _unsmall(data, at, 244, 252)
    n = data[at] - 251
    return int.from_bytes(data[at + 1 : at + 1 + n], "little"), at + 1 + n


FORMS = {"unary": (write_varint, read_varint), "64": (write_varint64, read_varint64), "32": (write_varint32, read_varint32)}


def varints(values: Column, form: str = "64") -> Column:
    """The bytes of an array of non-negative longs, or of decimals without fraction below 2^64."""
    write = FORMS[form][0]

    def coded(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else b"".join(map(write, map(int, x))) for x in lists.to_pylist()], pa.binary())

    coded.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(coded, "binary")(values)


def unvarints(data: Column, form: str = "64", kind: str = "long") -> Column:
    """The array of longs that the bytes hold; a `decimal(20,0)` also holds values from 2^63 to 2^64."""
    read = FORMS[form][1]
    own = {"long": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}[kind]

    def values(whole: bytes) -> list[int]:
        out, at = [], 0
        while at < len(whole):
            v, at = read(whole, at)
            out.append(v)
        return out

    def decoded(blobs: pa.Array) -> pa.Array:
        return pa.array([None if x is None else values(x) for x in blobs.to_pylist()], pa.list_(own))

    decoded.__annotations__ = {"blobs": pa.Array, "return": pa.Array}
    return F.arrow_udf(decoded, f"array<{kind}>")(data)


#: As a decimal, since a literal of a long doesn't hold it.
WORD = Decimal(1 << 64)


def words(v: Column) -> Column:
    """A non-negative `decimal(38,0)` as its 64-bit words, the low one first: one below 2^64, two beyond; null for null. No form
    has bytes for a single value beyond 64 bits."""
    low = (v % F.lit(WORD)).cast("decimal(20,0)")
    return F.when(v < F.lit(WORD), F.array(low)).when(v.isNotNull(), F.array(low, F.call_function("div", v, F.lit(WORD)).cast("decimal(20,0)")))


def unwords(parts: Column) -> Column:
    """The `decimal(38,0)` of its words."""
    return (F.get(parts, F.lit(0)) + F.coalesce(F.get(parts, F.lit(1)), F.lit(0)) * F.lit(WORD)).cast("decimal(38,0)")


def deltas(df, by: list[str], value: str):
    """df with `delta`: the value less the one before it among those of `by`, the first less 0."""
    from pyspark.sql import Window

    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(value)), F.lit(0)))


def undeltas(df, by: list[str], order: str, delta: str = "delta", name: str = "value"):
    """df with the running sum of deltas, in an order that deltas of sorted values keep."""
    from pyspark.sql import Window

    return df.withColumn(name, F.sum(delta).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
