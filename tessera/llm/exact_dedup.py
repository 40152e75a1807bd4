"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 sets two Bloom bits for each row's hash, both in one 4 KB bitmap that the hash names, and keeps the bits that were
set at least twice (bitmap_construct_agg). Pass 2 tests each row against its bitmap: a row of which both bits were set twice
may have a copy and is shuffled for an exact comparison of SHA-256 digests; every other row is unique and passes straight
through. Bitmaps are sent to all tasks where they are few, which is checked; a larger filter keeps its bits for each row and
is met by a join on the bitmap's number, for which digests and what is carried are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAP_BITS, MAX_MAPS, OWN, is_set, stage

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _bits(digest: Column, maps: int) -> tuple[Column, list[Column]]:
    """The number of the row's bitmap, and its two places there."""
    first = F.xxhash64(digest)
    second = F.xxhash64(first, F.lit(1))
    return F.pmod(first, F.lit(maps)), [F.pmod(x, F.lit(MAP_BITS)) for x in (second, F.shiftrightunsigned(second, 32))]


def repeated_bits(digests: DataFrame, rows: int, bits_per_row: int = 16) -> tuple[DataFrame, int]:
    """Pass 1: (map, bits) of the Bloom bits that two rows or more set, and the number of bitmaps: bits_per_row bits a row."""
    maps = max(1, -(-rows * bits_per_row // MAP_BITS))
    of, places = _bits(F.col(f"{OWN}sha"), maps)
    # A row whose two bits fall together sets that bit once.
    bits = digests.select(of.alias("map"), F.explode(F.array_distinct(F.array(*places))).alias("place"))
    twice = bits.groupBy("map", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stage(twice.groupBy("map").agg(F.bitmap_construct_agg("place").alias("bits")), "exact-bits"), maps


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, bits_per_row: int = 16, max_maps: int = MAX_MAPS
) -> DataFrame:
    """Every row with its group of equal texts.

    Adds keep_id (the id of the row that stays: the smallest, nulls first), group_size, kept, text_sha256. carry names
    the further columns to return, all by default; where one has a name of an added column or of the id, the added one
    stays. Null texts count as empty; of rows that tie on the smallest id exactly one is kept; an empty table gives an
    empty table.
    """
    added = {id_col.lower(), "keep_id", "group_size", "kept", "text_sha256"}
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in added]
    sha, row = F.col(f"{OWN}sha"), F.col(f"{OWN}row")
    # The digests are written once, which also fixes the row numbers that break ties between equal ids.
    rows = stage(
        df.select(
            F.col(id_col).alias(f"{OWN}id"),
            F.sha2(normalised(F.col(text_col)), 256).alias(f"{OWN}sha"),
            F.monotonically_increasing_id().alias(f"{OWN}row"),
            *[F.col(f"`{c}`") for c in carry],
        ),
        "exact-digests",
    )
    twice, maps = repeated_bits(rows, rows.count(), bits_per_row)
    twice = twice.select(F.col("map").alias(f"{OWN}map"), F.col("bits").alias(f"{OWN}bits"))
    of, places = _bits(sha, maps)
    tested = rows.join(F.broadcast(twice) if maps <= max_maps else twice, F.col(f"{OWN}map") == of, "left")
    for k, place in enumerate(places):
        tested = tested.withColumn(f"{OWN}set{k}", is_set(F.col(f"{OWN}bits"), place))
    tested = tested.drop(f"{OWN}map", f"{OWN}bits")
    maybe = F.col(f"{OWN}set0") & F.col(f"{OWN}set1")
    own = [F.col(f"`{c}`") for c in carry]
    straight = tested.where(~maybe).select(
        F.col(f"{OWN}id").alias(id_col), F.col(f"{OWN}id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha.alias("text_sha256"), *own,
    )
    repeated = tested.where(maybe)
    heads = repeated.groupBy(sha.alias(f"{OWN}of")).agg(
        F.min(F.struct(F.col(f"{OWN}id").alias("id"), row.alias("row"))).alias(f"{OWN}head"), F.count(F.lit(1)).alias("group_size")
    )
    # One row a group, written: the join below then shuffles both sides anew, so that large groups can be split.
    heads = stage(heads, "exact-heads")
    compared = repeated.join(heads, sha == F.col(f"{OWN}of")).select(
        F.col(f"{OWN}id").alias(id_col), F.col(f"{OWN}head.id").alias("keep_id"), "group_size",
        (row == F.col(f"{OWN}head.row")).alias("kept"), sha.alias("text_sha256"), *own,
    )
    return straight.unionByName(compared)
