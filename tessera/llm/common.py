"""What the operators of this subpackage share: the shared work folder, staged tables, input checks."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of the columns that operators add while they work; inputs may use any other name.
OWN = "_tz_"


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only in local mode, where one machine runs all, is a temporary folder set as checkpoint folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, outlives lost executors."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes."""
    return F.crc32(text.cast("binary"))


def id_fold(doc_id: str, parts: int) -> Column:
    """crc32 of the decimal text of the id, modulo parts; a null id gives null."""
    return crc32(F.col(doc_id).cast("string")) % parts


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and the n + 1 offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.large_binary():
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or not len(texts):
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return memory that this worker has freed to the machine: Spark keeps idle workers, of which each holds what it held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run):
    """A function over batches that gives memory back at the end of each task."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(texts: pa.Array, most_bytes: int = 1 << 20):
    """Cut an array of texts into runs of about most_bytes, at least one text each: bounds memory."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    group = np.cumsum(lengths) // most_bytes
    cuts = np.flatnonzero(np.diff(group)) + 1
    begin = 0
    for end in [*cuts.tolist(), len(texts)]:
        if end > begin:
            yield texts.slice(begin, end - begin)
            begin = end


#: Bits of one bitmap of bitmap_construct_agg, and bitmaps that are broadcast at most (64 MB).
MAP_BITS, MAX_MAPS = 32768, 16384


def is_set(bits: Column, at: Column) -> Column:
    """A bit of a bitmap; a missing bitmap has none."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def of_rows(df: DataFrame, row: str, rows: DataFrame, max_maps: int = MAX_MAPS) -> DataFrame:
    """df's rows whose number `row` is in rows (row). The numbers become bitmaps, which are sent to all tasks where they are
    few, which is checked, so that df isn't shuffled whatever its rows hold; beyond, df is joined with them."""
    maps = rows.groupBy(F.expr(f"{row} div {MAP_BITS}").alias(f"{OWN}map")).agg(F.bitmap_construct_agg(F.expr(f"{row} % {MAP_BITS}")).alias(f"{OWN}bits"))
    maps = stage(maps, "row-bits")
    maps = F.broadcast(maps) if maps.count() <= max_maps else maps
    met = df.join(maps, F.expr(f"{row} div {MAP_BITS}") == F.col(f"{OWN}map"))
    return met.where(is_set(F.col(f"{OWN}bits"), F.expr(f"{row} % {MAP_BITS}"))).drop(f"{OWN}map", f"{OWN}bits")
