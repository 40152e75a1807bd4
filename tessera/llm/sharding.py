"""Sharding by a two-pass external shuffle.

Pass 1 scatters the rows uniformly over memory-sized buckets by a seeded hash. Pass 2 holds one bucket at a time, sorts
it by that hash, shuffles it by Fisher-Yates with a generator seeded by the bucket, and writes it. The buckets end to end
are one uniform permutation of the table; shard s of k takes the positions floor(s*n/k) to floor((s+1)*n/k) of it, so
that row counts are at most one apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, crc32, stage

#: Bytes of a bucket, which a worker holds twice.
BUCKET_BYTES = 128 << 20
#: Bounds the reducers of the one shuffle and the table of bucket offsets that pass 2 broadcasts; larger inputs get larger
#: buckets (100 TB: 400 MB).
MAX_BUCKETS = 1 << 18
#: Several buckets for each core of a small cluster.
MIN_BUCKETS = 64


def _fisher_yates(seed: int):
    """mapInArrow function over partitions of whole buckets: rows in shuffled order, with their position."""

    def shuffle(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        buckets = rows.column(f"{OWN}bucket").to_numpy()
        # Rows arrive in any order; sorting by key first makes a rerun of the task give the same permutation.
        order = np.lexsort((rows.column(f"{OWN}key").to_numpy(), buckets))
        edges = np.flatnonzero(np.diff(buckets[order])) + 1
        for part in np.split(order, edges):
            bucket = int(buckets[part[0]])
            part = part[np.random.default_rng([seed, bucket]).permutation(len(part))]
            place = np.arange(len(part))
            for at in range(0, len(part), 2000):
                out = rows.take(pa.array(part[at : at + 2000])).drop_columns([f"{OWN}key"])
                yield from out.append_column(f"{OWN}pos", pa.array(place[at : at + 2000], pa.int64())).combine_chunks().to_batches()

    return shuffle


def shard_rows(df: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of df with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard), from the written buckets.

    The result reads the bucket files in the shared folder; write it with partitionBy("shard") for one folder a shard.
    The hash covers the id, the text and the row's number in the scan, so that neither null or repeated ids nor copies
    crowd one bucket. Reruns over the same splits of the input agree; other splits give another, equally uniform order.
    Columns of df named shard or slot are replaced. A null text is
    empty; an empty table gives no rows.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot")])
    total = df.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64).alias("b")).first()["b"] or 0
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, -(-total // bucket_bytes)))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.monotonically_increasing_id())
    scattered = df.withColumn(f"{OWN}key", key).withColumn(f"{OWN}bucket", F.pmod(F.xxhash64(f"{OWN}key"), F.lit(buckets)).cast("int"))
    out_schema = df.select("*", F.lit(0).alias(f"{OWN}bucket"), F.lit(0).cast("long").alias(f"{OWN}pos")).schema
    dealt = scattered.repartitionById(buckets, F.col(f"{OWN}bucket")).select(*[F.col(f"`{c}`") for c in df.columns], f"{OWN}bucket", f"{OWN}key")
    written = stage(dealt.mapInArrow(_fisher_yates(seed), out_schema), "shard-buckets")
    # One row a bucket: the offsets of the buckets in the whole permutation.
    sizes = written.groupBy(F.col(f"{OWN}bucket").alias(f"{OWN}b")).agg(F.count(F.lit(1)).alias(f"{OWN}n"))
    counts = {r[0]: r[1] for r in sizes.collect()}
    starts, n = [], 0
    for b in sorted(counts):
        starts.append((b, n))
        n += counts[b]
    offsets = df.sparkSession.createDataFrame(starts, f"{OWN}b int, {OWN}start long")
    at = F.col(f"{OWN}start") + F.col(f"{OWN}pos")
    placed = written.join(F.broadcast(offsets), F.col(f"{OWN}bucket") == F.col(f"{OWN}b")).withColumn(f"{OWN}at", at)
    placed = placed.withColumn("shard", F.expr(f"cast((({OWN}at + 1) * {shards} - 1) div {max(1, n)} as int)"))
    placed = placed.withColumn("slot", F.col(f"{OWN}at") - F.expr(f"(cast(shard as long) * {n}) div {shards}"))
    return placed.drop(f"{OWN}at", f"{OWN}start", f"{OWN}pos", f"{OWN}bucket", f"{OWN}b")


def digest(sharded: DataFrame) -> DataFrame:
    """The columns of op1 from sharded rows."""
    return sharded.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
