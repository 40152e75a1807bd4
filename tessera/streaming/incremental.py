"""Incremental upkeep of indexes and completions by Structured Streaming batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as iv


def keep_index(stream: DataFrame, path: str, column: str, k: int, checkpoint: str):
    """A query that appends to path, for each batch of new objects (id, ...), the intervals of ids with column <= k.

    Each batch writes into a folder of its own number, so that a batch that runs twice after a failure counts once.
    """

    def extend(batch: DataFrame, number: int) -> None:
        found = iv.islands(batch.where(F.col(column) <= k).select("id"))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark, path: str) -> DataFrame:
    return iv.coalesce(spark.read.schema("lo long, hi long, batch int").parquet(path).select("lo", "hi"))
