"""Written intermediate tables for loops: cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def work_dir(spark) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where one machine runs all, one of our own where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, tag: str = "round") -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, tag: str = "edges") -> tuple[DataFrame, str]:
    """Write df to the shared folder in buckets of a key, and the table's name: joins on the key then shuffle only the other
    side. Drop the table when no plan needs it any more; its files stay with the folder."""
    spark, name = df.sparkSession, f"tessera_{tag}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{work_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name
