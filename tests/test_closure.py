"""A search that its rounds cut short raises; without a bound it goes to the end."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import search


def test_long_chain(spark):
    edges = spark.range(12).select(F.lit("close").alias("kind"), F.col("id").alias("in1"), (F.col("id") + 1).alias("out"))
    seed = spark.range(1)
    assert search.closure(seed, edges).agg(F.max("step")).first()[0] == 12
    assert search.closure(seed, edges, rounds=13).count() == 13
    with pytest.raises(RuntimeError):
        search.closure(seed, edges, rounds=5)
    with pytest.raises(RuntimeError):
        search.inverse(spark.range(12, 13), edges, rounds=5)
