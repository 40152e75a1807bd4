"""The pipeline rejects what the classifier's own query rejects."""

from __future__ import annotations

import corpus_pipeline as cp
from tessera.llm import queries
from tessera.llm.common import table


def test_one_threshold(spark):
    d = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in cp.quality_filter(spark, table(spark, d, "documents"), d).collect()}
    assert kept == {r.doc_id for r in queries.op2_quality(spark, d).where("predicted = 1").collect()}
