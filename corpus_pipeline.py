"""The corpus pipeline: quality filter, near-duplicate removal, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's result to the shared folder and hands it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, near_copies, quality, queries, token_ids
from tessera.llm.common import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of which the classifier holds label 1 less likely than this go: those that op2_quality predicts label 0.
QUALITY = quality.THRESHOLD


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of docs, doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model, spark) >= QUALITY).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that 5-word Jaccard similarities of 0.8 or more connect, the document with the least id. SimHash groups
    give candidates, and so do MinHash bands, as pairs of that similarity are up to 20 bits apart; all are compared exactly."""
    return near_copies.without_copies(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs).where("times > 0")
    return mixed.withColumn("_tz_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the mix in binary files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_ids.encode_table(docs, queries.tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mix),
    ("token_ids", token_files),
]

#: SQL can't express the classifier, fingerprints, tiling or the vocabulary; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
