"""Columns of the input that have the names of every column that an operator makes on its way, and of SQL words."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import decontam, exact_dedup, langid, mixing, near_copies, quality, queries, sharding, simhash, token_counts, token_ids, warc

NAMES = """y k t n m a b c r d id row size source_size target times taken take copies before part parts rank level cap w s z fp least root node cell cells task
own other counts bands band early met of of_row head heads digest body held digests map bits place bit sha group_size keep_id kept text_sha256 bucket pos shard slot
held_out score predicted lang_pred coverage item_id item_ids contaminated hits value block begin start base n_tokens ids_crc32 component_id fingerprint page refers_to
record_type payload stated goal_of label text2 some order select count""".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"word{k % 7} some text of row {k % 9} and more words to count", "en", f"s{k % 3}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


def same(df, docs, added=()):
    """df has the input's further columns, as they were but where the operator replaces them."""
    rows = df.collect()
    assert len(rows) == docs.count()
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES if n in df.columns and n not in added)


def test_names(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"), *NAMES)
    same(sharding.shard_rows(docs, shards=3), docs, {"shard", "slot"})
    assert sorted(quality.classify(docs, labels).collect()) == sorted(quality.classify(plain, labels).collect())
    same(decontam.decontaminate(docs, docs.select(F.col("doc_id").alias("item"), "text"), item_col="item"), docs, {"contaminated", "coverage", "item_id", "item_ids"})
    same(decontam.decontaminate(docs, docs.select(F.col("doc_id").alias("item"), "text"), item_col="item", block_bytes=500), docs, {"contaminated", "coverage", "item_id", "item_ids"})
    assert warc.archive_pages(docs.withColumn("page_id", F.col("doc_id")).withColumn("url", F.lit("u")).withColumn("html", F.col("text"))).count() == 30
    assert docs.select(token_counts.token_count(F.col("text"), queries.tokenizer("byte_bpe_50k.json"))).count() == 30
    assert sorted(token_ids.encode_table(docs, queries.tokenizer("word_bpe_49k.json")).collect()) == sorted(token_ids.encode_table(plain, queries.tokenizer("word_bpe_49k.json")).collect())
    same(exact_dedup.exact_dedup(docs), docs, {"keep_id", "group_size", "kept", "text_sha256"})
    assert langid.language_id(docs).count() == 30
    assert sorted(simhash.near_duplicates(docs).collect()) == sorted(simhash.near_duplicates(plain).collect())
    same(mixing.mix(docs), docs, {"size", "source_size", "target", "times"})
    assert sorted(r.doc_id for r in near_copies.without_copies(docs).collect()) == sorted(r.doc_id for r in near_copies.without_copies(plain).collect())


def test_names_in_the_pipeline(spark, docs, tmp_path):
    d = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{d}/documents.parquet").limit(60)
    more = df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    for name, apply in cp.STAGES[:-1]:
        assert sorted(r.doc_id for r in apply(spark, more, d).collect()) == sorted(r.doc_id for r in apply(spark, df, d).collect()), name
