"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as cp
from tessera.llm import decontam, queries
from tessera.llm.common import stage, table

from .test_near_copies import slow_kept
from .test_operators import slow_targets

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs, out = table(spark, DIR, "documents"), {}
    for name, apply in cp.STAGES:
        docs = out[name] = stage(apply(spark, docs, DIR), "test")
        if name != "token_ids":
            assert docs.columns == cp.COLUMNS
    rows = {k: v.collect() for k, v in out.items()}
    good = {r.doc_id for r in table(spark, DIR, "labels").where("quality = 1").collect()}
    before = {r.doc_id for r in table(spark, DIR, "documents").collect()}
    assert len(good & before - {r.doc_id for r in rows["quality"]}) <= 0.05 * len(good)
    assert 4 <= len(cp.STAGES) <= 5
    assert {r.doc_id for r in rows["near_dedup"]} == slow_kept([(r.doc_id, r.text) for r in rows["quality"]])
    items = [b" ".join(decontam.tokens(r.text)) for r in table(spark, DIR, "benchmark").collect()]
    whole = {r.doc_id for r in rows["near_dedup"] if any(b" " + i + b" " in b" " + b" ".join(decontam.tokens(r.text)) + b" " for i in items)}
    kept = {r.doc_id for r in rows["decontamination"]}
    assert not whole & kept and whole >= {r.doc_id for r in rows["near_dedup"]} - kept
    mixed = Counter(r.doc_id for r in rows["mixing"])
    assert set(mixed) <= kept and max(mixed.values()) <= 3
    words, sizes, taken = {r.doc_id: len((r.text or "").split()) for r in rows["decontamination"]}, Counter(), Counter()
    for r in rows["decontamination"]:
        sizes[r.source] += words[r.doc_id]
        taken[r.source] += words[r.doc_id] * mixed[r.doc_id]
    for source, goal in slow_targets(sizes).items():  # as near as any choice of whole documents comes
        reach, copies = {0}, int(goal // sizes[source])
        for r in rows["decontamination"]:
            if r.source == source:
                reach |= {x + words[r.doc_id] for x in reach}
        budget = round(goal - copies * sizes[source])
        assert abs(taken[source] - copies * sizes[source] - budget) == min(abs(x - budget) for x in reach)
    lib = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    want = Counter()
    for r in rows["mixing"]:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows["token_ids"]) == want
