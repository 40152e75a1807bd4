"""Removal of near copies against brute force over all pairs."""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import near_copies
from tessera.llm.common import of_rows, stage, table


def slow_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(rows):
    """Ids kept of rows (id, text) with distinct ids."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, slow_shingles(t)) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i for i in root if find(i) == i}


def edited(seed=4):
    rng, rows = np.random.default_rng(seed), []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(30, 400))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):
            new = list(words)
            for at in rng.choice(len(new), max(1, len(new) * int(rng.integers(1, 5)) // 100), replace=False):
                new[at] = f"v{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(new)))
    return rows


def test_near_copies(spark, monkeypatch):
    rows = edited()
    want = slow_kept(rows)
    assert 40 <= len(want) < 100
    df = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string").repartition(3)
    for most in (500, 2):
        monkeypatch.setattr(near_copies, "CELL_ROWS", most)
        out = near_copies.without_copies(df)
        assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(want | {1000})
    assert near_copies.without_copies(df.limit(0)).count() == 0


def test_repeated_and_missing_ids(spark):
    (_, a), (_, b), *_ = edited()
    other = " ".join(f"x{k}" for k in range(50))
    df = spark.createDataFrame([(7, a), (7, a), (7, other), (None, a), (3, a + " end")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_copies.without_copies(df).collect()) == [(3, a + " end"), (7, other)]


def test_rows_by_number(spark):
    df = spark.range(200_000).repartition(7).select(F.monotonically_increasing_id().alias("row"), "id")
    df = stage(df, "test")
    some = df.where("id % 17 = 3").select("row")
    for most in (1 << 14, 0):
        assert sorted(r.id for r in of_rows(df, "row", some, most).select("id").collect()) == list(range(3, 200_000, 17))


def test_another_text_of_a_dropped_id_stays(spark):
    df = spark.createDataFrame([(3, "one two three four five six"), (5, "one two three four five six"), (5, "quite another text of seven words")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:5]) for r in near_copies.without_copies(df).collect()) == [(3, "one t"), (5, "quite")]


def test_large_groups_are_not_compared_in_all_pairs(spark, monkeypatch):
    """A chain, a dense group and bridges found only in the second wave, in cells of many blocks."""
    monkeypatch.setattr(near_copies, "CELL_ROWS", 8)
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in range(120)]
    rows, now = [], list(base)
    for _ in range(120):  # a chain whose ends share nothing
        now = now[1:] + [f"c{rng.integers(0, 1 << 40)}"]
        rows.append((len(rows), " ".join(now)))
    for _ in range(120):
        new = list(base)
        new[int(rng.integers(0, 120))] = f"d{rng.integers(0, 1 << 40)}"
        rows.append((len(rows), " ".join(new)))
    rows += [(1000 + k, t) for k, (_, t) in enumerate(rows[:50])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in near_copies.without_copies(df).collect()} == slow_kept(rows)


def test_pipeline_mixes_no_near_copies(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    for name, apply in itertools.takewhile(lambda s: s[0] != "mixing", cp.STAGES):
        docs = stage(apply(spark, docs, d), "test")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert slow_kept(rows) == {i for i, _ in rows}
