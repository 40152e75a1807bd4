"""The interval algebra against sets of integers, in small buckets and levels; and long intervals."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals as iv


def rows(df):
    return sorted(map(tuple, df.collect()))


def runs(ids):
    out = []
    for i in sorted(ids):
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return [tuple(x) for x in out]


def some(rng, n):
    return [(lo, lo + rng.choice([0, 1, 1, 2, 3, 5, 20, 120])) for lo in (rng.randint(-60, 300) for _ in range(n))]


def ids(intervals):
    return {i for lo, hi in intervals for i in range(lo, hi)}


@pytest.mark.parametrize("seed", range(4))
def test_against_sets(spark, monkeypatch, seed):
    monkeypatch.setattr(iv, "LEVEL", 4)
    rng = random.Random(seed)
    left, right, bucket = some(rng, 20 if seed else 0), some(rng, 18), rng.choice([3, 7, 10])
    l, r = (spark.createDataFrame(x, "lo long, hi long") for x in (left, right))
    a, b = ids(left), ids(right)
    assert rows(iv.coalesce(l, bucket)) == runs(a)
    keeps = {"and": (lambda n: (n("l") > 0) & (n("r") > 0), a & b), "less": (lambda n: (n("l") > 0) & (n("r") == 0), a - b), "or": (lambda n: (n("l") > 0) | (n("r") > 0), a | b)}
    for keep, want in keeps.values():
        assert rows(iv.sweep({"l": l, "r": r}, keep, bucket)) == runs(want)
    assert rows(iv.islands(spark.createDataFrame([(i,) for i in [*b, *b, None]], "id long"), bucket)) == runs(b)
    probes = [(i, "x") for i in range(-70, 430, 3)] * 2 + [(None, "x")]
    got = iv.contains(spark.createDataFrame(probes, "id long, pos string"), r, bucket).collect()
    assert len(got) == len(probes) and all(x.contained == (x.id in b) and x.pos == "x" for x in got)
    size, order, want = rng.choice([1, 4, 9]), sorted(b), []
    for k in range(0, len(order), size):
        want += [(k // size, *x) for x in runs(order[k : k + size])]
    assert rows(iv.chunks(r, size, bucket)) == sorted(want)
    assert sorted(x.id for x in iv.inflate(iv.coalesce(r, bucket)).collect()) == order
    keyed = [(rng.choice("xyz"), *x) for x in right]
    sets = {k: ids([x[1:] for x in keyed if x[0] == k]) for k in "xyz"}
    df = spark.createDataFrame(keyed, "key string, lo long, hi long")
    assert rows(iv.coalesce(df, bucket, ["key"])) == sorted((k, *x) for k in "xyz" for x in runs(sets[k]))
    near = lambda p, q: any({i - 1, i + 1} & sets[q] for i in sets[p])
    states = {(p, q): "overlap" if sets[p] & sets[q] else "adjacent" if near(p, q) else "separate" for p, q in ("xy", "xz", "zy")}
    assert {(x.a, x.b): x.state for x in iv.overlap(spark.createDataFrame(list(states), "a string, b string"), df, bucket=bucket).collect()} == states


def test_long_intervals(spark):
    """One row each, however many buckets they span."""
    top = 10**17
    big = spark.createDataFrame([(0, top), (5, 6), (top, top + 5), (3 * top, 3 * top + 1)], "lo long, hi long")
    assert rows(iv.coalesce(big)) == [(0, top + 5), (3 * top, 3 * top + 1)]
    assert rows(iv.difference(big, spark.createDataFrame([(5, 6)], "lo long, hi long"))) == [(0, 5), (6, top + 5), (3 * top, 3 * top + 1)]
    probes = spark.createDataFrame([(-1,), (7,), (top + 4,), (top + 5,), (3 * top,)], "id long")
    assert [x.contained for x in iv.contains(probes, big).orderBy("id").collect()] == [False, True, True, False, True]


def test_chunks_of_a_billion_ids(spark):
    chunks = iv.chunks(spark.createDataFrame([(1, 1213501999)], "lo long, hi long"), 18960)
    full = F.sum((F.col("hi") - F.col("lo") == 18960).cast("int"))
    assert tuple(chunks.agg(F.count("*"), F.max("chunk"), full, F.min("lo"), F.max("hi")).first()) == (64004, 64003, 64003, 1, 1213501999)
