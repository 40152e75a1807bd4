"""The edge queries over all lines and whole part ids against brute force."""

from __future__ import annotations

from collections import defaultdict

import pytest

from tessera.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark):
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_linenumber", "l_suppkey", "l_partkey").collect()
    return {(("close", "connect", "combine")[n % 3], s, p) for n, s, p in lines}


def runs(ids):
    out = []
    for i in sorted(ids):
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return sorted(map(tuple, out))


def steps(pairs, start=1):
    to, step, front = defaultdict(set), {start: 0}, {start}
    for a, b in pairs:
        to[a].add(b)
    while front:
        n = max(step.values()) + 1
        front = {b for a in front for b in to[a]} - set(step)
        step |= dict.fromkeys(front, n)
    return step


def test_all_edges(spark, edges):
    got = lambda name, *cols: sorted(tuple(r) for r in catalog.queries()[name](spark, DIR).select(*cols).collect())
    assert len({b for _, _, b in edges}) > 100
    few, out = {e for e in edges if e[1] < 5}, defaultdict(set)
    for _, a, b in edges:
        out[b].add(a)
    assert got("edge_skinny", "kind", "in1", "out") == sorted(edges)
    assert got("edge_point", "kind", "in1", "out") == sorted(e for e in edges if e[1] == 3)
    seeds = {r[0] for r in spark.read.parquet(f"{DIR}/supplier.parquet").where("s_suppkey < 5").select("s_suppkey").collect()}
    assert got("edge_incoming", "kind", "in1", "out") == sorted(e for e in edges if e[2] in seeds)
    assert got("edge_follow", "id") == sorted({(b,) for _, _, b in few})
    assert got("edge_follow_inputs", "side", "id") == sorted({("input", a) for _, a, _ in few} | {("output", b) for _, _, b in few})
    assert got("edge_invert", "out", "n", "ins") == sorted((b, len(a), ",".join(map(str, sorted(a)))) for b, a in out.items())
    assert got("comp_rebuild", "kind", "lo", "hi") == sorted((k, *r) for k in ("close", "connect", "combine") for r in runs({a for kind, a, _ in edges if kind == k}))


def test_searches_over_all_edges(spark, edges):
    got = lambda name, *cols: sorted(tuple(r) for r in catalog.queries()[name](spark, DIR).select(*cols).collect())
    step = steps({(a, b) for _, a, b in edges})
    assert got("search_closure", "lo", "hi") == runs(step)
    assert got("search_steps", "id", "step") == sorted(step.items())
    assert got("search_multi_kind", "id") == sorted((i,) for i in step)
    assert got("search_inverse", "id", "step") == sorted(steps({(b, a) for _, a, b in edges}).items())
    rows = catalog.queries()["search_provenance"](spark, DIR).collect()
    assert {r.id: r.step for r in rows} == step and len(rows) == len(step)
    for r in rows:
        by = [(k, a) for k, a, b in edges if b == r.id and step.get(a, -9) == r.step - 1]
        assert (r.kind, r.source) == (min(by) if r.step else (None, None))
