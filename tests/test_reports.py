"""Reports, traces, sinks, indexes and codecs beside the registered queries."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest

from tessera.functions import codec
from tessera.operators import relations as rel
from tessera.operators import search
from tessera.plans import relational

E = "kind string, in1 long, out long"


def test_sorted_steps():
    steps = {1: (), 2: (), 9: (), 5: (1, 2), 3: (2,), 7: (5, 3), 8: (7, 7), 4: (9,)}
    assert search.sorted_steps(steps, 8) == [1, 2, 3, 5, 7, 8]
    assert search.sorted_steps(steps, 9) == [9]


def test_targets_and_reports(spark):
    edges = spark.createDataFrame([("close", 1, 2), ("mirror", 2, 3), ("connect", 2, 4), ("combine", 4, 5), ("close", 10, 11), ("mirror", 11, 12), ("connect", 5, 12), ("combine", 4, 11)], E)
    named = spark.createDataFrame([("start", 1), ("group", 5), ("group", 6), ("five", 5), ("wire", 5), ("ten", 10)], "name string, id long")
    assert {(r.id, tuple(r.names)) for r in search.single_names(named).collect()} == {(1, ("start",)), (5, ("wire",)), (10, ("ten",))}
    assert {tuple(r) for r in search.targets(named, edges).collect()} == {(1, 1, False, False), (5, 5, False, False), (10, 10, False, False), (2, 1, True, False), (11, 10, True, False), (3, 1, True, True), (12, 10, True, True)}
    found, steps = search.report(spark.createDataFrame([(1,)], "id long"), edges, named)
    assert {tuple(r) for r in found.collect()} == {(2, "start", "closed"), (3, "start", "closed, mirrored"), (5, "wire", ""), (11, "ten", "closed"), (12, "ten", "closed, mirrored")}
    assert {(r.id, r.source) for r in steps.collect()} == {(1, None), (2, 1), (3, 2), (4, 2), (5, 4), (11, 4), (12, 11)}


def test_traces(spark):
    found = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (5, 4)], "id long, source long")
    assert {r.id for r in search.traces(found, spark.createDataFrame([(3,), (2,)], "id long")).collect()} == {1, 2, 3}
    both = spark.createDataFrame([(1, None, None), (2, None, None), (3, 1, 2), (4, 3, 1), (5, 2, 2)], "id long, in1 long, in2 long")
    assert sorted(r.id for r in search.traces(both, spark.createDataFrame([(4,)], "id long")).collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        search.trace(found, 99)


def test_indexes(spark, tmp_path):
    objects = spark.range(20).selectExpr("id", "id % 5 as states")
    had = rel.Catalog(spark, f"file://{tmp_path}/c")
    assert had.names() == []
    had.create("states<=2", objects.where("id < 10"))
    for bad in (lambda: had.create("states<=2", objects), lambda: had.read("nothing"), lambda: had.delete("states<=3")):
        with pytest.raises(ValueError):
            bad()
    assert sorted(map(tuple, had.update("states<=2", objects.where("id >= 10")).collect())) == [(5 * k, 5 * k + 3) for k in range(4)]
    assert had.names() == ["states<=2"]
    had.delete("states<=2")
    assert had.names() == []


def test_sorted_files(spark, tmp_path):
    rng = random.Random(3)
    pairs = [(rng.choice(["close", "connect"]), rng.randrange(50), rng.randrange(50)) for _ in range(400)]
    edges = spark.createDataFrame(pairs, E)
    rel.write_skinny(edges, f"{tmp_path}/pages")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/pages").select("kind", "in1", "out").collect()} == set(pairs)
    for kind in ("close", "connect"):
        files = sorted(f for f in (tmp_path / "pages" / f"kind={kind}").glob("*.parquet"))
        own = [tuple(r) for f in files for r in spark.read.parquet(str(f)).collect()]
        assert own == sorted(own)
    rel.write_inverted(edges, f"{tmp_path}/inverted", block=7)
    assert sorted(map(tuple, rel.read_inverted(spark, f"{tmp_path}/inverted").collect())) == sorted({(b, a) for _, a, b in pairs})
    assert max(r.n for r in spark.read.parquet(f"{tmp_path}/inverted").collect()) <= 7
    store = spark.createDataFrame([(k, f"c{k}") for k in range(100)], "id long, content string")
    rel.write_hashes(store, "content", f"{tmp_path}/hashes")
    assert len(rel.hashes(store, "content").select("hash").distinct().collect()) == 100
    for f in (tmp_path / "hashes").glob("*.parquet"):
        own = [r.hash for r in spark.read.parquet(str(f)).collect()]
        assert own == sorted(own)


def test_needs(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    done = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (3, 8)], "left long, right long")
    needed = rel.needs(ids(1, 2, 3, 4, 5), done, ids(7, 8))
    assert sorted(map(tuple, needed.collect())) == [("7,8", 4, 6), ("8", 1, 3)]
    assert tuple(rel.needs_sizes(needed).first()) == (4, 6)


@pytest.mark.parametrize("form, top", [("unary", 1 << 64), ("64", 1 << 64), ("32", 1 << 32)])
def test_varints(form, top):
    write, read = codec.FORMS[form]
    edges = [0, 1, 127, 128, 240, 241, 244, 245, 2287, 2288, 2291, 2292, 67823, 67824, 67827, 67828, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 1 << 32, 1 << 56, top - 1]
    values = [v for v in edges if v < top] + [random.Random(k).randrange(top) >> (k % 64) for k in range(300)]
    whole, at = b"".join(map(write, values)), 0
    for v in values:
        got, at = read(whole, at)
        assert got == v
    assert at == len(whole)
    for bad in (-1, top):
        with pytest.raises(ValueError):
            write(bad)


def test_varint_lengths_of_wide_products(spark, tmp_path):
    """Products beyond 63 and 64 bits, as larger orders have them."""
    tops = [1 << 7 * k for k in range(1, 9)] + [t + 1 for t in codec.VARINT32_TOP]
    orders = [(1, v) for t in tops for v in (t - 1, t)] + [(1, (1 << 63) - 1), (2, 1 << 61), (2, (1 << 62) - 1), (2, 1 << 62), (8999998, 899999), (10**10, 10**10), (9, 1 << 62), (1, 0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    want = []
    for k, c in orders:
        v = k if k % 3 == 0 else k * k * c
        want.append((k, len(codec.write_varint(v)) if v < 1 << 64 else 9, len(codec.write_varint32(v)) if v < 1 << 32 else 5))
    got = relational.codec_varint_len(spark, str(tmp_path))
    assert dict(got.dtypes) == {"id": "bigint", "n": "int", "m": "int"}
    assert sorted(map(tuple, got.collect())) == sorted(want)


WIDE = [(1, 0), (3, 1), (4, 300), (1, (1 << 63) - 1), (2, 1 << 61), (2, (1 << 62) - 1), (2, 1 << 62), (2, (1 << 62) + 1), (8999998, 899999), (10**10, 10**10), (5, None)]


def products(spark, path, orders):
    """Writes the orders; (key, exact value) of each."""
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    return [(k, k if k % 3 == 0 else None if c is None else k * k * c) for k, c in orders]


@pytest.mark.parametrize("orders, kind", [(WIDE, "decimal(38,0)"), (WIDE[:4] + WIDE[-1:], "bigint"), ([(4 * 10**9, 0)], "bigint"), ([], "bigint")])
def test_varints_of_wide_products_read_again(spark, tmp_path, orders, kind):
    want = [(k, v, None if v is None else v % (1 << 32)) for k, v in products(spark, tmp_path, orders)]
    got = relational.codec_varint_back(spark, str(tmp_path))
    assert dict(got.dtypes) == {"id": "bigint", "v": kind, "w": "bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(k, v if v is None or kind == "bigint" else Decimal(v), w) for k, v, w in want], key=str)


@pytest.mark.parametrize("orders", [WIDE, WIDE[:4] + WIDE[-1:], []])
def test_varint_bytes_of_wide_products(spark, tmp_path, orders):
    """Values beyond 64 bits as words, so that no two values have the same bytes."""
    want = []
    for k, v in products(spark, tmp_path, orders):
        words = [] if v is None else [v] if v < 1 << 64 else [v % (1 << 64), v >> 64]
        forms = [None if v is None else b"".join(map(write, words)).hex() for write in (codec.write_varint, codec.write_varint64)]
        want.append((k, *forms, None if v is None else codec.write_varint32(v % (1 << 32)).hex()))
    got = relational.codec_varint_bytes(spark, str(tmp_path))
    assert dict(got.dtypes) == {"id": "bigint", "unary": "string", "long": "string", "short": "string"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert len({r[1] for r in want}) == len({r[2] for r in want}) == len({v for _, v in products(spark, tmp_path / "again", orders)})
