"""The engine: every query against its SQL, exhaustive interval models, and the automaton and gadget kernels."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import automata as A
from tessera.functions import codec, generators, puzzles
from tessera.functions import gadgets as G
from tessera.functions import regex as R
from tessera.operators import intervals as iv
from tessera.operators import gadget_ops
from tessera.operators import relations as rel
from tessera.operators import search
from tessera.plans import catalog
from tessera.sources import definitions
from tessera.streaming import incremental

from .oracle import connect, difference

DIR = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, con, name):
    assert difference(catalog.queries()[name](spark, DIR), con, SQL[name]) == ""


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(SQL)


@pytest.fixture(scope="module")
def pairs(spark):
    """All 65536 pairs of 8-bit sets, each in its own stretch of 16 ids."""
    cases = spark.range(1 << 16).select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    side = lambda shift: cases.where(F.expr(f"(id >> (bit + {shift})) & 1 = 1")).select((F.col("id") * 16 + F.col("bit")).alias("id"))
    return iv.islands(side(0), bucket=1000), iv.islands(side(8), bucket=1000)


@pytest.mark.parametrize("name, bits", [("union", lambda a, b: a | b), ("intersection", lambda a, b: a & b), ("difference", lambda a, b: a & ~b)])
def test_all_pairs_of_small_sets(pairs, name, bits):
    l, r = pairs
    made = {"union": lambda: iv.union(l, r), "intersection": lambda: iv.intersection(l, r), "difference": lambda: iv.difference(l, r)}[name]()
    got = sorted((x.lo, x.hi) for x in made.collect())
    want = []
    for case in range(1 << 16):
        word = bits(case & 255, case >> 8)
        run = [k for k in range(8) if word >> k & 1]
        for _, g in itertools.groupby(enumerate(run), lambda t: t[1] - t[0]):
            g = [k for _, k in g]
            want.append((case * 16 + g[0], case * 16 + g[-1] + 1))
    assert got == sorted(want)


def test_intervals_across_buckets(spark):
    df = spark.createDataFrame([(0, 25), (25, 30), (41, 41), (50, 60), (55, 95), (100, 101)], "lo long, hi long")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(iv.coalesce(df, bucket=10)) == [(0, 30), (50, 95), (100, 101)]
    assert rows(iv.chunks(df, 40, bucket=10)) == [(0, 0, 30), (0, 50, 60), (1, 60, 95), (1, 100, 101)]
    assert iv.size(iv.coalesce(df, bucket=7)).first()[0] == 76
    assert iv.size(df.limit(0)).first()[0] == 0 and iv.coalesce(df.limit(0)).count() == 0
    probes = spark.createDataFrame([(k,) for k in (-1, 0, 29, 30, 94, 95, 100)], "id long")
    assert [r.contained for r in iv.contains(probes, df, bucket=10).orderBy("id").collect()] == [False, True, True, False, True, False, True]


def test_relations_reject_what_they_should(spark):
    done = spark.createDataFrame([(0, 5)], "lo long, hi long")
    with pytest.raises(ValueError):
        rel.record(done, done)
    named = spark.createDataFrame([("a", 1)], "name string, id long")
    for bad in (["nobody"], ["[5,5)"]):
        with pytest.raises(ValueError):
            rel.ids_of(bad, named)
    with pytest.raises(ValueError):
        rel.apply_bounds(done, {"states": 0}, {})
    assert rel.parse_ids("(1, 5]") == (2, 6) and rel.parse_ids("12") == (12, 13)


def test_trace(spark):
    edges = spark.createDataFrame([("close", 1, 2), ("connect", 2, 3), ("connect", 1, 3), ("close", 3, 4)], "kind string, in1 long, out long")
    found = search.closure(spark.createDataFrame([(1,)], "id long"), edges)
    assert search.trace(found, 4) == [("connect", 1, 3), ("close", 3, 4)]


def words(n, most):
    return itertools.chain.from_iterable(itertools.product(range(n), repeat=k) for k in range(most + 1))


def language(x, most=5):
    return {w for w in words(x.alphabet, most) if x.run(w)}


@pytest.mark.parametrize("seed", range(12))
def test_normal_forms_keep_the_language(seed):
    x = generators.random_automaton(seed, 2, 6, 10)
    want = language(x, 7)
    left, both = (lambda y: y.optimize("left")), (lambda y: y.optimize("both"))
    for form in (A.Automaton.determinize, A.Automaton.minimize, A.Automaton.canonical, A.Automaton.optimize, left, both, A.Automaton.remove_dead, A.Automaton.totalize):
        assert language(form(x), 7) == want
    assert eval(repr(x), {"Automaton": A.Automaton}) == x and A.parse(A.serialize(x)) == x and A.unpack(A.pack(x)) == x
    order = list(range(1, 6))
    random.Random(seed).shuffle(order)
    assert x.renumber_states([0, *order]).canonical() == x.canonical()
    y = generators.random_automaton(seed + 100, 2, 6, 10)
    other, every = language(y, 7), set(words(2, 7))
    assert language(A.conj(2, x, y), 7) == want & other and language(A.alt(2, x, y), 7) == want | other and language(A.comp(x), 7) == every - want
    assert language(A.cat(2, x, y), 5) == {a + b for a in want for b in other if len(a + b) <= 5}
    assert language(A.star(x), 4) == {w for w in words(2, 4) if _splits(w, want)}
    assert language(A.shuffle_accept(x, A.empty(2))) == set()


def _splits(w, parts):
    return not w or any(w[:k] in parts and _splits(w[k:], parts) for k in range(1, len(w) + 1))


def test_automaton_goldens():
    assert len(A.Automaton(4, [{}, {}], [0, 1]).minimize().rows) == 1
    assert len(A.Automaton(4, [{0: {1}, 1: {2}}, {}, {}], [1, 2]).minimize().rows) == 2
    assert [sorted(c) for c in A.lit(2, 0, 1, 0, 1, 1).components()] == [[5], [4], [3], [2], [1], [0]]
    assert A.lit(4, 2, 3, 2, 3).active_alphabet() == {2, 3}
    s = A.shuffle_accept(A.lit(2, 0, 0), A.lit(2, 1, 1))
    assert {w for w in ("0011", "1100", "00", "11", "0101", "1010", "") if s.run(map(int, w))} == {"0011", "1100"}
    many = A.Automaton(2, [{0: set(range(1, 40))}, *({0: {40}} for _ in range(39)), {}], [40])
    assert len(many.optimize().rows) == 3
    with pytest.raises(ValueError):
        A.between(A.lit(2, 0), 2, 2)


def test_regex_folds_and_counts():
    z, o = R.lit(2, 0), R.lit(2, 1)
    assert R.cat(2, z, R.empty(2)) == R.empty(2) and R.alt(2, R.empty(2), z) == z and R.star(R.star(z)) == R.star(z)
    assert R.repeat(R.repeat(z, 2, 2), 3, 3).bounds == (6, 6) and R.comp(R.comp(o)) == o and R.star(R.any_symbol(2)) == R.all_words(2)
    two = R.at_least_of(o, 2, 4)
    assert set(two.enumerate()) == {w for w in itertools.product((0, 1), repeat=4) if sum(w) >= 2}


def test_gadget_facts():
    both = lambda edges: [*edges, *(e[::-1] for e in edges)]
    wire, diode = G.from_edges(both([(0, 0, 1, 0)])), G.from_edges([(0, 0, 1, 0)])
    split = lambda n: G.from_edges(both(generators.split(n)))
    assert G.close(wire) is G.close(diode) is G.mirror(wire) is G.mirror(diode) is None and not list(G.connect(split(3)))
    assert [m for _, m, _ in G.connect(split(4))] == [wire] * 4
    assert [x[3] for x in G.combine(wire, wire)] == [wire] * 4 and [x[3] for x in G.combine(diode, diode)] == [diode] * 4
    two_toggle = both([(0, 0, 1, 1), (0, 3, 2, 1)])
    for turn in range(4):  # rotation of the locations and renaming of states don't matter
        assert G.from_edges([(s, (a + turn) % 4, (b + turn) % 4, t) for s, a, b, t in two_toggle]) == G.from_edges(two_toggle)
    assert G.encode(G.decode(split(5))) == split(5)
    assert list(G.Naming("d", [], [(0, 0, 1, 0)]).names) == ["d"]
    for v in (0, 127, 128, 2**14 - 1, 2**14, 2**56 - 1, 2**56, 2**64 - 1):
        assert codec.read_varint(codec.write_varint(v)) == (v, len(codec.write_varint(v)))


def test_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"gadgets": {"wire": {"uedges": [[0, 0, 1, 0]]}, "diode": {"dedges": [[0, 0, 1, 0]], "pragma": "x"}}, "aliases": {"w": "wire"}}))
    (tmp_path / "g.yaml").write_text("gadgets:\n  wire: {uedges: [[0, 0, 1, 0]]}\n")
    got = {r.name: r for r in definitions.read_gadgets(spark, str(tmp_path / "g.json")).collect()}
    assert got["w"].alias_of == "wire" and got["diode"].pragma == ["x"]
    edges = definitions.edges_of(definitions.read_gadgets(spark, str(tmp_path / "g.yaml")))
    assert [tuple(r) for r in edges.collect()] == [("wire", 0, 0, 1, 0, False)]
    with pytest.raises(ValueError):
        definitions.read_gadgets(spark, "g.txt")
    p = puzzles.parse_non('title "t"\nwidth 2\nheight 2\n\nrows\n1\n2\n\ncolumns\n2\n1\n')
    assert p.rows == [[1], [2]] and list(p.solutions()) == [(1, 0, 1, 1)]
    q = puzzles.parse_path("rows 2 -\ncols - 2\nterminal 0 0\nterminal 1 1\n")
    assert list(q.solutions()) == [(0, 1, 3)]


def test_names_of_definitions():
    toggle = G.Naming("t", [(0, 0, 1, 1)])  # turning it round changes its state
    assert list(toggle.names) == ["t"] and toggle.log == [("t", "t", 0, toggle.log[0][3], -1)]
    lock = [(0, 0, 1, 0), (0, 2, 3, 1), (0, 3, 2, 1)]
    made = G.Naming("l", lock)
    assert set(made.names) == {"l", "l-0", "l-1"} and made.names["l"] == made.names["l-0"] + made.names["l-1"]
    custom = G.Naming("l", lock, state_names={0: "open"})
    assert set(custom.names) == {"l", "l-open"}
    assert set(G.Naming("l", lock, state_names={0: None}).names) == {"l"}
    assert set(G.Naming("l", lock, [(1, 1, 3, 2)]).names) >= {"l"}
    twisted = G.Naming("c", [], [(0, 0, 1, 0), (0, 1, 2, 0), (0, 0, 3, 0)])
    assert set(twisted.names) == {"c", "c-r", "c-s"} and twisted.names["c"] == twisted.names["c-r"] + twisted.names["c-s"]
    assert G.mirror(twisted.names["c-r"][0]) == twisted.names["c-s"][0]
    with pytest.raises(ValueError):
        G.Naming("t", [(0, 0, 1, 1)], state_names={0: "a", 1: "b"})
    assert set(G.Naming("t", [(0, 0, 1, 1)], state_names={0: "a", 1: "b"}, prunable=True).names) == {"t", "t-a"}
    with pytest.raises(ValueError):
        G.with_aliases({"a": []}, [("b", "c")])
    assert set(G.with_aliases({"a": []}, [("b", "a"), ("c", "b")])) == {"a", "b", "c"}


def test_names_and_dumps_round_trip(spark, tmp_path):
    doc = {"gadgets": {"wire": {"uedges": [[0, 0, 1, 0]]}, "l": {"uedges": [[0, 0, 1, 0], [0, 2, 3, 1], [0, 3, 2, 1]], "state-names": {"0": "open", "1": "shut"}}}, "aliases": {"w": "wire", "v": "w"}}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    read = definitions.read_gadgets(spark, str(tmp_path / "g.json"))
    rows = definitions.names_of(read).collect()
    assert {r.name for r in rows} == {"wire", "w", "v", "l", "l-open", "l-shut"} and len({bytes(r.enc) for r in rows if r.name in ("wire", "w", "v")}) == 1
    assert {tuple(r)[:3] for r in definitions.name_log(read).collect()} == {("wire", "wire", 0), ("l-open", "l", 0), ("l-shut", "l", 1)}
    encs = sorted({bytes(r.enc) for r in rows})
    store = spark.createDataFrame([(k, bytearray(e)) for k, e in enumerate(encs, 1)], "id long, enc binary")
    edges = gadget_ops.decoded(store)
    definitions.write_gadgets(edges.select(F.format_string("dumped-%d", "id").alias("name"), *"sabt", "directed"), str(tmp_path / "dump"))
    back = definitions.names_of(definitions.read_dump(spark, str(tmp_path / "dump"))).collect()
    assert {bytes(r.enc) for r in back} >= set(encs)
    named = spark.createDataFrame([(r.name, encs.index(bytes(r.enc)) + 1) for r in rows], "name string, id long")
    text = "\n".join(r.text for r in definitions.dump_text(gadget_ops.with_stats(store), edges, named).orderBy("id").collect())
    assert "names: v, w, wire" in text and "groups: l" in text and "undirected edges: [0, 0, 1, 0]" in text
    (tmp_path / "bad.json").write_text(json.dumps({"gadgets": {"wire": {"uedges": [[0, 0, 1, 0]]}}, "aliases": {"w": "none"}}))
    with pytest.raises(ValueError):
        definitions.names_of(definitions.read_gadgets(spark, str(tmp_path / "bad.json")))


def test_drawn_gadgets(spark, tmp_path):
    dot = lambda i, x, y: f'<mxCell id="{i}" style="ellipse;x" parent="g"><mxGeometry x="{x}" y="{y}"/></mxCell>'
    dots = "".join(dot(f"d{k}", 40 * (k % 3), 40 * (k // 3) + 1) for k in range(6))
    xml = f'<root><mxCell id="g" style="group"><mxGeometry x="10" y="20"/></mxCell>{dots}<mxCell id="e" style="line" parent="g" source="d5" target="d0"><mxGeometry/></mxCell></root>'
    (tmp_path / "d.xml").write_text(xml)
    assert [tuple(r) for r in definitions.drawn_gadgets(spark, str(tmp_path / "d.xml")).collect()] == [("drawn_0", [[0, 0, 2, 1]])]


def test_tunnels():
    toggle, lock, diode = generators.Tunnel([(0, 0, 1, 1)]), generators.Tunnel([(0, 0, 1, 0)], names=("open", "shut"), states=2), generators.Tunnel([], [(0, 0, 1, 0)])
    assert (toggle.turning, lock.turning, diode.turning) == ("states", "nothing", "else") and diode.same_states and not lock.changes
    assert set(generators.unblocked({"t": toggle}, {"u": generators.Tunnel([(1, 0, 1, 0)]), "l": lock})) == {"t", "l"}
    made = {n: (e, names) for n, e, names in generators.tunnel_pairs({"t": toggle, "l": lock, "d": diode})}
    assert {n for n in made if n.startswith("t-")} == {f"t-t-{x}" for x in ("parallel", "antiparallel", "crossing")} | {f"t-{o}-{x}{m}" for o, m2 in (("l", ("-matched", "-mismatched")), ("d", ("",))) for m in m2 for x in ("noncrossing", "crossing")}
    assert not any(n.startswith("l-l") for n in made) and made["d-d-parallel"][0] == {(0, 0, 1, 0), (0, 3, 2, 0)}
    assert made["t-l-crossing-mismatched"] == ({(0, 0, 2, 1), (1, 2, 0, 0), (1, 3, 1, 1), (1, 1, 3, 1)}, {0: "0-shut", 1: "1-open"})
    assert made["l-t-crossing-mismatched"][1] == {0: "shut-0", 1: "open-1"}


def test_streamed_index(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).select("id", (F.col("id") % 10).alias("v")).repartition(3).write.parquet(source)
    stream = spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(source)
    incremental.keep_index(stream, str(tmp_path / "out"), "v", 4, str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(tuple, incremental.read_index(spark, str(tmp_path / "out")).collect()))
    assert got == [(10 * k, 10 * k + 5) for k in range(10)]
