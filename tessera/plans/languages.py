"""Queries over automata, regular expressions, gadgets, generators and puzzles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import automata as A
from ..functions import gadgets as G
from ..functions import generators as gen
from ..functions import puzzles, tables
from ..functions import regex as R
from ..operators import gadget_ops
from .base import WORDS, day_words, query
from .golden import GOLDEN

n = 5
V, C, P, E, S = (R.lit(n, k) for k in range(n))
DOT = R.any_symbol(n)
#: name, expression, the same for RE2 over digits.
EXPRESSIONS = {
    "fa_run": (R.cat(n, R.star(DOT), V, R.star(DOT), P, R.star(DOT)), ".*0.*2.*"),
    "fa_cat": (R.cat(n, V, DOT, R.star(DOT)), "0..*"),
    "fa_alt": (R.alt(n, R.cat(n, V, C), R.cat(n, C, R.star(DOT)), P), "01|1.*|2"),
    "fa_star": (R.star(R.alt(n, V, R.cat(n, C, P))), "(0|12)*"),
    "fa_plus": (R.plus(R.alt(n, V, C)), "[01]+"),
    "fa_maybe": (R.cat(n, R.maybe(V), R.maybe(C), R.maybe(P)), "0?1?2?"),
    "fa_ncopies": (R.repeat(R.alt(n, V, C, P), 2, 2), "[012]{2}"),
    "fa_nor_more": (R.repeat(R.alt(n, V, C, P), 2, None), "[012]{2,}"),
    "fa_range": (R.repeat(R.alt(n, V, C, P, E), 1, 3), "[0123]{1,3}"),
    "fa_any": (R.repeat(DOT, 2, 2), ".{2}"),
    "fa_lit": (R.lit(n, 0, 0), "00"),
    "fa_empty": (R.empty(n), "[^0-9]"),
    "fa_all": (R.all_words(n), ".*"),
    "fa_epsilon": (R.epsilon(n), ""),
}
for name, (expression, pattern) in EXPRESSIONS.items():
    query(name, f"SELECT user_id, day, regexp_full_match(w, '{pattern}') AS accepted FROM ({WORDS})")(
        lambda s, d, rx=expression: day_words(s, d).select("user_id", "day", rx.matches(F.col("word")).alias("accepted"))
    )

HAS_P, NO_E = R.cat(n, R.star(DOT), P, R.star(DOT)), R.comp(R.cat(n, R.star(DOT), E, R.star(DOT)))


@query("fa_conj", f"SELECT user_id, day, regexp_full_match(w, '.*2.*') AND NOT regexp_full_match(w, '.*3.*') AS accepted FROM ({WORDS})")
def fa_conj(s, d):
    return day_words(s, d).select("user_id", "day", R.conj(n, HAS_P, NO_E).matches(F.col("word")).alias("accepted"))


@query("fa_comp", f"SELECT user_id, day, NOT regexp_full_match(w, '.*3.*') AS accepted FROM ({WORDS})")
def fa_comp(s, d):
    return day_words(s, d).select("user_id", "day", NO_E.matches(F.col("word")).alias("accepted"))


def _compiled(rx: R.Rx, automaton: A.Automaton) -> R.Rx:
    """An expression whose automaton is given."""

    class Given(R.Rx):
        def compile(self):
            return automaton

    return Given(rx.alphabet, "given")


#: Operations that keep the language; the acceptance of all words shows it.
RX, PATTERN = R.cat(n, R.star(R.alt(n, V, R.cat(n, C, DOT))), R.repeat(R.alt(n, V, P, E), 0, 2)), "(0|1.)*[023]{0,2}"
NORMAL_FORMS = {
    "fa_determinize": A.Automaton.determinize, "fa_minimize": A.Automaton.minimize, "fa_canonicalize": A.Automaton.canonical, "fa_optimize": A.Automaton.optimize,
    "fa_remove_dead": A.Automaton.remove_dead, "fa_totalize": A.Automaton.totalize, "fa_pack": lambda x: A.unpack(A.pack(x)), "fa_text": lambda x: A.parse(A.serialize(x)),
}
for name, form in NORMAL_FORMS.items():
    query(name, f"SELECT user_id, day, regexp_full_match(w, '{PATTERN}') AS accepted FROM ({WORDS})")(
        lambda s, d, form=form: day_words(s, d).select("user_id", "day", _compiled(RX, form(RX.compile())).matches(F.col("word")).alias("accepted"))
    )

#: States of the least automaton are the futures that words leave open, told apart by all words of up to 3 symbols; words
#: of up to 3 symbols reach all of them.
FUTURES = f"""WITH RECURSIVE w(w) AS (SELECT '' UNION ALL SELECT w || s FROM w, range({n}) t(s) WHERE length(w) < 4),
    f AS (SELECT p.w AS w, string_agg(CASE WHEN regexp_full_match(p.w || q.w, '{PATTERN}') THEN '1' ELSE '0' END, '' ORDER BY q.w) AS f FROM w p, w q WHERE length(q.w) <= 3 GROUP BY p.w),
    live AS (SELECT * FROM f WHERE contains(f, '1')),
    t AS (SELECT DISTINCT a.f AS src, s, b.f AS dst FROM live a, range({n}) x(s), live b WHERE length(a.w) <= 3 AND b.w = a.w || s),
    c AS (SELECT CAST(count(DISTINCT f) AS INTEGER) AS states, CAST(count(DISTINCT CASE WHEN f LIKE '1%' THEN f END) AS INTEGER) AS accepting FROM live WHERE length(w) <= 3),
    m AS (SELECT states, accepting, (SELECT CAST(count(*) AS INTEGER) FROM t) AS transitions FROM c)"""


@query("fa_counts", f"""{FUTURES} SELECT name, states, accepting, transitions FROM m, (VALUES ('minimize'), ('canonicalize'), ('remove_dead'), ('pack'), ('text')) t(name)
    UNION ALL SELECT 'totalize', states + 1, accepting, (states + 1) * {n} FROM m""")  # fmt: skip
def fa_counts(s, d):
    """States, accepting states and transitions of the normal forms; only a total automaton has a state without a future."""
    least = RX.compile().minimize()
    forms = {"minimize": least, "canonicalize": RX.compile().canonical(), "remove_dead": least.totalize().remove_dead(), "pack": A.unpack(A.pack(least)), "text": A.parse(A.serialize(least)), "totalize": least.totalize()}
    rows = [(k, st["states"], st["accepting"], st["transitions"]) for k, x in forms.items() for st in [x.stats()]]
    return s.createDataFrame(rows, "name string, states int, accepting int, transitions int")


def many_ways(k: int) -> A.Automaton:
    """00 in k ways."""
    return A.Automaton(2, [{0: set(range(1, k + 1))}, *({0: {k + 1}} for _ in range(k)), {}], [k + 1])


@query("fa_reduce", "SELECT * FROM (VALUES ('many', 'right', 3), ('many', 'left', 3), ('ends', 'right', 4), ('ends', 'left', 4), ('ends', 'both', 3), ('fork', 'right', 4), ('fork', 'left', 3), ('none', 'right', 1)) t(name, side, states)")
def fa_reduce(s, d):
    """ends: 0 twice, or 01, by two ways with ends of their own; fork: 0, then 0 or 1, by two ways to one end."""
    ends = A.Automaton(2, [{0: {1, 2}}, {0: {3}, 1: {3}}, {0: {4}}, {}, {}], [3, 4])
    fork = A.Automaton(2, [{0: {1, 2}}, {0: {3}}, {1: {3}}, {}], [3])
    cases = [("many", many_ways(1500), "right"), ("many", many_ways(1500), "left"), *(("ends", ends, x) for x in ("right", "left", "both")), ("fork", fork, "right"), ("fork", fork, "left"), ("none", A.Automaton(2, [{0: {1}}, {0: {0}}], []), "right")]
    return s.createDataFrame([(name, side, len(x.optimize(side).rows)) for name, x, side in cases], "name string, side string, states int")


BITS8 = "SELECT CAST(len AS INTEGER) AS len, CASE WHEN len = 0 THEN '' ELSE right(lpad(to_base(v, 2), 8, '0'), len) END AS word FROM range(9) l(len), range(256) b(v) WHERE v < pow(2, len)"


def bit_words(s):
    """(len, word): all words of up to 8 bits."""
    words = s.range(9).select(F.col("id").cast("int").alias("len")).withColumn("v", F.explode(F.expr("sequence(0, shiftleft(1, len) - 1)")))
    return words.select("len", F.when(F.col("len") == 0, "").otherwise(F.expr("right(lpad(bin(v), 8, '0'), len)")).alias("word"))


def bits(word):
    return F.transform(F.filter(F.split(word, ""), lambda x: x != ""), lambda x: x.cast("int"))


@query("fa_shuffle", f"SELECT word, regexp_full_match(word, '(00)*11(00)*') AS accepted FROM ({BITS8})")
def fa_shuffle(s, d):
    x = A.shuffle_accept(A.star(A.lit(2, 0, 0)), A.lit(2, 1, 1))
    return bit_words(s).select("word", _compiled(R.epsilon(2), x).matches(bits("word")).alias("accepted"))


@query("fa_enumerate", f"SELECT word, len AS length FROM ({BITS8}) WHERE regexp_full_match(word, '0*1(0|11){{0,2}}') AND len <= 5")
def fa_enumerate(s, d):
    z, o = R.lit(2, 0), R.lit(2, 1)
    rx = R.conj(2, R.cat(2, R.star(z), o, R.repeat(R.alt(2, z, R.lit(2, 1, 1)), 0, 2)), R.repeat(R.any_symbol(2), 0, 5))
    return rx.words(s).select(F.replace("word", F.lit(","), F.lit("")).alias("word"), "length")


@query("fa_enumerate_table", f"SELECT word, len AS length FROM ({BITS8}) WHERE regexp_full_match(word, '0*1(0|11){{0,2}}') AND len <= 5")
def fa_enumerate_table(s, d):
    """The same words from a table function, asked for by a row that holds the automaton's text."""
    z, o = R.lit(2, 0), R.lit(2, 1)
    rx = R.conj(2, R.cat(2, R.star(z), o, R.repeat(R.alt(2, z, R.lit(2, 1, 1)), 0, 2)), R.repeat(R.any_symbol(2), 0, 5))
    words = tables.Words(F.lit(A.serialize(rx.compile())))
    return words.select(F.replace("word", F.lit(","), F.lit("")).alias("word"), "length")


CASES = {"none": R.empty(2), "some": R.lit(2, 0, 1), "all": R.all_words(2), "loop": R.star(R.lit(2, 0)), "clash": R.conj(2, R.lit(2, 0), R.lit(2, 1))}


@query("fa_is_empty", "SELECT * FROM (VALUES ('none', true, false), ('some', false, false), ('all', false, true), ('loop', false, true), ('clash', true, false)) t(name, empty, infinite)")
def fa_is_empty(s, d):
    return s.createDataFrame([(k, r.is_empty(), r.is_infinite()) for k, r in CASES.items()], "name string, empty boolean, infinite boolean")


@query("fa_compare", "SELECT * FROM (VALUES ('loop', 'all', 'smaller'), ('all', 'loop', 'larger'), ('some', 'some', 'equal'), ('some', 'loop', 'incomparable'), ('none', 'clash', 'equal')) t(a, b, relation)")
def fa_compare(s, d):
    pairs = (("loop", "all"), ("all", "loop"), ("some", "some"), ("some", "loop"), ("none", "clash"))
    return s.createDataFrame([(a, b, A.compare(CASES[a].compile(), CASES[b].compile())) for a, b in pairs], "a string, b string, relation string")


@query("fa_same_language", "SELECT * FROM (VALUES ('star', true), ('twice', true), ('other', false)) t(name, same)")
def fa_same_language(s, d):
    z = A.lit(2, 0)
    rows = [("star", A.same_language(A.star(A.star(z)), A.star(z))), ("twice", A.same_language(A.comp(A.comp(z)), z)), ("other", A.same_language(z, A.plus(z)))]
    return s.createDataFrame(rows, "name string, same boolean")


GRAPH = [(0, 0, 1), (1, 0, 2), (2, 1, 0), (2, 0, 3), (3, 1, 4), (4, 0, 3), (4, 1, 5)]
GRAPH_SQL = "SELECT * FROM (VALUES " + ", ".join(map(str, GRAPH)) + ") t(src, sym, dst)"


def graph() -> A.Automaton:
    x = A.Automaton(2, [{} for _ in range(6)], [5])
    for e in GRAPH:
        x.add(*e)
    return x


@query("fa_scc", f"""WITH RECURSIVE e AS ({GRAPH_SQL}), s AS (SELECT src AS x FROM e UNION SELECT dst FROM e), r(a, b) AS (SELECT x, x FROM s UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
    SELECT r.a AS state, min(r.b) AS component FROM r JOIN r q ON q.a = r.b AND q.b = r.a GROUP BY r.a""")  # fmt: skip
def fa_scc(s, d):
    return s.createDataFrame([(x, min(c)) for c in graph().components() for x in c], "state int, component int")


@query("fa_stats", f"SELECT 6 AS states, 1 AS accepting, CAST(count(DISTINCT (src, dst)) AS INTEGER) AS edges, CAST(count(*) AS INTEGER) AS transitions FROM ({GRAPH_SQL})")
def fa_stats(s, d):
    st = graph().stats()
    return s.createDataFrame([tuple(st.values())], "states int, accepting int, edges int, transitions int")


@query("fa_permute", f"SELECT CAST(src AS INTEGER) AS src, CAST(1 - sym AS INTEGER) AS sym, CAST(dst AS INTEGER) AS dst FROM ({GRAPH_SQL})")
def fa_permute(s, d):
    return s.createDataFrame(list(graph().map_symbols({0: 1, 1: 0}).edges()), "src int, sym int, dst int")


# gadgets

WIRE, DIODE = G.from_edges([(0, 0, 1, 0), (0, 1, 0, 0)]), G.from_edges([(0, 0, 1, 0)])


def splits(k: int) -> bytes:
    u = gen.split(k)
    return G.from_edges([*u, *(e[::-1] for e in u)])


def gadget_table(s, made: dict[str, bytes]):
    return s.createDataFrame([(k, bytearray(b)) for k, b in enumerate(made.values(), 1)], "id long, enc binary")


#: Two one-way passages side by side; and three, of which the second leads back against the first.
TWO, THREE = G.from_edges([(0, 0, 1, 0), (0, 2, 3, 0)]), G.from_edges([(0, 0, 1, 0), (0, 3, 2, 0), (0, 4, 5, 0)])
NAMED = {"wire": WIRE, "diode": DIODE, **{f"{k}-split": splits(k) for k in (3, 4, 5)}}


def called(enc):
    """Names of known gadgets."""
    out = F.lit("other")
    for name, b in NAMED.items():
        out = F.when(enc == F.lit(bytearray(b)), name).otherwise(out)
    return out


@query("gadget_connect", "SELECT * FROM (VALUES ('4-split', 'wire', 4), ('5-split', '3-split', 5)) t(source, made, n)")
def gadget_connect(s, d):
    g = gadget_table(s, NAMED)
    made = gadget_ops.operate(g, "connect").join(g.select(F.col("id").alias("in1"), F.col("enc").alias("e")), "in1")
    return made.groupBy(called(F.col("e")).alias("source"), called(F.col("enc")).alias("made")).agg(F.count("*").cast("int").alias("n"))


def listed(enc):
    """The edges of gadgets in canonical order as text, undirected ones first."""

    def text(encs: pa.Array) -> pa.Array:
        out = []
        for e in encs.to_pylist():
            _, _, u, w = G.decode_edges(e)
            out.append("|".join(" ".join("%d%d%d%d" % x for x in es) for es in (sorted(u), sorted(w))))
        return pa.array(out, pa.string())

    text.__annotations__ = {"encs": pa.Array, "return": pa.Array}
    return F.arrow_udf(text, "string")(enc)


#: What closing and mirroring really change: a wire and a diode in a row, a toggle beside a wire, a chiral gadget.
ROW = G.from_edges([(0, 0, 1, 0), (0, 1, 2, 0), (0, 2, 1, 0)])
STEP = G.from_edges([(0, 0, 1, 1), (1, 1, 2, 0)])
CHIRAL = G.from_edges([(0, 0, 1, 0), (0, 1, 3, 1), (1, 2, 0, 0)])
SOURCES = {"row": ROW, "step": STEP, "chiral": CHIRAL, "wire": WIRE, "diode": DIODE}


@query("gadget_combine", GOLDEN["combine"])
def gadget_combine(s, d):
    g = gadget_table(s, {"wire": WIRE, "diode": DIODE, "step": STEP})
    made = gadget_ops.combine(g, g, most_locations=6)
    return made.groupBy("in1", "in2", listed(F.col("enc")).alias("made")).agg(F.count("*").cast("int").alias("n"))


@query("gadget_close", GOLDEN["close"])
def gadget_close(s, d):
    return gadget_ops.operate(gadget_table(s, SOURCES), "close").select("in1", listed(F.col("enc")).alias("made"))


@query("gadget_deleted", GOLDEN["deleted"])
def gadget_deleted(s, d):
    """Locations that vanish when two are joined."""
    g = gadget_table(s, {"two": TWO, "three": THREE, "diode": DIODE, "4-split": splits(4)})
    edges = gadget_ops.operate(g, "connect").unionByName(gadget_ops.combine(g, g, most_locations=6))
    return gadget_ops.deleted(edges, g).where(F.size("deleted") > 0).select("kind", "in1", "in2", "splice", "rotation", "point", F.array_join(F.transform("deleted", lambda x: x.cast("string")), ",").alias("deleted"))


@query("gadget_mirror", "SELECT 'mirror' AS kind, CAST(1 AS BIGINT) AS in1")
def gadget_mirror(s, d):
    """Of a chiral gadget and a wire only the first differs from its image."""
    chiral = G.from_edges([(0, 0, 1, 0), (0, 1, 3, 1), (1, 2, 0, 0)])
    return gadget_ops.operate(gadget_table(s, {"chiral": chiral, "wire": WIRE}), "mirror").select("kind", "in1")


@query("gadget_stats", "SELECT * FROM (VALUES ('wire', 2, 1, 1, 0, 1), ('diode', 2, 1, 0, 1, 1), ('3-split', 3, 1, 3, 0, 1), ('4-split', 4, 1, 6, 0, 1), ('5-split', 5, 1, 10, 0, 1)) t(name, locations, states, uedges, dedges, components)")
def gadget_stats(s, d):
    return gadget_ops.with_stats(gadget_table(s, NAMED)).select(called(F.col("enc")).alias("name"), "locations", "states", "uedges", "dedges", "components")


@query("gadget_search", GOLDEN["search"])
def gadget_search(s, d):
    """Everything that 3-splits and diodes build within 6 locations and two generations."""
    found, _ = gadget_ops.search(gadget_table(s, {"3-split": splits(3), "diode": DIODE}).select("enc"), precision=6, stop_after=2)
    return found.select(listed(F.col("enc")).alias("edges"), "generation")


# generators

BRACELET_SQL = """WITH b AS (SELECT z, i, (i >> p) & 1 AS x, p FROM (SELECT z, i FROM range(3, 9) s(z), range(256) v(i) WHERE i < (1 << z)) JOIN range(9) q(p) ON p < z),
    t AS (SELECT z, i, r, m, string_agg(CAST(x AS VARCHAR), '' ORDER BY (CASE WHEN m = 0 THEN p ELSE z - 1 - p END + z - r) % z) AS w FROM b JOIN range(9) k(r) ON r < z, range(2) f(m) GROUP BY z, i, r, m)
    SELECT DISTINCT CAST(z AS INTEGER) AS size, min(w) AS word FROM t GROUP BY z, i"""  # fmt: skip


@query("gen_bracelets", BRACELET_SQL)
def gen_bracelets(s, d):
    return s.createDataFrame([(z, "".join(map(str, b))) for z in range(3, 9) for b in gen.bracelets(z)], "size int, word string")


@query("gen_mixers", f"SELECT size AS locations, CAST(count(*) AS INTEGER) AS n, CAST(sum(o * (size - o)) AS INTEGER) AS edges FROM (SELECT size, length(replace(word, '0', '')) AS o FROM ({BRACELET_SQL}) WHERE size >= 4) WHERE o >= 2 AND size - o >= 2 GROUP BY size")
def gen_mixers(s, d):
    rows = [(z, len(m := gen.mixers([z])), sum(map(len, m.values()))) for z in range(4, 9)]
    return s.createDataFrame(rows, "locations int, n int, edges int")


@query("gen_fan", "SELECT d || '-fanin' AS name, CAST(i AS INTEGER) AS a, 0 AS b FROM range(3, 17) x(d), range(1, 17) y(i) WHERE i < d UNION ALL SELECT d || '-fanout', 0, CAST(i AS INTEGER) FROM range(3, 17) x(d), range(1, 17) y(i) WHERE i < d")
def gen_fan(s, d):
    return s.createDataFrame([(k, e[1], e[2]) for k, es in gen.fans().items() for e in es], "name string, a int, b int")


@query("gen_splits", "SELECT CAST(z AS INTEGER) AS n, CAST(i AS INTEGER) AS a, CAST(j AS INTEGER) AS b FROM range(3, 17) x(z), range(16) y(i), range(16) w(j) WHERE i < j AND j < z")
def gen_splits(s, d):
    return s.createDataFrame([(z, e[1], e[2]) for z in range(3, 17) for e in gen.split(z)], "n int, a int, b int")


@query("gen_spinners", "SELECT CAST(z AS INTEGER) AS n, CAST(i AS INTEGER) AS a, CAST((i + 1) % z AS INTEGER) AS b FROM range(3, 17) x(z), range(16) y(i) WHERE i < z")
def gen_spinners(s, d):
    return s.createDataFrame([(z, e[1], e[2]) for z in range(3, 17) for e in gen.spinner(z)], "n int, a int, b int")


#: Layouts of the ports of doors as digits, and whether they have a traverse line: orders of each set of labels, least of all images.
LAYOUT_SQL = """WITH RECURSIVE sets(rest) AS (SELECT o || t || c FROM (VALUES ('00'), ('12'), ('0')) x(o), (VALUES (''), ('33'), ('45')) y(t), (VALUES ('66'), ('78')) z(c)),
    p(rest, made) AS (SELECT rest, '' FROM sets UNION SELECT substr(rest, 1, k - 1) || substr(rest, k + 1), made || substr(rest, k, 1) FROM (SELECT rest, made, unnest(range(1, length(rest) + 1)) AS k FROM p WHERE rest <> '')),
    i AS (SELECT made, unnest([w, reverse(w)]) AS v, r FROM (SELECT made, made AS w FROM p WHERE rest = ''), range(6) t(r) WHERE r < length(made))
    SELECT DISTINCT min(substr(v, r + 1) || substr(v, 1, r)) AS layout FROM i GROUP BY made"""  # fmt: skip
#: Edges of all doors by the rules of door().
DOOR_SQL = f"""WITH lay AS ({LAYOUT_SQL}),
    n AS (SELECT layout, line, CAST(CASE WHEN contains(layout, line) THEN strpos(layout, line) - 1 ELSE strpos(layout, way_in) - 1 END AS INTEGER) AS a,
        CAST(CASE WHEN contains(layout, line) THEN length(layout) - strpos(reverse(layout), line) ELSE strpos(layout, way_out) - 1 END AS INTEGER) AS b, NOT contains(layout, line) AS dir
        FROM lay, (VALUES ('0', '1', '2'), ('3', '4', '5'), ('6', '7', '8')) x(line, way_in, way_out) WHERE contains(layout, line) OR contains(layout, way_in)),
    shape AS (SELECT layout, bool_or(line = '3') AS tr, bool_or(line = '0' AND a = b) AS one FROM n GROUP BY layout),
    v AS (SELECT layout, o, c, d FROM shape, range(3) x(o), range(3) y(c), range(1, 6) z(d) WHERE CASE
        WHEN tr AND NOT one THEN d = 1 WHEN tr THEN d = 1 AND o = 0 WHEN one THEN o = 0 AND c = 1
        ELSE (c = 1 AND o < 2) OR (d = 1 AND o + c >= 3) END),
    e AS (SELECT v.*, line, a, b, dir, CASE line WHEN '0' THEN o WHEN '6' THEN c ELSE 0 END AS sign FROM v JOIN n USING (layout)),
    name AS (SELECT layout, o, c, d, 'door-' || string_agg(CASE WHEN sign = 2 THEN 'o' ELSE '' END || CASE WHEN sign > 0 THEN 's' ELSE '' END || CASE WHEN dir THEN 'd' ELSE '' END || a || CASE WHEN a = b THEN 'x' ELSE CAST(b AS VARCHAR) END, '' ORDER BY line) || CASE WHEN d > 1 THEN '-closedelay' || d ELSE '' END AS name FROM e GROUP BY layout, o, c, d),
    w AS (SELECT *, a AS f, b AS g FROM e UNION ALL SELECT *, b, a FROM e WHERE NOT dir AND a <> b),
    moves AS (SELECT layout, o, c, d, s, f AS a, g AS b, 0 AS t, NOT (s = 0 AND a = b) AS directed FROM w, range(7) x(s) WHERE line = '0' AND s <= d AND (o = 0 OR s = d)
        UNION ALL SELECT layout, o, c, d, s, f, g, s + 1, true FROM w, range(7) x(s) WHERE line = '6' AND s < d),
    stays AS (SELECT layout, o, c, d, s, a, b, s, dir FROM e, range(7) x(s) WHERE s <= d AND CASE line WHEN '0' THEN o = 2 AND s = d WHEN '3' THEN s < d ELSE (s < d AND c = 2) OR (s = d AND c = 0) END)
    SELECT name, CAST(s AS INTEGER) AS s, a, b, CAST(t AS INTEGER) AS t, directed FROM (SELECT * FROM moves UNION ALL SELECT * FROM stays) JOIN name USING (layout, o, c, d)"""  # fmt: skip


@query("gen_door_layouts", LAYOUT_SQL)
def gen_door_layouts(s, d):
    return s.createDataFrame([("".join(map(str, x)),) for shape in gen.DOORS for x in gen.door_layouts(*shape)], "layout string")


@query("gen_doors", DOOR_SQL)
def gen_doors(s, d):
    rows = [(x["name"], *e, way) for x in gen.doors() for way, es in ((False, x["uedges"]), (True, x["dedges"])) for e in es]
    return s.createDataFrame(rows, "name string, s int, a int, b int, t int, directed boolean")


@query("gen_io", """WITH tun(k, kind, outs, effect) AS (VALUES (0, 'diupwire', 1, 'up'), (1, 'didownwire', 1, 'down'), (2, 'ditripwire', 1, 'trip'), (3, 'point', 2, NULL), (4, 'uppoint', 2, 'up'), (5, 'downpoint', 2, 'down'), (6, 'trippoint', 2, 'trip')),
    cfg(i1, i2, o1, o2) AS (VALUES (0, 1, 2, 3), (0, 2, 1, 3)),
    aim AS (SELECT i1, i2, n, x, CASE WHEN n = 2 THEN o1 + o2 - x END AS y FROM cfg, range(1, 3) t(n), (VALUES (true), (false)) f(first), LATERAL (SELECT CASE WHEN first THEN o1 ELSE o2 END) l(x)),
    g AS (SELECT p.i1, p.i2, l.kind AS k1, r.kind AS k2, l.effect AS e1, r.effect AS e2, l.outs - 1 AS b1, r.outs - 1 AS b2, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2
        FROM tun l JOIN tun r ON l.k <= r.k JOIN aim p ON p.n = l.outs JOIN aim q ON q.n = r.outs AND q.i2 = p.i2
        WHERE l.outs + r.outs > 2 AND coalesce(l.effect, r.effect) IS NOT NULL
        AND coalesce(CASE WHEN l.effect <> 'trip' THEN l.effect END, CASE WHEN r.effect <> 'trip' THEN r.effect END, '') <> 'down' AND (p.y IS NOT NULL OR q.y IS NOT NULL OR p.x <> q.x)),
    st AS (SELECT *, CAST(s AS INTEGER) AS st, (1 << (b1 + b2)) - 1 AS top, i1 || x1::VARCHAR || coalesce(y1::VARCHAR, '') || '-' || k1 || '-' || i2 || x2::VARCHAR || coalesce(y2::VARCHAR, '') || '-' || k2 AS name FROM g, range(4) r(s) WHERE s < (1 << (b1 + b2)))
    SELECT name, st AS s, CAST(i1 AS INTEGER) AS a, CAST(CASE WHEN b1 = 1 AND (st >> b2) & 1 = 1 THEN y1 ELSE x1 END AS INTEGER) AS b, CAST(CASE e1 WHEN 'up' THEN 0 WHEN 'down' THEN top WHEN 'trip' THEN xor(st, top) ELSE st END AS INTEGER) AS t FROM st
    UNION ALL SELECT name, st, i2, CASE WHEN b2 = 1 AND st & 1 = 1 THEN y2 ELSE x2 END, CASE e2 WHEN 'up' THEN 0 WHEN 'down' THEN top WHEN 'trip' THEN xor(st, top) ELSE st END FROM st""")  # fmt: skip
def gen_io(s, d):
    rows = [(name, *e) for shape in gen.io_shapes(4) for name, edges, _ in gen.io_gadgets(*shape) for e in edges]
    return s.createDataFrame(rows, "name string, s int, a int, b int, t int")


# puzzles

def _line_sql(clue, cells):
    pattern = "0*" + "0+".join("1" * c for c in clue) + "0*"
    return f"regexp_full_match(concat({', '.join(f'substr(g, {c + 1}, 1)' for c in cells)}), '{pattern}')"


@query("puzzle_nonogram", "SELECT g AS grid FROM (SELECT lpad(to_base(v, 2), 16, '0') AS g FROM range(65536) t(v)) WHERE " + " AND ".join([_line_sql(c, range(4 * k, 4 * k + 4)) for k, c in enumerate([[1, 1], [2], [1], [2]])] + [_line_sql(c, range(k, 16, 4)) for k, c in enumerate([[1], [2], [1, 1], [1, 1]])]))
def puzzle_nonogram(s, d):
    p = puzzles.Nonogram([[1, 1], [2], [1], [2]], [[1], [2], [1, 1], [1, 1]])
    return s.createDataFrame([("".join(map(str, g)),) for g in p.solutions()], "grid string")


@query("puzzle_path", """WITH RECURSIVE w(path, pos, used) AS (SELECT '0', 0, 1 UNION ALL SELECT path || ',' || t, t, used | (1 << t) FROM (SELECT path, pos, used, unnest([pos - 3, pos + 3, CASE WHEN pos % 3 > 0 THEN pos - 1 END, CASE WHEN pos % 3 < 2 THEN pos + 1 END]) AS t FROM w WHERE pos <> 8) WHERE t BETWEEN 0 AND 8 AND (used >> t) & 1 = 0)
    SELECT path FROM w WHERE pos = 8 AND bit_count(used & 7) = 3 AND bit_count(used & 73) = 2""")  # fmt: skip
def puzzle_path(s, d):
    p = puzzles.PathPuzzle([3, None, None], [2, None, None], [(0, 0), (2, 2)])
    return s.createDataFrame([(",".join(map(str, w)),) for w in p.solutions()], "path string")


@query("puzzle_walks", """WITH RECURSIVE w(path, pos, used, n) AS (SELECT '0', 0, 1, 1 UNION ALL SELECT path || ',' || t, t, used | (1 << t), n + 1 FROM (SELECT path, pos, used, n, unnest([pos - 4, pos + 4, CASE WHEN pos % 4 > 0 THEN pos - 1 END, CASE WHEN pos % 4 < 3 THEN pos + 1 END]) AS t FROM w WHERE pos <> 11) WHERE t BETWEEN 0 AND 11 AND (used >> t) & 1 = 0)
    SELECT path, n AS length FROM w WHERE pos = 11""")
def puzzle_walks(s, d):
    """All paths between two corners of a grid, from a table function."""
    return tables.Paths(F.lit(3), F.lit(4), F.lit(0), F.lit(11))


@query("puzzle_ways", "SELECT clue, CAST(count(*) AS INTEGER) AS ways FROM (VALUES ('1,1', '0*10+10*'), ('2', '0*110*'), ('1,2,1', '0*10+110+10*')) c(clue, pattern), (SELECT lpad(to_base(v, 2), 8, '0') AS g FROM range(256) t(v)) WHERE regexp_full_match(g, pattern) GROUP BY clue")
def puzzle_ways(s, d):
    return s.createDataFrame([(",".join(map(str, c)), puzzles.line_ways(c, 8)) for c in ([1, 1], [2], [1, 2, 1])], "clue string, ways int")

