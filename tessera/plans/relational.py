"""Queries over intervals, predicates, completions, edges, searches and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import bits, codec
from ..operators import gadget_ops
from ..operators import intervals as iv
from ..operators import relations as rel
from ..operators import search
from ..operators.fixpoint import work_dir
from .base import EDGES, flagged, islands_sql, query, supply_edges, table

A, N, R = (f"SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS id FROM lineitem WHERE l_returnflag = '{f}'" for f in "ANR")
SPANS = "SELECT l_orderkey AS lo, l_orderkey + l_linenumber AS hi FROM lineitem WHERE l_returnflag = 'R'"


def sets(s, d, *flags):
    return [iv.islands(flagged(s, d, f)) for f in flags]


@query("iv_maximal", islands_sql(A))
def iv_maximal(s, d):
    return iv.islands(flagged(s, d, "A"))


@query("iv_coalesce", f"""WITH p AS ({SPANS}), b AS (SELECT lo, hi, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
    g AS (SELECT lo, hi, sum(CASE WHEN before >= lo THEN 0 ELSE 1 END) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT min(lo) AS lo, max(hi) AS hi FROM g GROUP BY run""")  # fmt: skip
def iv_coalesce(s, d):
    lines = table(s, d, "lineitem").where("l_returnflag = 'R'")
    return iv.coalesce(lines.select(F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("hi")))


@query("iv_union", islands_sql(f"({A}) UNION ({R})"))
def iv_union(s, d):
    return iv.union(*sets(s, d, "A", "R"))


@query("iv_intersection", islands_sql(f"({A}) INTERSECT ({R})"))
def iv_intersection(s, d):
    return iv.intersection(*sets(s, d, "A", "R"))


@query("iv_difference", islands_sql(f"({A}) EXCEPT ({R})"))
def iv_difference(s, d):
    return iv.difference(*sets(s, d, "A", "R"))


@query("iv_merge_n", islands_sql(f"({A}) UNION ({R}) UNION ({N})"))
def iv_merge_n(s, d):
    return iv.union(*sets(s, d, "A", "R", "N"))


@query("iv_inflate", A)
def iv_inflate(s, d):
    return iv.inflate(*sets(s, d, "A"))


@query("iv_size", f"SELECT count(*) AS size FROM ({A})")
def iv_size(s, d):
    return iv.size(*sets(s, d, "A"))


@query("iv_chunk", islands_sql(f"SELECT (row_number() OVER (ORDER BY id) - 1) // 1000 AS chunk, id FROM ({A})", "chunk"))
def iv_chunk(s, d):
    return iv.chunks(sets(s, d, "A")[0], 1000)


@query("iv_contains", f"SELECT c_custkey AS id, c_custkey IN ({A}) AS contained FROM customer")
def iv_contains(s, d):
    return iv.contains(table(s, d, "customer").select(F.col("c_custkey").alias("id")), *sets(s, d, "A"))


@query("iv_overlap", f"""WITH k AS (SELECT p_brand AS key, p_partkey AS id FROM part), w AS (SELECT DISTINCT key, id + t AS id FROM k, (SELECT 0 AS t UNION ALL SELECT 1) WHERE (key < 'Brand#3') OR t = 0),
    i AS ({islands_sql("SELECT * FROM w", "key")}), n AS (SELECT DISTINCT key FROM k), p AS (SELECT x.key AS a, y.key AS b FROM n x, n y WHERE x.key < y.key),
    o AS (SELECT DISTINCT x.key AS a, y.key AS b FROM w x JOIN w y ON x.id = y.id WHERE x.key < y.key),
    t AS (SELECT x.key AS a, y.key AS b FROM i x JOIN i y ON x.hi = y.lo UNION SELECT y.key, x.key FROM i x JOIN i y ON x.hi = y.lo)
    SELECT a, b, CASE WHEN (a, b) IN (SELECT (a, b) FROM o) THEN 'overlap' WHEN (a, b) IN (SELECT (a, b) FROM t) THEN 'adjacent' ELSE 'separate' END AS state FROM p""")  # fmt: skip
def iv_overlap(s, d):
    k = table(s, d, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("id"))
    wide = k.select("key", F.col("id").alias("lo"), (F.col("id") + F.when(F.col("key") < "Brand#3", 2).otherwise(1)).alias("hi"))
    n = k.select("key").distinct()
    pairs = n.select(F.col("key").alias("a")).join(n.select(F.col("key").alias("b")), F.col("a") < F.col("b"))
    return iv.overlap(pairs, wide)


@query("iv_aggregate", islands_sql("SELECT id, string_agg(key, ',' ORDER BY key) AS keys FROM (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS id, l_returnflag AS key FROM lineitem) GROUP BY id", "keys"))
def iv_aggregate(s, d):
    return iv.by_key_set(table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("key")).distinct())


def parts(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_size")


def part_set(condition):
    return islands_sql(f"SELECT p_partkey AS id FROM part WHERE {condition}")


@query("pred_le", part_set("p_size <= 20"))
def pred_le(s, d):
    return iv.islands(rel.at_most(parts(s, d), F.col("p_size"), 20).select("id"))


@query("pred_range", part_set("p_size > 10 AND p_size <= 30"))
def pred_range(s, d):
    return iv.islands(rel.in_range(parts(s, d), F.col("p_size"), 10, 30).select("id"))


@query("pred_equal", part_set("p_size = 7"))
def pred_equal(s, d):
    return iv.islands(rel.in_range(parts(s, d), F.col("p_size"), 6, 7).select("id"))


@query("pred_min_max", islands_sql("SELECT p_partkey AS id FROM part WHERE p_size >= 5 AND p_size <= 40 AND p_size % 7 + p_size % 5 <= 6 AND p_size % 7 >= 1"))
def pred_min_max(s, d):
    stats = parts(s, d).select("id", F.col("p_size").alias("locations"), (F.col("p_size") % 7).alias("uedges"), (F.col("p_size") % 5).alias("dedges"))
    return iv.islands(rel.apply_bounds(stats, {"locations": 5, "uedge": 1}, {"location": 40, "edges": 6}).select("id"))


@query("pred_all_k", islands_sql("SELECT k, p_partkey AS id FROM part JOIN (SELECT DISTINCT p_size AS k FROM part) ON p_size <= k", "k"))
def pred_all_k(s, d):
    return rel.thresholds(parts(s, d), F.col("p_size"))


@query("pred_incremental", part_set("p_size <= 25"))
def pred_incremental(s, d):
    p = parts(s, d)
    first = iv.islands(rel.at_most(p.where("id < 1000"), F.col("p_size"), 25).select("id"))
    return rel.extend(first, p.where("id >= 1000"), F.col("p_size"), 25)


@query("comp_subtract", f"({A}) EXCEPT ({R})")
def comp_subtract(s, d):
    return rel.without(flagged(s, d, "A"), flagged(s, d, "R"))


@query("comp_intersect", f"({A}) INTERSECT ({R})")
def comp_intersect(s, d):
    return rel.only(flagged(s, d, "A"), flagged(s, d, "R"))


@query("comp_record", f"WITH done AS ({A}), more AS (({R}) EXCEPT ({A})) SELECT 'disjoint' AS way, lo, hi FROM ({islands_sql('SELECT * FROM done UNION SELECT * FROM more')}) UNION ALL SELECT 'overlapping', lo, hi FROM ({islands_sql(f'({A}) UNION ({R})')})")
def comp_record(s, d):
    """Of inputs that were not complete before, which is checked; and of overlapping ones, which must be allowed."""
    done, more = sets(s, d, "A", "R")
    disjoint = rel.record(done, iv.difference(more, done))
    return disjoint.select(F.lit("disjoint").alias("way"), "lo", "hi").unionByName(rel.record(done, more, allow_overlap=True).select(F.lit("overlapping").alias("way"), "lo", "hi"))


@query("comp_compact", islands_sql(f"({A}) UNION ({R}) UNION ({N})"))
def comp_compact(s, d):
    return rel.compact(sets(s, d, "A", "R", "N"))


@query("comp_rebuild", islands_sql(f"SELECT kind, in1 AS id FROM ({EDGES})", "kind"))
def comp_rebuild(s, d):
    return rel.rebuild(supply_edges(s, d))


def seeds(s, d):
    return table(s, d, "supplier").where("s_suppkey < 5").select(F.col("s_suppkey").alias("id"))


@query("edge_follow", f"SELECT DISTINCT out AS id FROM ({EDGES}) WHERE in1 < 5")
def edge_follow(s, d):
    return rel.follow(seeds(s, d), supply_edges(s, d))


@query("edge_follow_inputs", f"SELECT DISTINCT 'input' AS side, in1 AS id FROM ({EDGES}) WHERE in1 < 5 UNION SELECT DISTINCT 'output', out FROM ({EDGES}) WHERE in1 < 5")
def edge_follow_inputs(s, d):
    return rel.follow_with_inputs(seeds(s, d), supply_edges(s, d))


@query("edge_skinny", f"SELECT DISTINCT kind, in1, out FROM ({EDGES})")
def edge_skinny(s, d):
    return rel.skinny(supply_edges(s, d))


@query("edge_point", f"SELECT kind, in1, out FROM ({EDGES}) WHERE in1 = 3")
def edge_point(s, d):
    return rel.of_input(supply_edges(s, d), 3)


@query("edge_first", f"SELECT arg_min(kind, (kind, out)) AS kind, in1, arg_min(out, (kind, out)) AS out FROM ({EDGES}) WHERE in1 < 5 GROUP BY in1")
def edge_first(s, d):
    return rel.first_edges(seeds(s, d), supply_edges(s, d))


@query("edge_ordered", f"SELECT kind, in1, out, row_number() OVER (ORDER BY out, kind, in1) AS place FROM ({EDGES})")
def edge_ordered(s, d):
    """The place of each edge in backward order, from the sorted ranges."""
    return rel.dense_rank_by(rel.ordered(supply_edges(s, d), backwards=True), ["out", "kind", "in1"]).select("kind", "in1", "out", F.col("rank").alias("place"))


@query("edge_pages", f"SELECT DISTINCT kind, in1, out FROM ({EDGES})")
def edge_pages(s, d):
    """Skinny pages, written and read back."""
    path = f"{work_dir(s)}/pages-{uuid.uuid4().hex}"
    rel.write_skinny(supply_edges(s, d), path)
    return s.read.schema("in1 long, out long, kind string").parquet(path).select("kind", "in1", "out")


@query("edge_inverted_file", f"SELECT DISTINCT out, in1 FROM ({EDGES})")
def edge_inverted_file(s, d):
    """The inverted file in small blocks, written and read back."""
    path = f"{work_dir(s)}/inverted-{uuid.uuid4().hex}"
    rel.write_inverted(supply_edges(s, d), path, block=16)
    return rel.read_inverted(s, path)


@query("edge_incoming", f"SELECT kind, in1, out FROM ({EDGES}) WHERE out < 5")
def edge_incoming(s, d):
    return rel.incoming(supply_edges(s, d), seeds(s, d))


@query("edge_invert", f"SELECT out, count(*) AS n, string_agg(CAST(in1 AS VARCHAR), ',' ORDER BY in1) AS ins FROM (SELECT DISTINCT in1, out FROM ({EDGES})) GROUP BY out")
def edge_invert(s, d):
    return rel.inverted(supply_edges(s, d))


@query("comp_needs", """WITH l AS (SELECT DISTINCT l_suppkey AS id FROM lineitem), r AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey < 4), done AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem),
    o AS (SELECT l.id, string_agg(CAST(r.id AS VARCHAR), ',' ORDER BY r.id) AS rights FROM l, r WHERE NOT EXISTS (SELECT 1 FROM done WHERE a = l.id AND b = r.id) GROUP BY l.id) """ + islands_sql("SELECT * FROM o", "rights"))
def comp_needs(s, d):
    return rel.needs(*supply_needs(s, d))


@query("comp_needs_sizes", """WITH l AS (SELECT DISTINCT l_suppkey AS id FROM lineitem), r AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey < 4)
    SELECT count(DISTINCT l.id) AS lefts, count(*) AS pairs FROM l, r WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = l.id AND l_partkey = r.id)""")
def comp_needs_sizes(s, d):
    return rel.needs_sizes(rel.needs(*supply_needs(s, d)))


def supply_needs(s, d):
    """Suppliers as lefts, four of them as rights; what lines have is done."""
    done = table(s, d, "lineitem").select(F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("right"))
    return done.select(F.col("left").alias("id")).distinct(), done, table(s, d, "supplier").where("s_suppkey < 4").select(F.col("s_suppkey").alias("id"))


@query("stat_merge", "SELECT l_returnflag AS operation, CAST(sum(l_linenumber) AS BIGINT) AS novel, CAST(count(*) AS BIGINT) AS edges FROM lineitem GROUP BY 1")
def stat_merge(s, d):
    tasks = table(s, d, "lineitem").select(F.col("l_returnflag").alias("operation"), F.col("l_linenumber").alias("novel"), F.lit(1).alias("edges"))
    return rel.merged_statistics(tasks, ["operation"])


PAIRS = "SELECT min(a.doc_id) AS a, min(b.doc_id) AS b FROM documents a JOIN documents b ON a.text = b.text WHERE a.source = 'src0' AND b.source <> 'src0' GROUP BY a.text"


def two_sources(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return docs.where("source = 'src0'"), docs.where("source <> 'src0'")


@query("edge_equiv", PAIRS)
def edge_equiv(s, d):
    return rel.equivalent(*two_sources(s, d), "text")


@query("edge_equiv_map", f"SELECT b AS id FROM ({PAIRS}) WHERE a % 2 = 0")
def edge_equiv_map(s, d):
    l, r = two_sources(s, d)
    return rel.mapped(l.where("id % 2 = 0").select("id"), rel.equivalent(l, r, "text"))


STEPS = f"""WITH RECURSIVE e AS ({EDGES}), r(id, step) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.out, r.step + 1 FROM r JOIN e ON e.in1 = r.id WHERE r.step < 30),
    m AS (SELECT id, min(step) AS step FROM r GROUP BY id)"""  # fmt: skip


def one(s):
    return s.createDataFrame([(1,)], "id long")


@query("search_closure", islands_sql(f"WITH RECURSIVE e AS ({EDGES}), r(id) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.out FROM r JOIN e ON e.in1 = r.id) SELECT id FROM r"))
def search_closure(s, d):
    return iv.islands(search.closure(one(s), supply_edges(s, d)).select("id"))


@query("search_steps", f"{STEPS} SELECT id, step FROM m")
def search_steps(s, d):
    return search.closure(one(s), supply_edges(s, d)).select("id", "step")


@query("search_inverse", STEPS.replace("e.out, r.step", "e.in1, r.step").replace("ON e.in1 = r.id", "ON e.out = r.id") + " SELECT id, step FROM m")
def search_inverse(s, d):
    return search.inverse(one(s), supply_edges(s, d)).select("id", "step")


@query("search_provenance", f"""{STEPS} SELECT m.id, m.step, arg_min(e.kind, (e.kind, e.in1)) AS kind, arg_min(e.in1, (e.kind, e.in1)) AS source
    FROM m LEFT JOIN (e JOIN m AS p ON p.id = e.in1) ON e.out = m.id AND p.step = m.step - 1 GROUP BY m.id, m.step""")  # fmt: skip
def search_provenance(s, d):
    return search.closure(one(s), supply_edges(s, d))


@query("search_multi_kind", f"WITH RECURSIVE e AS ({EDGES}), r(id) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.out FROM r JOIN e ON e.in1 = r.id) SELECT id FROM r")
def search_multi_kind(s, d):
    return search.by_priority(one(s), supply_edges(s, d), ["close", "connect", "combine"]).select("id")


#: Parts of size 25 at most have names; the rest can only be found as what closing makes of a named part.
NAMED = "SELECT p_name AS name, p_partkey AS id FROM part WHERE p_size <= 25"


@query("search_report", f"""WITH RECURSIVE e AS ({EDGES}), r(id) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.out FROM r JOIN e ON e.in1 = r.id),
    one AS (SELECT name, min(id) AS id FROM ({NAMED}) GROUP BY name HAVING count(DISTINCT id) = 1),
    closed AS (SELECT out AS id, min(in1) AS of FROM e WHERE kind = 'close' AND in1 IN (SELECT id FROM one) AND out NOT IN (SELECT id FROM one) GROUP BY out),
    aims AS (SELECT DISTINCT id, id AS of, '' AS suffix FROM one WHERE id <> 1 UNION ALL SELECT id, of, 'closed' FROM closed)
    SELECT aims.id, one.name, aims.suffix FROM aims JOIN r ON r.id = aims.id JOIN one ON one.id = aims.of""")  # fmt: skip
def search_report(s, d):
    named = table(s, d, "part").where("p_size <= 25").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return search.report(one(s), supply_edges(s, d), named)[0]


@query("search_trace", f"""{STEPS}, p AS (SELECT m.id, m.step, arg_min(e.in1, (e.kind, e.in1)) AS source FROM m LEFT JOIN (e JOIN m AS q ON q.id = e.in1) ON e.out = m.id AND q.step = m.step - 1 GROUP BY m.id, m.step),
    t(id) AS (SELECT id FROM p WHERE id % 50 = 7 UNION SELECT p.source FROM t JOIN p ON p.id = t.id WHERE p.source IS NOT NULL) SELECT p.id, p.step, p.source FROM p JOIN t ON t.id = p.id""")  # fmt: skip
def search_trace(s, d):
    """How a fiftieth of all ids is reached, which are the targets asked for."""
    found = search.closure(one(s), supply_edges(s, d))
    return search.traces(found, found.where("id % 50 = 7").select("id")).select("id", "step", "source")


@query("search_generation", """WITH RECURSIVE r(id, generation) AS (SELECT s_suppkey, CAST(0 AS BIGINT) FROM supplier WHERE s_suppkey < 5
    UNION SELECT (7 * r.id + b.s_suppkey) % 997, generation + 1 FROM r, (SELECT s_suppkey FROM supplier WHERE s_suppkey < 5) b WHERE generation < 4)
    SELECT id, min(generation) AS generation FROM r GROUP BY id""")  # fmt: skip
def search_generation(s, d):
    pair = lambda l, base: l.select(F.col("id").alias("l")).join(F.broadcast(base), F.lit(True)).select(((7 * F.col("l") + F.col("id")) % 997).alias("id"))  # noqa: E731  five seeds
    return search.generations(seeds(s, d), pair, 4)


@query("store_selsert", """WITH t AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0))
    SELECT sha256(text) AS content, row_number() OVER (ORDER BY length(text), text) + (SELECT max(doc_id) FROM documents WHERE doc_id % 2 = 0) AS id FROM t""")  # fmt: skip
def store_selsert(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    store = docs.where("id % 2 = 0").groupBy("text").agg(F.max("id").alias("id"))
    return rel.selsert(store, docs.where("id % 2 = 1"), "text", [F.length("text")]).select(F.sha2("text", 256).alias("content"), "id")


@query("store_hashes", "SELECT doc_id AS id, true AS same FROM documents")
def store_hashes(s, d):
    """Sorted hash files, written, read back and held against the contents."""
    docs, path = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), f"{work_dir(s)}/hashes-{uuid.uuid4().hex}"
    rel.write_hashes(docs, "text", path)
    back = s.read.schema("hash long, id long").parquet(path)
    return back.join(docs, "id").select("id", (F.col("hash") == F.xxhash64("text")).alias("same"))


@query("store_contents", "SELECT 'ids' AS way, doc_id AS id, sha256(text) AS content FROM documents WHERE doc_id IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'intervals', doc_id, sha256(text) FROM documents WHERE doc_id >= 10 AND doc_id < 60 OR doc_id >= 90 AND doc_id < 95")
def store_contents(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    spans = s.createDataFrame([(10, 60), (90, 95)], "lo long, hi long")
    ways = {"ids": table(s, d, "supplier").select(F.col("s_suppkey").alias("id")), "intervals": spans}
    made = [rel.contents(w, docs).select(F.lit(k).alias("way"), "id", F.sha2("text", 256).alias("content")) for k, w in ways.items()]
    return made[0].unionByName(made[1])


@query("pred_catalog", islands_sql("SELECT 'locations<=20' AS name, p_partkey AS id FROM part WHERE p_size <= 20 UNION ALL SELECT 'states<=30', p_partkey FROM part WHERE p_size <= 30", "name"))
def pred_catalog(s, d):
    """Indexes made over some objects, extended by the others, listed and read; one is made and deleted again."""
    stats = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("locations"), F.col("p_size").alias("states"))
    had = rel.Catalog(s, f"{work_dir(s)}/indexes-{uuid.uuid4().hex}")
    for name in ("locations<=20", "states<=30", "states<=5"):
        had.create(name, stats.where("id % 3 > 0"))
    had.delete("states<=5")
    made = [had.update(name, stats.where("id % 3 = 0")).select(F.lit(name).alias("name"), "lo", "hi") for name in had.names()]
    return made[0].unionByName(made[1])


@query("store_names", "SELECT name, count(DISTINCT id) AS n, min(id) AS least, count(DISTINCT id) = 1 AS single FROM (SELECT p_name AS name, p_partkey AS id FROM part UNION ALL SELECT p_brand, p_partkey FROM part) GROUP BY name")
def store_names(s, d):
    p = table(s, d, "part")
    return rel.names(p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id")).unionByName(p.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("id"))))


@query("store_gidspec", "SELECT CAST(unnest([5, 1, 2, 3, 4, 12, 13]) AS BIGINT) AS id UNION SELECT CAST(r_regionkey + 100 AS BIGINT) FROM region WHERE r_name = 'ASIA'")
def store_gidspec(s, d):
    named = table(s, d, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 100).alias("id"))
    return rel.ids_of(["5", "[1,5)", "(11, 13]", "ASIA"], named)


@query("store_sort", "SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size, p_brand, p_partkey) AS rank FROM part")
def store_sort(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_brand")
    return rel.dense_rank_by(p, ["p_size", "p_brand", "id"]).select("id", "rank")


VALUES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey * o_orderkey * o_custkey END AS v FROM orders"


def values(s, d, kind="long"):
    """As `decimal(20,0)` the products are exact up to 38 digits, beyond that an error; as longs an error beyond 63 bits."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wide = k.cast(kind)
    return table(s, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, wide).otherwise(wide * wide * c).alias("v"))


def fitted(s, d):
    """(values `v` with their words `x` and the lower 32 bits `w`, whether values are longs): as longs where all fit, as the SQL has
    them; else all exact decimals."""
    exact = values(s, d, "decimal(20,0)")
    top = exact.agg(F.max(F.abs("v"))).first()[0]
    longs = top is None or top < 1 << 63
    made = exact.withColumn("v", F.col("v").cast("long" if longs else "decimal(38,0)"))
    x = F.when(F.col("v").isNotNull(), F.array("v")) if longs else codec.words(F.col("v"))
    return made.withColumns({"x": x, "w": F.when(F.col("v").isNotNull(), F.array((F.col("v") % (1 << 32)).cast("long")))}), longs


@query("codec_varint_len", f"SELECT id, CASE {' '.join(f'WHEN v < {1 << 7 * k} THEN {k}' for k in range(1, 9))} ELSE 9 END AS n, CASE WHEN v <= 244 THEN 1 WHEN v <= 2291 THEN 2 WHEN v <= 67827 THEN 3 WHEN v <= 16777215 THEN 4 ELSE 5 END AS m FROM ({VALUES})")
def codec_varint_len(s, d):
    """Values that a form can't write count as its longest, as the ELSE of the SQL has it."""
    return values(s, d, "decimal(20,0)").select("id", codec.varint_length(F.col("v")).alias("n"), codec.varint32_length(F.col("v")).alias("m"))


@query("codec_varint_bytes", f"""WITH v AS ({VALUES}), n AS (SELECT id, v, v % 4294967296 AS w, CASE {' '.join(f'WHEN v < {1 << 7 * k} THEN {k}' for k in range(1, 9))} ELSE 9 END - 1 AS more FROM v),
    b AS (SELECT *, (length(to_binary(v)) + 7) // 8 AS bytes, (length(to_binary(w)) + 7) // 8 AS wide FROM n)
    SELECT id, lower(lpad(to_hex((((CAST(255 AS BIGINT) << (8 - more)) & 255) << (8 * more)) | v), 2 * more + 2, '0')) AS unary,
      lower(CASE WHEN v <= 240 THEN lpad(to_hex(v), 2, '0') WHEN v <= 2287 THEN lpad(to_hex((v - 240) // 256 + 241), 2, '0') || lpad(to_hex((v - 240) % 256), 2, '0')
        WHEN v <= 67823 THEN 'f9' || lpad(to_hex(v - 2288), 4, '0') ELSE lpad(to_hex(247 + bytes), 2, '0') || array_to_string(list_transform(range(bytes), lambda i: lpad(to_hex((v >> (8 * i)) & 255), 2, '0')), '') END) AS long,
      lower(CASE WHEN w <= 244 THEN lpad(to_hex(w), 2, '0') WHEN w <= 2291 THEN lpad(to_hex((w - 244) // 256 + 245), 2, '0') || lpad(to_hex((w - 244) % 256), 2, '0')
        WHEN w <= 67827 THEN 'fd' || lpad(to_hex(w - 2292), 4, '0') ELSE CASE WHEN wide <= 3 THEN 'fe' ELSE 'ff' END || array_to_string(list_transform(range(CASE WHEN wide <= 3 THEN 3 ELSE 4 END), lambda i: lpad(to_hex((w >> (8 * i)) & 255), 2, '0')), '') END) AS short
    FROM b""")  # fmt: skip
def codec_varint_bytes(s, d):
    """A value beyond 64 bits, which no form holds, has the bytes of its two words, the low one first."""
    hexed = lambda x, form: F.lower(F.hex(codec.varints(F.col(x), form)))
    return fitted(s, d)[0].select("id", hexed("x", "unary").alias("unary"), hexed("x", "64").alias("long"), hexed("w", "32").alias("short"))


@query("codec_varint_back", f"SELECT id, v, v % 4294967296 AS w FROM ({VALUES})")
def codec_varint_back(s, d):
    """All three forms, written and read again, side by side in one array. `v` is a long where all values fit, as in the SQL,
    else a `decimal(38,0)`, whose words are written."""
    made, longs = fitted(s, d)
    kind = "long" if longs else "decimal(20,0)"
    back = lambda x, form, kind: F.slice(codec.unvarints(codec.varints(F.concat(x, x), form), form, kind), F.size(x) + 1, F.size(x))
    read = made.select("id", back("x", "unary", kind).alias("a"), back("x", "64", kind).alias("b"), back("w", "32", "long").alias("c"))
    return read.select("id", F.when(F.col("a") == F.col("b"), F.get("a", F.lit(0)) if longs else codec.unwords(F.col("a"))).alias("v"), F.get("c", F.lit(0)).alias("w"))


@query("codec_delta", "SELECT l_orderkey AS k, l_partkey AS v, l_partkey - coalesce(lag(l_partkey) OVER w, 0) AS delta FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey)")
def codec_delta(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v")).distinct()
    # Decoded again by a running sum.
    return codec.undeltas(codec.deltas(lines, ["k"], "v").withColumnRenamed("v", "order"), ["k"], "order", name="v").drop("order")


BITSETS = "SELECT o_orderkey AS id, o_orderkey * 2654435761 % 281474976710656 AS x, CAST(o_custkey % 40 AS INTEGER) AS k FROM orders"


@query("codec_bits", f"""SELECT id, x | ((CAST(1 AS BIGINT) << 40) - (CAST(1 AS BIGINT) << 33)) AS put, x & ~(CAST(1 AS BIGINT) << k) AS cleared, xor(x, CAST(1 AS BIGINT) << k) AS flipped, (x >> k) & 1 = 1 AS has, CAST(bit_count(x) AS INTEGER) AS n,
    CASE WHEN x <> 0 THEN CAST(list_position(string_split(reverse(bin(x)), ''), '1') - 1 AS INTEGER) END AS first,
    CASE WHEN x >> (k + 1) <> 0 THEN CAST(list_position(string_split(reverse(bin(x >> (k + 1))), ''), '1') + k AS INTEGER) END AS following FROM ({BITSETS})""")  # fmt: skip
def codec_bits(s, d):
    """Bit sets: single bits and ranges set, cleared and flipped; members counted and looked up."""
    x, k = (F.col("o_orderkey") * 2654435761 % (1 << 48)), (F.col("o_custkey") % 40).cast("int")
    sets = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), x.alias("x"), k.alias("k"))
    x, k, one = F.col("x"), F.col("k"), bits.span(F.col("k"), F.col("k") + 1)
    return sets.select("id", bits.put(x, bits.span(33, 40)).alias("put"), bits.clear(x, one).alias("cleared"), bits.flip(x, one).alias("flipped"), bits.has(x, k).alias("has"), bits.count(x).alias("n"), bits.first(x).alias("first"), bits.following(x, k).alias("following"))


@query("codec_permutation", "SELECT o_orderkey AS id, concat(o_orderkey % 10, '-', o_custkey % 10, '-', o_orderkey % 7) AS plain, concat(o_orderkey % 7, '-', o_orderkey % 10, '-', o_custkey % 10) AS turned FROM orders")
def codec_permutation(s, d):
    """Three numbers turned by a permutation, and turned back."""
    order = F.array(F.lit(2), F.lit(0), F.lit(1))
    made = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_orderkey") % 10, F.col("o_custkey") % 10, F.col("o_orderkey") % 7).alias("v"))
    turned = made.select("id", bits.permuted(F.col("v"), order).alias("t"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "-")
    return turned.select("id", text(bits.unpermuted(F.col("t"), order)).alias("plain"), text(F.col("t")).alias("turned"))


@query("codec_slls", "SELECT DISTINCT l_linenumber % 4 AS s, l_orderkey % 6 AS a, l_partkey % 6 AS b, l_suppkey % 4 AS t, ((l_orderkey % 6 * 6 + l_partkey % 6) * 4 + l_linenumber % 4) * 4 + l_suppkey % 4 AS code FROM lineitem")
def codec_slls(s, d):
    e = table(s, d, "lineitem").select((F.col("l_linenumber") % 4).alias("s"), (F.col("l_orderkey") % 6).alias("a"), (F.col("l_partkey") % 6).alias("b"), (F.col("l_suppkey") % 4).alias("t")).distinct()
    return gadget_ops.uncoded(e.select(gadget_ops.edge_codes(6, 4).alias("code")), 6, 4)


@query("gadget_undirected", """WITH e AS (SELECT DISTINCT l_orderkey % 50 AS g, l_linenumber % 2 AS s, l_partkey % 4 AS a, l_suppkey % 4 AS b, CAST(l_quantity AS BIGINT) % 2 AS t FROM lineitem),
    n AS (SELECT * FROM e WHERE NOT (s = t AND a = b))
    SELECT g, s, a, b, t, EXISTS (SELECT 1 FROM n r WHERE r.g = n.g AND (r.s, r.a, r.b, r.t) = (n.t, n.b, n.a, n.s)) AS undirected FROM n""")  # fmt: skip
def gadget_undirected(s, d):
    e = table(s, d, "lineitem").select((F.col("l_orderkey") % 50).alias("g"), (F.col("l_linenumber") % 2).alias("s"), (F.col("l_partkey") % 4).alias("a"), (F.col("l_suppkey") % 4).alias("b"), (F.col("l_quantity").cast("long") % 2).alias("t")).distinct()
    return gadget_ops.split_edges(e, "g")
