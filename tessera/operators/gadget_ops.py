"""Gadget operations over tables of encoded gadgets: the kernel runs in Arrow batches, deduplication in Spark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gadgets as G
from . import relations
from .fixpoint import materialise

EDGE = "kind string, in1 long, in2 long, splice int, rotation int, point int, perm int, enc binary"


def operate(gadgets: DataFrame, kind: str) -> DataFrame:
    """Full edges of close, mirror or connect for each row (id, enc): (kind, in1, in2, splice, rotation, point, perm, enc)."""

    def run(batches):
        for batch in batches:
            out = []
            for i, enc in zip(batch.column("id").to_pylist(), batch.column("enc").to_pylist()):
                if kind == "connect":
                    out += [(kind, i, None, None, None, p, perm, made) for p, made, perm in G.connect(enc)]
                elif (made := (G.close if kind == "close" else G.mirror)(enc)) is not None:
                    out.append((kind, i, None, None, None, None, None, made))
            yield _batch(out)

    return gadgets.select("id", "enc").mapInArrow(run, EDGE)


#: Gadgets to combine with that a task holds at once; a larger pool is taken in blocks, one scan of the lefts for each.
BLOCK = 10_000


def locations(enc: Column) -> Column:
    """The number of locations of an encoded gadget, its first byte."""
    return F.conv(F.hex(F.substring(enc, 1, 1)), 16, 10).cast("int")


def combine(lefts: DataFrame, rights: DataFrame, most_locations: int = 16, block: int = BLOCK) -> DataFrame:
    """Full edges of combine for all pairs within most_locations. Lefts that fit no right don't reach the kernel; the pool of
    rights is sent to the tasks in blocks, each of which is a bounded number of gadgets."""
    spark = lefts.sparkSession
    pool = rights.select("id", "enc", locations(F.col("enc")).alias("n"))
    size, least = pool.agg(F.count(F.lit(1)), F.min("n")).first()
    blocks = max(1, -(-size // block))
    lefts = lefts.select("id", "enc").where(locations(F.col("enc")) <= most_locations - (least or 0))
    made = None
    for k in range(blocks):
        own = pool if blocks == 1 else pool.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(sorted((r["id"], bytes(r["enc"])) for r in own.collect()))

        def run(batches, shared=shared):
            for batch in batches:
                for i, enc in zip(batch.column("id").to_pylist(), batch.column("enc").to_pylist()):
                    for j, right in shared.value:
                        yield _batch([("combine", i, j, s, r, p, perm, made) for s, r, p, made, perm in G.combine(enc, right, most_locations)])

        some = lefts.mapInArrow(run, EDGE)
        made = some if made is None else made.unionByName(some)
    return made


def deleted(edges: DataFrame, store: DataFrame) -> DataFrame:
    """edges of connect and combine with `deleted`: the locations, numbered without the two joined, that vanish."""
    left = store.select(F.col("id").alias("_l"), F.col("enc").alias("_left"))
    right = store.select(F.col("id").alias("_r"), F.col("enc").alias("_right"))

    def find(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            if r["kind"] == "connect":
                out.append(G.connect_deleted(r["_left"], r["point"]))
            else:
                out.append(G.combine_deleted(r["_left"], r["_right"], r["splice"], r["rotation"], r["point"]) if r["kind"] == "combine" else None)
        return pa.array(out, pa.list_(pa.int32()))

    find.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    both = edges.join(left, F.col("in1") == F.col("_l")).join(right, F.col("in2") == F.col("_r"), "left")
    return both.withColumn("deleted", F.arrow_udf(find, "array<int>")(F.struct("kind", "splice", "rotation", "point", "_left", "_right"))).drop("_l", "_r", "_left", "_right")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = ["kind", "in1", "in2", "splice", "rotation", "point", "perm", "enc"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def with_stats(gadgets: DataFrame) -> DataFrame:
    """(id, enc, locations, states, uedges, dedges, components)."""
    cols = ("locations", "states", "uedges", "dedges", "components")

    def run(batches):
        for batch in batches:
            rows = [G.stats(e) for e in batch.column("enc").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("enc"), *(pa.array([r[c] for r in rows], pa.int32()) for c in cols)], ["id", "enc", *cols])

    return gadgets.select("id", "enc").mapInArrow(run, "id long, enc binary, " + ", ".join(f"{c} int" for c in cols))


def decoded(gadgets: DataFrame) -> DataFrame:
    """(id, s, a, b, t, directed): the edges of each row (id, enc); an undirected edge is one row."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, enc in zip(batch.column("id").to_pylist(), batch.column("enc").to_pylist()):
                _, _, undirected, directed = G.decode_edges(enc)
                rows += [(i, *e, d) for es, d in ((undirected, False), (directed, True)) for e in es]
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", *"sabt", "directed"])

    return gadgets.select("id", "enc").mapInArrow(run, "id long, s int, a int, b int, t int, directed boolean")


def edge_codes(locations: int, states: int) -> Column:
    """The code of an edge (s, a, b, t)."""
    return ((F.col("a") * locations + F.col("b")) * states + F.col("s")) * states + F.col("t")


def uncoded(codes: DataFrame, locations: int, states: int) -> DataFrame:
    """(s, a, b, t, code) from codes."""
    part = lambda by, most: F.expr(f"code div {by} % {most}")
    return codes.select(part(states, states).cast("int").alias("s"), F.expr(f"code div {locations * states * states}").alias("a"), part(states * states, locations).alias("b"), (F.col("code") % states).alias("t"), "code")


def split_edges(edges: DataFrame, of: str) -> DataFrame:
    """Edges (of, s, a, b, t) with `undirected`: whether the reverse is there too. Standing still is dropped."""
    n = edges.where(~((F.col("s") == F.col("t")) & (F.col("a") == F.col("b"))))
    back = n.select(F.col(of).alias("_of"), F.col("t").alias("_s"), F.col("b").alias("_a"), F.col("a").alias("_b"), F.col("s").alias("_t"))
    on = [F.col(of) == F.col("_of"), *(F.col(c) == F.col(f"_{c}") for c in "sabt")]
    return n.join(back, on, "left").withColumn("undirected", F.col("_of").isNotNull()).drop("_of", "_s", "_a", "_b", "_t")


def commit(store: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, edges) after an operation, whose result should be written already: new gadgets get ids, full edges their
    output's id."""
    new = with_stats(made.select("enc").distinct().withColumn("id", F.lit(0).cast("long")))
    order = [F.col(c) for c in ("components", "locations", "states")] + [F.col("dedges") != 0, F.col("uedges") != 0, F.col("uedges"), F.col("dedges")]
    fresh = relations.selsert(store.select("id", "enc"), new, "enc", order)
    store = materialise(store.select("id", "enc").unionByName(fresh.select("id", "enc")), "store")
    out = store.select(F.col("id").alias("out"), F.col("enc").alias("_e"))
    return store, made.join(out, F.col("enc") == F.col("_e")).drop("enc", "_e")


def search(sources: DataFrame, precision: int, stop_after: int, max_states: int | None = None, stop_round: int | None = None, close: bool = True, mirror: bool = True) -> tuple[DataFrame, DataFrame]:
    """Generational search from sources (enc): (gadgets with generation, edges).

    A generation begins with the sources, later with the combinations of the last generation and the rights. Then close,
    mirror and connect follow one another until nothing is new: what closing changes is replaced by what it makes, mirror
    images join, and connections begin the next round. The rights are what is left of the sources after their first
    close and mirror. Each input is worked on once; gadgets of more than max_states are kept, but nothing is made of them.
    The last generation ends after stop_round rounds of connections, where given.
    """
    store = relations.selsert(sources.select(F.lit(0).cast("long").alias("id"), "enc").limit(0), sources.select("enc").distinct(), "enc", [])
    store = materialise(store.select("id", "enc"), "store")
    seen, edges, rights = materialise(store.select("id", F.lit(0).alias("generation"))), None, None

    def work(ids: DataFrame, made) -> tuple[DataFrame, DataFrame]:
        """New ids, and the edges, of an operation on ids."""
        nonlocal store, seen, edges
        inputs = store.join(ids.select("id"), "id", "left_semi")
        if max_states is not None:
            inputs = with_stats(inputs).where(F.col("states") <= max_states).select("id", "enc")
        rows = materialise(made(inputs), "made")
        if rows.isEmpty():
            return ids.select("id").limit(0), rows.withColumn("out", F.lit(0).cast("long"))
        store, new = commit(store, rows)
        new = materialise(new, "edges")
        edges = new if edges is None else edges.unionByName(new)
        fresh = new.select(F.col("out").alias("id")).distinct().join(seen, "id", "left_anti")
        fresh = materialise(fresh.withColumn("generation", F.lit(generation)))
        seen = seen.unionByName(fresh)
        return fresh.select("id"), new

    now = seen.select("id")
    for generation in range(stop_after + 1):
        if generation:
            now, _ = work(front, lambda lefts: combine(lefts, store.join(rights, "id", "left_semi"), precision))
        front, rounds = now.limit(0), 0
        while not now.isEmpty():
            if close:
                made, new = work(now, lambda inputs: operate(inputs, "close"))
                now = materialise(now.join(new.select(F.col("in1").alias("id")), "id", "left_anti").unionByName(made), "round")
            if mirror:
                now = materialise(now.unionByName(work(now, lambda inputs: operate(inputs, "mirror"))[0]), "round")
            if rights is None:
                rights = now
            front = front.unionByName(now)
            if generation == stop_after and rounds == stop_round:
                break
            rounds += 1
            now, _ = work(now, lambda inputs: operate(inputs, "connect"))
        front = materialise(front, "front")
        if front.isEmpty():
            break
    return store.join(seen, "id"), edges
