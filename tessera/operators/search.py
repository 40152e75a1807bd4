"""Fixpoint search over edge tables: semi-naive rounds, each written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import bucketed, materialise

#: Rounds after which what is found is written anew as one table.
COMPACT = 8


def closure(seeds: DataFrame, edges: DataFrame, rounds: int | None = None, least_step: bool = True) -> DataFrame:
    """(id, step, kind, source): everything reachable from seeds (id) over edges (kind, in1, out).

    A seed has step 0 and no source; another id its first step, and of the edges that reach it then the least (kind, in1).
    Each round joins only the last round's ids and keeps ids not met before, until none is new; it raises if `rounds`, where
    given, run out before.
    """
    spark = edges.sparkSession
    # Written once in buckets of the input, so that a round shuffles only the ids that it starts from.
    kept, name = bucketed(edges.select("kind", F.col("in1").cast("long").alias("in1"), F.col("out").cast("long").alias("out")), "in1")
    try:
        start = seeds.select(F.col("id").cast("long").alias("id")).distinct()
        front = materialise(start.select("id", F.lit(0).cast("long").alias("step"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("source")))
        found, step = front, 0
        while not front.isEmpty():
            if step == rounds:
                raise RuntimeError("the search didn't end")
            step += 1
            reached = kept.join(front.select(F.col("id").alias("in1")), "in1").groupBy(F.col("out").alias("id")).agg(F.min(F.struct("kind", "in1")).alias("by"))
            new = reached.join(found.select("id"), "id", "left_anti")
            front = materialise(new.select("id", F.lit(step).cast("long").alias("step"), F.col("by.kind").alias("kind"), F.col("by.in1").alias("source")))
            found = found.unionByName(front)
            if step % COMPACT == 0:  # one table instead of one a round
                found = materialise(found, "found")
        return found
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def inverse(targets: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Everything from which a target can be reached."""
    return closure(targets, edges.select("kind", F.col("out").alias("in1"), F.col("in1").alias("out")), rounds)


def by_priority(seeds: DataFrame, edges: DataFrame, kinds: list[str], rounds: int = 1000) -> DataFrame:
    """(id, kind, source): reachable ids where earlier kinds are followed to their end before a later kind is tried once."""
    edges = materialise(edges.select("kind", "in1", "out"), "edges")  # met in every round
    found = materialise(seeds.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("source")).distinct())
    waiting = {k: found.select("id") for k in kinds}
    for k in range(rounds):
        kind = next((x for x in kinds if not waiting[x].isEmpty()), None)
        if kind is None:
            return found
        hit = edges.where(F.col("kind") == kind).join(waiting[kind].select(F.col("id").alias("in1")), "in1")
        new = hit.groupBy(F.col("out").alias("id")).agg(F.min("in1").alias("source")).join(found.select("id"), "id", "left_anti")
        new = materialise(new.select(F.col("id").cast("long").alias("id"), F.lit(kind).alias("kind"), F.col("source").cast("long").alias("source")))
        waiting[kind] = waiting[kind].limit(0)
        waiting = {x: w.unionByName(new.select("id")) for x, w in waiting.items()}
        found = found.unionByName(new)
        if k % COMPACT == COMPACT - 1:
            found = materialise(found, "found")
            waiting = {x: w if w.isEmpty() else materialise(w, "waiting") for x, w in waiting.items()}
    raise RuntimeError("the search didn't end")


def generations(seeds: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most: int) -> DataFrame:
    """(id, generation): each generation is step(the last generation, the seeds) less everything before."""
    front = materialise(seeds.select(F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("generation")).distinct())
    base, found = front.select("id"), front
    for g in range(1, most + 1):
        made = step(front.select("id"), base).select(F.col("id").cast("long").alias("id")).distinct()
        front = materialise(made.join(found.select("id"), "id", "left_anti").withColumn("generation", F.lit(g).cast("long")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def trace(found: DataFrame, target: int) -> list[tuple[str, int, int]]:
    """(kind, source, id) from a seed to the target, in order."""
    steps = traces(found, found.where(F.col("id") == target).select("id")).where("source is not null").collect()
    if not steps and found.where((F.col("id") == target)).isEmpty():
        raise ValueError(f"{target} isn't reached")
    by, out = {r["id"]: r for r in steps}, []
    while target in by:
        out.append((by[target]["kind"], by[target]["source"], target))
        target = by[target]["source"]
    return out[::-1]


def traces(found: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of found (id, source or in1 and in2, ...) from which targets (id) are built, each once: all targets go back a
    step at a time together, in as many rounds as the longest trace has steps."""
    inputs = [c for c in ("source", "in1", "in2") if c in found.columns]
    front = materialise(targets.select(F.col("id").cast("long").alias("id")).distinct(), "front")
    kept = None
    while not front.isEmpty():
        rows = materialise(found.join(front, "id", "left_semi"), "traces")
        kept = rows if kept is None else kept.unionByName(rows)
        back = rows.select(F.explode(F.array(*inputs)).alias("id")).where("id is not null").distinct()
        front = materialise(back.join(kept.select("id"), "id", "left_anti"), "front")
    return found.limit(0) if kept is None else kept


def sorted_steps(steps: dict[int, tuple[int, ...]], target: int) -> list[int]:
    """The ids from which a target is built, inputs before outputs; of those that are ready the one just set free comes
    first, least id first. steps has the inputs of each id."""
    needs, frees, todo = {}, {}, [target]
    while todo:
        i = todo.pop()
        if i in needs:
            continue
        needs[i] = len(steps[i])
        for k in steps[i]:
            frees.setdefault(k, []).append(i)
            todo.append(k)
    ready, out = sorted((i for i, n in needs.items() if not n), reverse=True), []
    while ready:
        i = ready.pop()
        out.append(i)
        free = []
        for k in frees.get(i, ()):
            needs[k] -= 1
            if not needs[k]:
                free.append(k)
        ready += sorted(free, reverse=True)
    return out


#: Names that stand for all others of their gadget in reports.
PREFERRED = (
    "diode", "wire", "diode-diode-parallel", "diode-diode-antiparallel-r", "diode-diode-antiparallel-s", "diode-diode-crossing",
    "wire-wire-noncrossing", "wire-wire-crossing", "diode-wire-noncrossing-r", "diode-wire-noncrossing-s", "diode-wire-crossing",
)


def single_names(named: DataFrame) -> DataFrame:
    """(id, names): the names of (name, id) that stand for one gadget, sorted; where a preferred one is among them, it alone."""
    one = named.groupBy("name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
    names = one.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    best = F.array_intersect("names", F.array(*map(F.lit, PREFERRED)))
    return names.select("id", F.when(F.size(best) > 0, best).otherwise(F.col("names")).alias("names"))


def targets(named: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, of, closed, mirrored): gadgets with a single name, then what closing makes of them, then what mirroring makes of
    all these; each id by the first of these ways, of those the one from the least id."""
    direct = single_names(named).select("id", F.col("id").alias("of"), F.lit(False).alias("closed"), F.lit(False).alias("mirrored"))

    def through(kind: str, have: DataFrame) -> DataFrame:
        hit = edges.where(F.col("kind") == kind).join(have.select(F.col("id").alias("in1"), "of", "closed"), "in1")
        new = hit.groupBy(F.col("out").alias("id")).agg(F.min(F.struct("in1", "of", "closed")).alias("m"))
        new = new.join(have.select("id"), "id", "left_anti")
        return new.select("id", "m.of", F.lit(True).alias("closed") if kind == "close" else F.col("m.closed"), F.lit(kind == "mirror").alias("mirrored"))

    have = materialise(direct, "targets")
    have = materialise(have.unionByName(through("close", have)), "targets")
    return have.unionByName(through("mirror", have))


def report(seeds: DataFrame, edges: DataFrame, named: DataFrame, closed_first: tuple[str, ...] = ("close", "mirror", "connect", "combine")) -> tuple[DataFrame, DataFrame]:
    """(targets found, steps): which named gadgets, or their closed or mirrored forms, can be built from seeds (id).

    The first has (id, name, suffix): a row for each name of each target that is reached and isn't just its own seed; suffix is
    `closed`, `mirrored` or `closed, mirrored` where the target is such a form of the named gadget. The second has the rows
    of the reachability search, (id, kind, source), of every step that leads to one of them. Earlier kinds are followed to
    their end before later ones.
    """
    found = materialise(by_priority(seeds, edges, list(closed_first)), "reached")
    aims = materialise(targets(named, edges), "aims")
    met = materialise(aims.join(found, "id").where("not (source is null and not closed and not mirrored)"), "met")
    suffix = F.array_join(F.filter(F.array(F.when(F.col("closed"), "closed"), F.when(F.col("mirrored"), "mirrored")), lambda x: x.isNotNull()), ", ")
    names = single_names(named).select(F.col("id").alias("of"), F.explode("names").alias("name"))
    return met.join(names, "of").select("id", "name", suffix.alias("suffix")), traces(found, met.select("id"))
