"""The algebra of sets of integers as tables of half-open intervals (lo, hi), optionally for each of some key columns `by`.

An interval belongs to the bucket of BUCKET ids in which it begins; windows run within a bucket. What earlier buckets bring
along (how far they reach, how many intervals are open) is summed up in a row for each bucket and carried on in two levels, so
that no window runs over a whole set and a long interval is one row, however many buckets it spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import materialise

BUCKET = 1 << 16
#: Buckets whose sums one window carries on; above, a window runs over the sums of so many buckets.
LEVEL = 1 << 12


def _bucket(c: Column | str, size: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(size)).cast("long")


def _div(c: str, size: int) -> Column:
    """Floor of c / size for whole numbers of any size."""
    return F.expr(f"({c} - pmod({c}, {size}L)) div {size}L")


def carried(sums: DataFrame, by: Sequence[str], values: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For sums (by, b, values), one row a bucket b: (by, b, values before b), aggregated over all earlier buckets; null before
    the first."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_s", _div("b", LEVEL))
    tops = sums.groupBy(*by, "_s").agg(*[f(F.col(v)).alias(v) for v, f in values.items()])
    over = earlier(Window.partitionBy(*by).orderBy("_s"))
    tops = tops.select(*[F.col(c).alias(f"_k{c}") for c in by], F.col("_s").alias("_top"), *[f(F.col(v)).over(over).alias(f"_t{v}") for v, f in values.items()])
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_k{c}")), by, F.col("_s") == F.col("_top"))
    within = earlier(Window.partitionBy(*by, "_s").orderBy("b"))
    both = sums.select(*by, "b", "_s", *[f(F.col(v)).over(within).alias(v) for v, f in values.items()]).join(tops, same, "left")
    join = lambda v, f: F.greatest(F.col(v), F.col(f"_t{v}")) if f is F.max else F.when(F.col(v).isNotNull() | F.col(f"_t{v}").isNotNull(), F.coalesce(v, F.lit(0)) + F.coalesce(f"_t{v}", F.lit(0)))
    return both.select(*by, "b", *[join(v, f).alias(v) for v, f in values.items()])


def _with(df: DataFrame, sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """df (by, b, ...) with the other columns of sums (by, b, ...), one row a bucket."""
    other = sums.select(*[F.col(c).alias(f"_j{c}") for c in (*by, "b")], *[c for c in sums.columns if c not in (*by, "b")])
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_j{c}")), by, F.col("b") == F.col("_jb"))
    return df.join(other, same, "left").drop(*[f"_j{c}" for c in (*by, "b")])


def _runs(pieces: DataFrame, part: Sequence[str]) -> DataFrame:
    """Touching or overlapping pieces of one partition as one: a piece begins a run where it lies above all before it."""
    w = Window.partitionBy(*part).orderBy("lo", "hi")
    begins = F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.col("lo"), F.lit(True))
    numbered = pieces.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*part, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def _across(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge the disjoint runs of each bucket (by, b, lo, hi), b that of lo, with what earlier buckets reach into them.

    Runs that earlier buckets reach lengthen the run that reaches them; of the others only a bucket's last can go on beyond
    it. So at most two rows a bucket are met again.
    """
    pieces = materialise(pieces, "pieces")  # met several times below
    reach = carried(pieces.groupBy(*by, "b").agg(F.max("hi").alias("_reach")), by, {"_reach": F.max})
    met = _with(pieces, reach, by).withColumn("_in", F.coalesce(F.col("lo") <= F.col("_reach"), F.lit(False)))
    ends = met.groupBy(*by, "b").agg(F.max(F.when(F.col("_in"), F.col("hi"))).alias("_far"), F.max(F.when(~F.col("_in"), F.col("lo"))).alias("_last"), F.max("hi").alias("_hi"))
    ends = materialise(ends, "ends")
    inner = _with(met.where(~F.col("_in")), ends.select(*by, "b", "_last"), by).where("lo < _last").select(*by, "lo", "hi")
    opens = F.col("_last").isNotNull().cast("long")
    run = carried(ends.select(*by, "b", opens.alias("_run")), by, {"_run": F.sum})
    rim = _with(ends, run, by).withColumn("_run", F.coalesce("_run", F.lit(0)))
    none = F.lit(None).cast("long")
    both = F.array(
        F.when(F.col("_far").isNotNull(), F.struct(F.col("_run").alias("run"), none.alias("lo"), F.col("_far").alias("hi"))),
        F.when(F.col("_last").isNotNull(), F.struct((F.col("_run") + 1).alias("run"), F.col("_last").alias("lo"), F.col("_hi").alias("hi"))),
    )
    rim = rim.select(*by, F.explode(F.filter(both, lambda x: x.isNotNull())).alias("_r")).groupBy(*by, F.col("_r.run").alias("_n")).agg(F.min("_r.lo").alias("lo"), F.max("_r.hi").alias("hi"))
    return inner.unionByName(rim.select(*by, "lo", "hi"))


def coalesce(intervals: DataFrame, bucket: int = BUCKET, by: Sequence[str] = ()) -> DataFrame:
    """The least list of intervals with the same ids."""
    pieces = intervals.where("lo < hi").select(*by, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    pieces = pieces.groupBy(*by, "lo").agg(F.max("hi").alias("hi")).withColumn("b", _div("lo", bucket))
    return _across(_runs(pieces, [*by, "b"]), by)


def islands(ids: DataFrame, bucket: int = BUCKET, by: Sequence[str] = ()) -> DataFrame:
    """Maximal intervals of a column `id`; repeated ids count once, nulls are no ids."""
    points = ids.where("id is not null").select(*by, F.col("id").cast("long").alias("id")).distinct()
    pieces = points.select(*by, _div("id", bucket).alias("b"), F.col("id").alias("lo"))
    w = Window.partitionBy(*by, "b").orderBy("lo")
    runs = pieces.withColumn("_run", F.col("lo") - F.row_number().over(w)).groupBy(*by, "b", "_run").agg(F.min("lo").alias("lo"), (F.max("lo") + 1).alias("hi"))
    return _across(runs.drop("_run"), by)


def split(intervals: DataFrame, bucket: int = BUCKET, by: Sequence[str] = ()) -> DataFrame:
    """(by, b, lo, hi): each interval cut at bucket edges; empty ones go. A row for each bucket that an interval meets, made in
    two steps, so that no array of them grows with a long interval."""
    cut = intervals.where("lo < hi").select(*by, "lo", "hi", _div("lo", bucket).alias("_f"), _div("(hi - 1)", bucket).alias("_l"))
    cut = cut.withColumn("_s", F.explode(F.sequence(_div("_f", LEVEL), _div("_l", LEVEL))))
    cut = cut.withColumn("b", F.explode(F.sequence(F.greatest("_f", F.col("_s") * LEVEL), F.least("_l", (F.col("_s") + 1) * LEVEL - 1))))
    return cut.select(*by, "b", F.greatest("lo", F.col("b") * bucket).alias("lo"), F.least("hi", (F.col("b") + 1) * bucket).alias("hi"))


def inflate(intervals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ids of intervals."""
    return split(intervals, by=by).select(*by, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("id"))


def size(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0)).cast("long").alias("size"))


def _events(sets: dict[str, DataFrame], bucket: int) -> DataFrame:
    """(b, pos, a column for each set): by how much the number of intervals that cover a place changes at pos."""
    events = []
    for name, s in sets.items():
        delta = lambda v: [F.lit(v if n == name else 0).cast("long").alias(n) for n in sets]
        edges = s.where("lo < hi").select(F.explode(F.array(F.struct(F.col("lo").cast("long").alias("pos"), *delta(1)), F.struct(F.col("hi").cast("long").alias("pos"), *delta(-1)))).alias("_e"))
        events.append(edges.select("_e.*"))
    return reduce(DataFrame.unionByName, events).groupBy("pos").agg(*[F.sum(n).alias(n) for n in sets]).withColumn("b", _div("pos", bucket))


def _covers(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """Events with `_c<name>`: how many intervals of each set cover the place from pos on, and `_p<name>`: just before it."""
    events = materialise(events, "events")
    before = carried(events.groupBy("b").agg(*[F.sum(n).alias(n) for n in names]), (), dict.fromkeys(names, F.sum))
    both = _with(events, before.select("b", *[F.col(n).alias(f"_b{n}") for n in names]), ())
    w = Window.partitionBy("b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    now = [(F.sum(n).over(w) + F.coalesce(f"_b{n}", F.lit(0))).alias(f"_c{n}") for n in names]
    return both.select("b", "pos", *names, *now).select("b", "pos", *[F.col(f"_c{n}") for n in names], *[(F.col(f"_c{n}") - F.col(n)).alias(f"_p{n}") for n in names])


def sweep(sets: dict[str, DataFrame], keep: Callable[[Callable[[str], Column]], Column], bucket: int = BUCKET) -> DataFrame:
    """Maximal intervals where `keep` holds; it gets a function from a set's name to how many of its intervals cover the place."""
    at = _covers(_events(sets, bucket), list(sets))
    now, was = keep(lambda n: F.col(f"_c{n}")), keep(lambda n: F.col(f"_p{n}"))
    turns = at.select("b", "pos", now.alias("on"), was.alias("was")).where("on <> was")
    turns = materialise(turns, "turns")
    w = Window.partitionBy("b").orderBy("pos")
    turns = turns.withColumn("hi", F.lead("pos").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    closed = turns.where("on and hi is not null").select(F.col("pos").alias("lo"), "hi")
    # What a bucket leaves open ends with the first turn of a later one.
    rim = turns.groupBy("b").agg(F.max(F.when(F.col("on") & F.col("hi").isNull(), F.col("pos"))).alias("lo"), F.max(F.when(~F.col("on") & F.col("_first"), F.col("pos"))).alias("hi"))
    rim = _with(rim, carried(rim.select("b", F.col("lo").isNotNull().cast("long").alias("_n")), (), {"_n": F.sum}), ()).withColumn("_n", F.coalesce("_n", F.lit(0)))
    none = F.lit(None).cast("long")
    both = F.array(F.struct(F.col("_n").alias("n"), none.alias("lo"), F.col("hi").alias("hi")), F.struct((F.col("_n") + 1).alias("n"), F.col("lo").alias("lo"), none.alias("hi")))
    met = rim.select(F.explode(F.filter(both, lambda x: x["lo"].isNotNull() | x["hi"].isNotNull())).alias("_r"))
    return closed.unionByName(met.groupBy("_r.n").agg(F.min("_r.lo").alias("lo"), F.max("_r.hi").alias("hi")).select("lo", "hi"))


def union(*sets: DataFrame) -> DataFrame:
    return coalesce(reduce(DataFrame.unionByName, [s.select("lo", "hi") for s in sets]))


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return sweep({"l": left, "r": right}, lambda n: (n("l") > 0) & (n("r") > 0))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return sweep({"l": left, "r": right}, lambda n: (n("l") > 0) & (n("r") == 0))


def chunks(intervals: DataFrame, most: int, bucket: int = BUCKET) -> DataFrame:
    """(chunk, lo, hi): the ids in order in chunks of `most`, the last may be smaller. Ranks come from the counts of the
    buckets before."""
    pieces = materialise(coalesce(intervals, bucket), "whole").withColumn("n", F.col("hi") - F.col("lo")).withColumn("b", _div("lo", bucket))
    before = carried(pieces.groupBy("b").agg(F.sum("n").alias("_before")), (), {"_before": F.sum})
    inside = F.sum("n").over(Window.partitionBy("b").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    ranked = _with(pieces, before, ()).withColumn("rank", F.coalesce(inside, F.lit(0)) + F.coalesce("_before", F.lit(0)))
    # Chunk numbers in two steps, so that no array grows with a long interval.
    ranked = ranked.withColumn("_f", F.expr(f"rank div {most}")).withColumn("_l", F.expr(f"(rank + n - 1) div {most}"))
    ranked = ranked.withColumn("_s", F.explode(F.sequence(_div("_f", LEVEL), _div("_l", LEVEL))))
    cut = ranked.withColumn("chunk", F.explode(F.sequence(F.greatest("_f", F.col("_s") * LEVEL), F.least("_l", (F.col("_s") + 1) * LEVEL - 1))))
    lo = F.greatest("lo", F.col("lo") + F.col("chunk") * most - F.col("rank"))
    hi = F.least("hi", F.col("lo") + (F.col("chunk") + 1) * most - F.col("rank"))
    return cut.select("chunk", lo.alias("lo"), hi.alias("hi"))


def contains(probes: DataFrame, intervals: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """probes with `contained`: whether their `id` lies in an interval. Distinct ids and interval edges are swept together
    within a bucket, so that the work follows their numbers, not their pairs."""
    ids = probes.where("id is not null").select(F.col("id").cast("long").alias("pos")).distinct()
    events = _events({"n": intervals}, bucket).withColumn("_ask", F.lit(False))
    asked = ids.select("pos", F.lit(0).cast("long").alias("n"), _div("pos", bucket).alias("b"), F.lit(True).alias("_ask"))
    both = events.unionByName(asked).groupBy("b", "pos").agg(F.sum("n").alias("n"), F.max("_ask").alias("_ask"))
    both = materialise(both, "probes")
    found = both.where("_ask").select("b", F.col("pos").alias("_pos")).join(_covers(both.select("b", "pos", "n"), ["n"]).where("_cn > 0").select("pos"), F.col("_pos") == F.col("pos"))
    return probes.join(found.select("_pos"), F.col("id") == F.col("_pos"), "left").withColumn("contained", F.col("_pos").isNotNull()).drop("_pos")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over (b, lo, hi, key) sorted by b and lo: distinct pairs (a, c), a < c, of keys that meet in a
    bucket; each piece is held against the pieces that are still open."""
    now, live, found = None, {}, set()

    def out():
        a, c = ([p[k] for p in found] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(c, pa.string())], ["_a", "_c"])

    for batch in batches:
        for b, lo, hi, key in zip(*(batch.column(c).to_pylist() for c in ("b", "lo", "hi", "key"))):
            if b != now:
                now, live = b, {}
                if len(found) > 100_000:
                    yield out()
                    found = set()
            if min(live.values(), default=lo + 1) <= lo:
                live = {k: h for k, h in live.items() if h > lo}
            for other in live:
                if other != key:
                    found.add((min(key, other), max(key, other)))
            live[key] = max(hi, live.get(key, hi))
    if found:
        yield out()


def overlap(pairs: DataFrame, intervals: DataFrame, key: str = "key", bucket: int = BUCKET) -> DataFrame:
    """pairs (a, b) of keys with `state`: overlap, adjacent (touching ends only) or separate. Keys are strings. A sweep over
    each bucket holds a piece against those open there only; an interval is met in each bucket that it spans."""
    sets = materialise(coalesce(intervals, bucket, [key]), "whole")
    cut = split(sets, bucket, [key]).select("b", "lo", "hi", F.col(key).cast("string").alias("key"))
    meet = cut.repartition("b").sortWithinPartitions("b", "lo").mapInArrow(_meeting, "_a string, _c string").distinct()
    low, high = sets.select(F.col(key).alias("_a"), "hi"), sets.select(F.col(key).alias("_c"), F.col("lo").alias("hi"))
    touch = low.join(high, "hi").where("_a <> _c").select(F.least("_a", "_c").alias("_a"), F.greatest("_a", "_c").alias("_c")).distinct()
    states = meet.withColumn("_s", F.lit(2)).unionByName(touch.withColumn("_s", F.lit(1))).groupBy("_a", "_c").agg(F.max("_s").alias("_s"))
    out = pairs.join(states, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_c")), "left")
    return out.withColumn("state", F.when(F.col("_s") == 2, "overlap").when(F.col("_s") == 1, "adjacent").otherwise("separate")).drop("_a", "_c", "_s")


def by_key_set(keyed: DataFrame, key: str = "key") -> DataFrame:
    """(keys, lo, hi): ids (key, id) grouped by the set of keys that hold them; keys sorted and joined by commas."""
    sets = keyed.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias("keys"))
    return islands(sets, by=["keys"])
