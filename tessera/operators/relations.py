"""Predicates, completions, edges and the object store, as DataFrame operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv
from .fixpoint import materialise

#: The statistics that predicates know, with their plurals.
KINDS = ("locations", "states", "uedges", "dedges", "edges", "components")


# predicates


def statistic(kind: str) -> Column:
    """The column of a statistic, by singular or plural name; edges are undirected and directed ones together."""
    name = next((k for k in KINDS if kind.rstrip("s") == k.rstrip("s")), None)
    if name is None:
        raise ValueError(f"no statistic {kind!r}")
    return F.col("uedges") + F.col("dedges") if name == "edges" else F.col(name)


def at_most(objects: DataFrame, column: Column, k: int) -> DataFrame:
    return objects.where(column <= k)


def in_range(objects: DataFrame, column: Column, above: int, most: int) -> DataFrame:
    return objects.where((column > above) & (column <= most))


def apply_bounds(objects: DataFrame, least: dict[str, int], most: dict[str, int]) -> DataFrame:
    """All bounds in one filter; a least bound of 0 is an error."""
    if any(v <= 0 for v in least.values()):
        raise ValueError("a least bound must be above 0")
    conditions = [statistic(k) >= v for k, v in least.items()] + [statistic(k) <= v for k, v in most.items()]
    return objects.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def thresholds(objects: DataFrame, column: Column) -> DataFrame:
    """(k, lo, hi): for each value k of the column, the ids at or below it as intervals.

    Id i is in the sets from its value on. So an interval begins at i for the values from its own up to that of id i - 1, and
    ends with i for those up to that of id i + 1; the rows made are the edges of intervals, not ids times thresholds. A bucket
    parts intervals, which are joined across buckets afterwards.
    """
    ids = objects.select(F.col("id").cast("long").alias("id"), column.alias("v")).where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    ids = materialise(ids.withColumn("b", iv._div("id", iv.BUCKET)), "values")
    # Values by rank, a row each; joined, so that their number has no bound.
    values = materialise(dense_rank_by(ids.select(F.col("v").alias("k")).distinct(), ["k"]).select("k", "rank"), "ranks")
    top = F.lit(values.count() + 1)
    w = Window.partitionBy("b").orderBy("id")
    ranked = ids.join(values, F.col("v") == F.col("k")).select("id", "b", "rank")
    beside = lambda f, step: F.when(f("id").over(w) == F.col("id") + step, f("rank").over(w))
    edges = ranked.select("id", "b", "rank", beside(F.lag, -1).alias("before"), beside(F.lead, 1).alias("after"))
    spans = lambda other: F.when(F.coalesce(other, top) > F.col("rank"), F.sequence("rank", F.coalesce(other, top) - 1))
    begin = edges.select("b", F.explode(spans("before")).alias("rank"), F.col("id").alias("pos"), F.lit(0).alias("end"))
    end = edges.select("b", F.explode(spans("after")).alias("rank"), (F.col("id") + 1).alias("pos"), F.lit(1).alias("end"))
    both = begin.unionByName(end)
    # Within a bucket and rank they take turns: a beginning is followed by its end.
    turn = Window.partitionBy("rank", "b").orderBy("pos", F.col("end").desc())
    pieces = both.withColumn("hi", F.lead("pos").over(turn)).where("end = 0").select("rank", "b", F.col("pos").alias("lo"), "hi")
    return iv._across(pieces, ["rank"]).join(values, "rank").select("k", "lo", "hi")


class Catalog:
    """Named indexes `kind<=k` as interval sets in a folder, valid for the objects before an id; a run replaces a whole file."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _of(self, name: str) -> str:
        if not re.fullmatch(r"[a-z]+<=\d+", name):
            raise ValueError(f"no index name: {name!r}")
        return f"{self.path}/{name.replace('<=', '-')}"

    def _folder(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def names(self) -> list[str]:
        """The indexes that there are: a listing of the folder."""
        fs, at = self._folder()
        found = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(x.replace("-", "<=") for x in found if re.fullmatch(r"[a-z]+-\d+", x))

    def create(self, name: str, objects: DataFrame) -> DataFrame:
        """Make the index over all objects so far; an index that exists is an error."""
        if name in self.names():
            raise ValueError(f"{name} exists")
        kind, k = name.split("<=")
        iv.islands(at_most(objects, statistic(kind), int(k)).select("id")).write.parquet(self._of(name))
        return self.read(name)

    def update(self, name: str, fresh: DataFrame) -> DataFrame:
        """Extend the index by new objects."""
        kind, k = name.split("<=")
        made = materialise(extend(self.read(name), fresh, statistic(kind), int(k)), "index")
        made.write.mode("overwrite").parquet(self._of(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema("lo long, hi long").parquet(self._of(name))

    def delete(self, name: str) -> None:
        fs, _ = self._folder()
        if not fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._of(name)), True):
            raise ValueError(f"no index {name}")


def extend(index: DataFrame, fresh: DataFrame, column: Column, k: int) -> DataFrame:
    """The index `column <= k` over objects so far, extended by new ones: equal to building it anew."""
    return iv.union(index, iv.islands(at_most(fresh, column, k).select("id")))


# completions


def without(ids: DataFrame, done: DataFrame) -> DataFrame:
    return ids.join(done.select(F.col("id")), "id", "left_anti")


def only(ids: DataFrame, done: DataFrame) -> DataFrame:
    return ids.join(done.select(F.col("id")), "id", "left_semi")


def record(done: DataFrame, more: DataFrame, allow_overlap: bool = False) -> DataFrame:
    """Completed intervals with more; inputs that were complete before are an error unless allowed."""
    if not allow_overlap and not iv.intersection(done, more).isEmpty():
        raise ValueError("some inputs are complete already")
    return iv.union(done, more)


def compact(levels: list[DataFrame]) -> DataFrame:
    return iv.union(*levels)


def rebuild(edges: DataFrame) -> DataFrame:
    """Completions from the edges that exist: (kind, lo, hi) of their inputs."""
    return iv.islands(edges.select("kind", F.col("in1").alias("id")), by=["kind"])


# edges


def follow(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct outputs of edges from ids."""
    return edges.join(ids, F.col("in1") == F.col("id"), "left_semi").select(F.col("out").alias("id")).distinct()


def follow_with_inputs(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(side, id): outputs, and the ids that had an edge."""
    used = edges.join(ids, F.col("in1") == F.col("id"), "left_semi")
    return used.select(F.explode(F.array(F.struct(F.lit("input").alias("side"), F.col("in1").alias("id")), F.struct(F.lit("output").alias("side"), F.col("out").alias("id")))).alias("x")).select("x.*").distinct()


def skinny(edges: DataFrame) -> DataFrame:
    return edges.select("kind", "in1", "out").distinct()


def incoming(edges: DataFrame, targets: DataFrame) -> DataFrame:
    return edges.join(targets, F.col("out") == F.col("id"), "left_semi")


def inverted(edges: DataFrame) -> DataFrame:
    """(out, n, ins): the sorted inputs of each output, joined by commas."""
    lists = edges.select("in1", "out").distinct().groupBy("out").agg(F.array_sort(F.collect_list("in1")).alias("ins"))
    return lists.select("out", F.size("ins").cast("long").alias("n"), F.array_join(F.transform("ins", lambda x: x.cast("string")), ",").alias("ins"))


def of_input(edges: DataFrame, i: int) -> DataFrame:
    return edges.where(F.col("in1") == i)


def first_edges(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, in1, out): of each id with edges the least one, the search for others ended there."""
    used = edges.join(ids, F.col("in1") == F.col("id"), "left_semi")
    return used.groupBy("in1").agg(F.min(F.struct("kind", "out")).alias("e")).select("e.kind", "in1", "e.out")


def ordered(edges: DataFrame, backwards: bool = False) -> DataFrame:
    """Edges (in1, kind, out) sorted in ranges by input, kind and output, or by output, kind and input."""
    keys = ["out", "kind", "in1"] if backwards else ["in1", "kind", "out"]
    return edges.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_skinny(edges: DataFrame, path: str) -> None:
    """Distinct (in1, out) in a folder for each kind, pages sorted by input and output."""
    parts = skinny(edges).repartitionByRange("kind", "in1", "out").sortWithinPartitions("kind", "in1", "out")
    parts.write.partitionBy("kind").parquet(path)


def write_inverted(edges: DataFrame, path: str, block: int = 4096) -> None:
    """(out, number, n, deltas): each output's sorted inputs in blocks of `block`, each as varints of the first input and of the
    differences of neighbours, sorted by output."""
    from ..functions import codec

    pairs = edges.select("out", "in1").distinct()
    w = Window.partitionBy("out").orderBy("in1")
    numbered = pairs.withColumn("number", F.floor((F.row_number().over(w) - 1) / block).cast("int"))
    lists = numbered.groupBy("out", "number").agg(F.array_sort(F.collect_list("in1")).alias("ins"))
    deltas = F.transform("ins", lambda x, k: F.when(k == 0, x).otherwise(x - F.element_at("ins", k)))
    coded = lists.select("out", "number", F.size("ins").alias("n"), codec.varints(deltas).alias("deltas"))
    coded.repartitionByRange("out", "number").sortWithinPartitions("out", "number").write.parquet(path)


def read_inverted(spark, path: str) -> DataFrame:
    """(out, in1) from an inverted file."""
    from ..functions import codec

    rows = spark.read.parquet(path).select("out", codec.unvarints(F.col("deltas")).alias("d"))
    sums = F.aggregate("d", F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))
    return rows.select("out", F.explode(sums).alias("in1"))


def hashes(store: DataFrame, content: str) -> DataFrame:
    """(id, hash): the hash of each content."""
    return store.select("id", F.xxhash64(content).alias("hash"))


def write_hashes(store: DataFrame, content: str, path: str) -> None:
    """(hash, id) sorted in ranges of hashes."""
    hashes(store, content).select("hash", "id").repartitionByRange("hash", "id").sortWithinPartitions("hash", "id").write.parquet(path)


def contents(ids: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of the store for ids (id) or intervals (lo, hi)."""
    if "lo" in ids.columns:
        return iv.contains(store, ids).where("contained").drop("contained")
    return store.join(ids.select("id").distinct(), "id", "left_semi")


def merged_statistics(records: DataFrame, by: list[str]) -> DataFrame:
    """Counters of tasks added up for each `by`."""
    counters = [c for c in records.columns if c not in by]
    return records.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters])


def needs(lefts: DataFrame, done: DataFrame, rights: DataFrame) -> DataFrame:
    """(rights, lo, hi): lefts (id) by the list of rights (id) that they are not yet combined with by done (left, right)."""
    pool = rights.agg(F.array_sort(F.collect_set(F.col("id").cast("long"))).alias("all"))
    had = done.groupBy(F.col("left").alias("l")).agg(F.collect_set(F.col("right").cast("long")).alias("had"))
    open_ = lefts.join(had, F.col("id") == F.col("l"), "left").join(F.broadcast(pool))  # the pool is one row
    open_ = open_.withColumn("rights", F.array_except("all", F.coalesce("had", F.array().cast("array<long>")))).where(F.size("rights") > 0)
    return iv.islands(open_.select("id", F.array_join(F.transform("rights", lambda x: x.cast("string")), ",").alias("rights")), by=["rights"])


def needs_sizes(needed: DataFrame) -> DataFrame:
    """(lefts, pairs) of needs."""
    n = F.col("hi") - F.col("lo")
    return needed.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("lefts"), F.coalesce(F.sum(n * F.size(F.split("rights", ","))), F.lit(0)).cast("long").alias("pairs"))


def by_provenance(edges: DataFrame) -> DataFrame:
    """Edges in ranges by second, then first input: those of one task's inputs lie together."""
    return edges.repartitionByRange("in2", "in1").sortWithinPartitions("in2", "in1")


def equivalent(left: DataFrame, right: DataFrame, content: str) -> DataFrame:
    """(a, b): least ids of equal content in two tables (id, content)."""
    l, r = (d.groupBy(content).agg(F.min("id").alias(n)) for d, n in ((left, "a"), (right, "b")))
    return l.join(r, content).select("a", "b")


def mapped(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    return ids.join(pairs, F.col("id") == F.col("a")).select(F.col("b").alias("id"))


# store


def selsert(store: DataFrame, proposed: DataFrame, content: str, order: list[Column]) -> DataFrame:
    """(content, id) of contents that the store (id, content) lacks, numbered densely after its largest id in `order`, then
    by content. A total order, so that a rerun gives the same ids. New contents are ranked by range and offset."""
    novel = proposed.select(content, *[c.alias(f"_o{k}") for k, c in enumerate(order)]).dropDuplicates([content]).join(store, content, "left_anti")
    top = store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    keys = [*(f"_o{k}" for k in range(len(order))), content]
    ranked = dense_rank_by(novel, keys)
    return ranked.join(F.broadcast(top)).select(content, (F.col("top") + F.col("rank")).alias("id"))


def dense_rank_by(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Rows with `rank` 1 to n in the order of keys, without a window over all rows: ranges, sorted within, with offsets."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    # A row for each range: bounded by the number of partitions.
    return ranged.withColumn("_in", inside).join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("rank", (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_p", "_in", "_before")


def names(named: DataFrame) -> DataFrame:
    """(name, n, least, single): names of (name, id), whether for one object or a group."""
    return named.groupBy("name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("least")).withColumn("single", F.col("n") == 1)


def parse_ids(spec: str) -> tuple[int, int] | str:
    """`5`, `[1,5)`, `(1, 5]` as a half-open interval; anything else is a name."""
    if spec.strip().isdigit():
        return int(spec), int(spec) + 1
    m = re.fullmatch(r"\s*([\[(])\s*(\d+)\s*,\s*(\d+)\s*([\])])\s*", spec)
    if not m:
        return spec.strip()
    lo, hi = int(m[2]) + (m[1] == "("), int(m[3]) + (m[4] == "]")
    if lo >= hi:
        raise ValueError(f"empty range {spec!r}")
    return lo, hi


def ids_of(specs: list[str], named: DataFrame) -> DataFrame:
    """Ids of specifications; a name that (name, id) lacks is an error."""
    spark, parsed = named.sparkSession, [parse_ids(s) for s in specs]
    wanted = [p for p in parsed if isinstance(p, str)]
    found = named.where(F.col("name").isin(wanted))
    if missing := set(wanted) - {r[0] for r in found.select("name").distinct().collect()}:
        raise ValueError(f"no such names: {sorted(missing)}")
    ranges = spark.createDataFrame([p for p in parsed if not isinstance(p, str)], "lo long, hi long")
    return iv.inflate(ranges).unionByName(found.select(F.col("id").cast("long").alias("id"))).distinct()
