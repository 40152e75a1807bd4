"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint's bits are cut into two-bit segments; the vector of their bit counts embeds it so that the Manhattan distance
of two vectors is never above the Hamming distance of the fingerprints. A pair within `most` bits has Manhattan
distance at most `most`; so of GROUPS groups of segments at least GROUPS - most agree in all counts. The grid range join
therefore puts each fingerprint into one cell for each choice of that many groups, keyed by their counts, and within a
cell compares what the lower bound lets through exactly. Equal fingerprints are one point throughout.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, giving_back, stage

#: Groups of segments by the most points that they serve: with more groups, cells are smaller and a point is in more of them.
GROUPS = {100_000_000: 7, 3_000_000_000: 8, 1 << 62: 10}
#: Points of a cell that one task compares at once; larger cells are dealt into blocks, and pairs of blocks compared.
CELL_ROWS = 20_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOW = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the shingles' XXH64, repeats included; a bit is 1 if set in over half of them; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    k = min(shingle, n)
    begin = np.concatenate(([0], ends[: n - k] + 1)).tolist()
    digest, total, m = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n - k + 1
    for at in range(0, m, 1 << 16):  # bounded memory for long texts
        h = np.array([digest(line[b:e], seed) for b, e in zip(begin[at : at + (1 << 16)], ends[k - 1 + at : k - 1 + at + (1 << 16)].tolist())], np.uint64)
        total += _bit_counts(h)
    return int(np.packbits(total * 2 > m, bitorder="little").view(np.uint64)[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    lanes, out = h.view(np.uint8).reshape(-1, 8), np.zeros((8, 8), np.int64)
    for bit in range(8):
        out[:, bit] = ((lanes >> np.uint8(bit)) & np.uint8(1)).sum(0)
    return out.ravel()


def fingerprints(text: Column, shingle: int = 4) -> Column:
    """The fingerprint of each whole text as a signed long; null counts as empty."""

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64), pa.int64())

    make = giving_back(make)
    make.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(make, "long")(text)


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in its two bits of the word."""
    return (fp & _LOW) + ((fp >> np.uint64(1)) & _LOW)


def group_masks(groups: int) -> list[int]:
    """The 32 segments in `groups` runs of nearly equal length, as bit masks."""
    cuts = [round(32 * g / groups) for g in range(groups + 1)]
    return [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(points: DataFrame, most: int, groups: int) -> DataFrame:
    """(cell, fp): each point in one cell for each choice of groups - most groups, keyed by those groups' counts."""
    masks = group_masks(groups)
    low = F.lit(_signed(int(_LOW)))
    one, two = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    counts = one.bitwiseXOR(two).bitwiseOR(F.shiftleft(one.bitwiseAND(two), 1))  # one + two, which can't overflow
    chosen = [_signed(sum(masks[g] for g in c)) for c in itertools.combinations(range(groups), groups - most)]
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("counts").bitwiseAND(F.lit(m))) for k, m in enumerate(chosen)])
    return points.withColumn("counts", counts).select("fp", F.explode(keys).alias("cell"))


def links_in_cell(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within `most` bits: (point, point), at most one fewer than the points.

    Each point is compared with all points after it, in order of bit counts, whose bit count is within `most` and that no
    link connects to it yet; of each component so met one link is kept.
    """
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp = fp[order]
    ones, counts = np.bitwise_count(fp).astype(np.int16), segment_counts(fp)
    ends = np.searchsorted(ones, ones + most, "right").tolist()
    label, met, a, b = np.arange(len(fp)), np.zeros(len(fp), bool), [], []
    for i in range(len(fp)):
        near = np.flatnonzero(label[i + 1 : ends[i]] != label[i]) + i + 1
        # Lower bound first: counts that differ in over `most` segments can't be within `most` bits.
        x = counts[near] ^ counts[i]
        near = near[np.bitwise_count((x | x >> np.uint64(1)) & _LOW) <= most]
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= most]
        if len(near):
            heads, first = np.unique(label[near], return_index=True)
            met[heads] = True
            label[met[label]] = label[i]
            met[heads] = False
            a.append(np.full(len(first), fp[i]))
            b.append(fp[near[first]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _pairs(most: int):
    """mapInArrow function over rows sorted by cell: links (a, b), a > b as signed, from each run of one cell."""

    def compare(fp: np.ndarray, cell: np.ndarray):
        edges = np.flatnonzero(np.diff(cell)) + 1
        bounds = np.concatenate(([0], edges, [len(cell)]))
        a, b = [], []
        # Small cells together: each point with the next, the one after it, and so on, while in one cell.
        size = np.repeat(np.diff(bounds), np.diff(bounds))
        small = size <= 64
        f, c, step = fp[small], cell[small], 1
        at = np.arange(len(f))
        while len(at := at[at + step < len(f)]) and len(at := at[c[at] == c[at + step]]):
            x, y = f[at], f[at + step]
            near = np.bitwise_count(x ^ y) <= most
            a.append(x[near])
            b.append(y[near])
            step += 1
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo > 64:
                x, y = links_in_cell(np.unique(fp[lo:hi]), most)
                a.append(x)
                b.append(y)
        none = np.zeros(0, np.uint64)
        a, b = np.concatenate([none, *a]).view(np.int64), np.concatenate([none, *b]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def run(batches):
        held_f, held_c = np.zeros(0, np.uint64), np.zeros((0,), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            f = np.concatenate([held_f, batch.column("fp").to_numpy().view(np.uint64)])
            c = np.concatenate([held_c, batch.column("task").to_numpy()])
            whole = int(np.searchsorted(-(c[::-1] == c[-1]).astype(np.int8), 0))  # rows of the last cell, which may go on
            cut = len(c) - whole
            if cut:
                yield compare(f[:cut], c[:cut])
            held_f, held_c = f[cut:], c[cut:]
        if len(held_c):
            yield compare(held_f, held_c)

    return run


def links(points: DataFrame, most: int = 4, groups: int | None = None) -> DataFrame:
    """Distinct (a, b) among the distinct fingerprints `fp` that connect whatever links within `most` bits connect. The number
    of groups follows the number of points where it isn't given; results are the same for any above `most`."""
    if groups is None:
        n = points.count()
        groups = next(g for top, g in GROUPS.items() if n <= top) + most - 4
    cells = stage(_cells(points, most, groups), "simhash-cells")
    sizes = cells.groupBy(F.col("cell").alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS)
    # Only large cells are met by a join; their blocks are compared in pairs: (i, i) within, (i, j) across.
    sizes = stage(sizes.withColumn("parts", F.expr(f"(n + {CELL_ROWS} - 1) div {CELL_ROWS}").cast("int")), "simhash-large")
    dealt = cells.join(sizes, F.col("cell") == F.col("c"), "left").withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    one = dealt.where("parts is null").select("fp", F.col("cell").alias("task"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    many = dealt.where("parts is not null").select("fp", "cell", "own", other)
    many = many.select("fp", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    tasks = one.unionByName(many).repartition("task").sortWithinPartitions("task")
    return tasks.mapInArrow(giving_back(_pairs(most)), "a long, b long").groupBy("a", "b").agg(F.lit(1).alias("_")).select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node reachable over the undirected edges (a, b); nodes without edges are absent.

    Each round points every node at the least root of its neighbours (large-star, then small-star), so that the number of
    rounds grows with the logarithm of the longest chain. Rounds are written to the shared folder, and hubs are met by
    aggregation before any join.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(rounds):
        # Done where every node but the roots has one edge, to a root: stars keep their nodes connected and have no more to gain.
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        ends = ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # One row a node, written: the joins then shuffle both sides anew, so that a hub's edges can be split.
        least = stage(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("m")), "cc-least")
        # Large-star: neighbours above a node go to the least of its neighbourhood; an edge is met at its lower end.
        large = edges.join(least, edges["b"] == least["n"]).select("a", F.col("m").alias("b"))
        down = stage(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "cc-down")
        # Small-star: a node's lower neighbours and the node itself go to the least of them.
        small = large.join(down, large["a"] == down["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = small.unionByName(down.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stage(new, "cc")
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4, groups: int | None = None) -> DataFrame:
    """(id, fingerprint in hex, component_id) of every row; component_id is the least non-null id of the rows that links
    reach, the row itself included (null where all are null). Null and empty texts have fingerprint zero and link like any
    other. An empty table gives no rows."""
    rows = stage(df.select(F.col(id_col).alias(f"{OWN}id"), fingerprints(F.col(text_col), shingle).alias("fp")), "simhash-rows")
    points = stage(rows.groupBy("fp").agg(F.min(f"{OWN}id").alias("least")), "simhash-points")
    found = components(links(points.select("fp"), most, groups))
    rooted = stage(points.join(found, points["fp"] == found["node"]).select("fp", "least", "root"), "simhash-roots")
    # Only fingerprints with links get another id than their own least one.
    heads = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    linked = rooted.join(heads, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    alone = points.join(rooted, "fp", "left_anti").select(F.col("fp").alias("f"), F.col("least").alias("component_id"))
    ids = stage(linked.unionByName(alone), "simhash-ids")
    out = rows.join(ids, F.col("fp") == F.col("f"))
    return out.select(F.col(f"{OWN}id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
