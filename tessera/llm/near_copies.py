"""Near copies by the words themselves: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash groups and MinHash bands bring similar documents into common cells; within a cell sets are compared exactly before a
pair is linked. A pair of similarity 0.8 shares no band in (1 - 0.8 ** BAND) ** BANDS = 5 of 100,000 cases, a closer pair less
often. Texts of the same words are one point throughout. A first wave compares the SimHash groups and FIRST bands, large cells
in blocks; a second wave compares what is left: in cells that still hold several components, all rows outside the largest of
them with all others. So a large group of near copies, which the first wave connects, isn't compared in all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, giving_back, of_rows, stage
from .exact_dedup import WHITE
from .simhash import components, near_duplicates

SHINGLE = 5
#: Least Jaccard similarity of near copies, as a fraction.
LEAST = (4, 5)
#: Bands, the MinHashes that must agree in one, and the bands of the first wave.
BANDS, BAND, FIRST = 25, 5, 5
#: Documents of a cell that one task compares at once, or each of two blocks of a larger cell.
CELL_ROWS = 500
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(17)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * BAND, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, BANDS * BAND, np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 of the text's shingles, in order; a shorter text is one shingle, no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    k = min(shingle, n)
    begin = np.concatenate(([0], ends[: n - k] + 1)).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(line[b:e], 7) for b, e in zip(begin, ends[k - 1 :].tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):  # bounded memory for long texts
        least = np.minimum(least, ((hashes[at : at + 1024, None] ^ _FLIP) * _TIMES).min(0))
    return [xxhash.xxh64_intdigest(band.tobytes(), b) - (1 << 63) for b, band in enumerate(least.reshape(BANDS, BAND))]


def bands(text: Column) -> Column:
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([band_keys(shingles(t.as_py())) for t in texts], pa.list_(pa.int64()))

    make = giving_back(make)
    make.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(make, "array<long>")(text)


def similar(sets: list[np.ndarray], roots: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of non-empty sets that are near copies, by their places; sets of one root are connected.

    Each set is compared with all larger ones of a possible size that no link connects to it yet.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    words, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(sizes)))
    ends = np.searchsorted(sizes * LEAST[0], sizes * LEAST[1], "right").tolist()
    label = np.arange(len(sets)) if roots is None else np.unique(np.array(roots)[order], return_inverse=True)[1]
    mark, out = np.zeros(len(words), bool), []
    for i in range(len(sets)):
        end = ends[i]
        if end <= i + 1 or (label[i + 1 : end] == label[i]).all():
            continue
        own = codes[at[i] : at[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[codes[at[i + 1] : at[end]]].astype(np.int64), at[i + 1 : end] - at[i + 1])
        mark[own] = False
        near = np.flatnonzero(common * LEAST[1] >= (sizes[i] + sizes[i + 1 : end] - common) * LEAST[0]) + i + 1
        for j in near.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((order[i], order[j]))
    return out


def _compare(batches):
    """mapInArrow function over (task, row, root, text) sorted by task: links (a, b) of rows."""

    def links(rows: list[int], roots: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = similar(sets, roots) if len(set(roots)) > 1 else []
        a, b = ([rows[p[k]] for p in found] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    task, rows, roots, sets = None, [], [], []
    for batch in batches:
        for t, r, root, x in zip(*(batch.column(c).to_pylist() for c in ("task", "row", "root")), batch.column("text")):
            if t != task:
                if len(rows) > 1:
                    yield links(rows, roots, sets)
                task, rows, roots, sets = t, [], [], []
            rows.append(r)
            roots.append(root)
            sets.append(shingles(x.as_py()))
    if len(rows) > 1:
        yield links(rows, roots, sets)


def groups(points: DataFrame, cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the points (row, bands) that near copies in common cells connect, root the least row; points without
    any are absent. cells (row, cell) are further ones beside the bands; texts (row, text) may hold more rows than points."""
    every = points.select("row", F.posexplode("bands").alias("band", "cell")).select("row", "cell", (F.col("band") < FIRST).alias("early"))
    every = stage(every.unionByName(cells.select("row", "cell", F.lit(True).alias("early"))), "copies-cells")
    sizes = every.groupBy(F.col("cell").alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = every.join(stage(sizes, "copies-sizes"), F.col("cell") == F.col("c")).select("row", "cell", "early", "n")
    met = stage(met.withColumn("parts", F.expr(f"cast((n + {CELL_ROWS} - 1) div {CELL_ROWS} as int)")), "copies-met")
    # Texts only of rows that share a cell, which are few where copies are.
    some = stage(of_rows(texts, "row", met.select("row").distinct()), "copies-texts")

    def compared(tasks: DataFrame) -> DataFrame:
        full = tasks.join(some, "row").select("task", "row", "root", "text").repartition("task").sortWithinPartitions("task")
        return stage(full.mapInArrow(giving_back(_compare), "a long, b long"), "copies-links")

    part = F.pmod(F.xxhash64("row", "cell"), "parts").cast("int")
    first = compared(met.where("early").select("row", F.col("row").alias("root"), F.xxhash64("cell", part).alias("task")))
    roots = stage(components(first), "copies-roots")
    rooted = met.join(roots, F.col("row") == F.col("node"), "left").withColumn("root", F.coalesce("root", "row")).drop("node")
    rooted = stage(rooted, "copies-rooted")
    held = rooted.groupBy(F.col("cell").alias("c"), "root").agg(F.count(F.lit(1)).alias("m"), F.first("early").alias("done"), F.first("n").alias("of"))
    held = held.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("m", "root")).alias("main"), F.first("done").alias("done"), F.first("of").alias("of"))
    left = held.where(f"k > 1 and not (done and of <= {CELL_ROWS})")
    left = stage(left.select("c", F.col("main.root").alias("main"), F.expr(f"cast((of - main.m + {CELL_ROWS} - 1) div {CELL_ROWS} as int)").alias("others")), "copies-left")
    again = rooted.join(left, F.col("cell") == F.col("c"))
    # Blocks of all rows of a cell meet blocks of those outside its largest component.
    own, other = F.pmod(F.xxhash64("row"), "parts").cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), "others").cast("int")
    in_all = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(own.alias("i"), j.alias("j")))
    in_other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("i"), other.alias("j")))
    places = F.when(F.col("root") == F.col("main"), in_all).otherwise(F.array_union(in_all, in_other))
    again = again.select("row", "root", "cell", F.explode(places).alias("at")).select("row", "root", F.xxhash64("cell", "at.i", "at.j").alias("task"))
    second = compared(again)
    if second.isEmpty():
        return roots
    return components(second.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def words_key(text: Column) -> Column:
    """SHA-256 of the text's words, A-Z in lower case, with one space between; null has none, like an empty text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.sha2(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), WHITE, " ")), 256)


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group that near copies connect: the one of the least id, of these or where all are null any
    one. Rows count, not ids: another text of an id that goes stays. Texts of the same words are copies, texts without a word
    or null of each other too. An empty table gives no rows."""
    row, key = f"{OWN}row", f"{OWN}key"
    numbered = stage(df.withColumn(row, F.monotonically_increasing_id()), "copies-rows")
    texts = numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    made = numbered.select(words_key(F.col(text_col)).alias(key), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("m"), bands(F.col(text_col)).alias("bands"))
    # Copies have the same bands: one row for each sequence of words goes on.
    points = stage(made, "copies-bands").groupBy(key).agg(F.min("m").alias("m"), F.first("bands").alias("bands"))
    points = stage(points.select(F.col("m.row").alias("row"), "m", "bands"), "copies-points")
    alike = near_duplicates(numbered.select(row, text_col), row, text_col, shingle=SHINGLE)
    alike = alike.select(F.col(row).alias("r"), F.xxhash64(F.lit("simhash"), "component_id").alias("cell"))
    cells = points.where(F.size("bands") > 0).select("row").join(alike, F.col("row") == F.col("r")).select("row", "cell")
    found = groups(points.select("row", "bands"), cells, texts)
    found = points.select("row", "m").join(found, F.col("row") == F.col("node"), "left").select(F.coalesce("root", "row").alias("root"), "m")
    kept = found.groupBy("root").agg(F.min("m").alias("m")).select(F.col("m.row").alias(row))
    return of_rows(numbered, row, kept).select(*[F.col(f"`{c}`") for c in df.columns])
