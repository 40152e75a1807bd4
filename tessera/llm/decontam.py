"""Benchmark decontamination by greedy string tiling.

Runs of SEED tokens that a document shares with a benchmark item are the seeds of a pair. Only pairs whose seeds could
cover enough of the item are tiled: the longest common run of unmarked tokens, found from running Karp-Rabin hashes and
compared token by token, is marked in both, again and again, until none of SEED tokens is left. The marked part of the item
is its coverage, whatever the order of the passages in the document. Memory follows the tokens of document and item, never
the pairs of places at which they agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, giving_back, slices, stage

#: Tokens of a seed, also the shortest tile; an item of fewer tokens is matched whole.
SEED = 5
#: Part of an item's tokens that tiles must cover.
COVERAGE = 0.8
#: Bytes of benchmark text that workers hold at once; larger benchmarks are taken in blocks.
BLOCK_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: ASCII to lower case, signs and control characters to space, on UTF-8 bytes.
FOLD = bytes(c if c > 127 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


#: Beyond ASCII: signs, which part words, and letters of scripts without spaces, which are words each.
_APART = regex.compile(r"[[^\x00-\x7f]--[\p{L}\p{N}\p{M}]]|[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*", regex.V1)


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words of letters, marks and digits; letters of scripts that put no spaces between words are words each."""
    low = (text or "").lower()
    if not low.isascii() and _APART.search(low):
        low = _APART.sub(lambda m: f" {m[0]} " if m[0][0].isalpha() else " ", low)
    return low.encode("utf-8", "surrogatepass").translate(FOLD).split()


def seeds(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each run of `length` ids."""
    m = max(0, len(ids) - length + 1)
    h, wide = np.zeros(m, np.uint64), (ids + 2).astype(np.uint64)
    for j in range(length):
        h = h * _BASE + wide[j : j + m]
    return h


def _running(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of id * base^place, and the powers of the base: the hash of a run is a difference, brought to place 0."""
    power = np.full(len(ids) + 1, _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum((ids + 2).astype(np.uint64) * power[:-1], out=sums[1:])
    return sums, power


def tile(item: np.ndarray, doc: np.ndarray, length: int) -> int:
    """Tokens of `item` that greedy string tiling with `doc` marks in tiles of at least `length`. Ids below 0 match nothing.

    Always the longest common run of unmarked tokens is next, of these the first in the item, then the first in the document.
    The length is found by halving, as parts of common runs are common; runs of one length are then marked in order.
    """
    (item_sums, power), (doc_sums, doc_power) = _running(item), _running(doc)
    top = len(power) + len(doc_power)
    scale = np.full(top, _BASE, np.uint64)  # brings the hash at a place to that at the place `top`
    scale[0] = 1
    np.cumprod(scale, out=scale)
    in_item, in_doc = item < 0, doc < 0

    def runs(sums: np.ndarray, marked: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the unmarked runs of n tokens."""
        taken = np.concatenate(([0], np.cumsum(marked)))
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return at, (sums[at + n] - sums[at]) * scale[top - 1 - at]

    def common(n: int) -> bool:
        return len(np.intersect1d(runs(item_sums, in_item, n)[1], runs(doc_sums, in_doc, n)[1])) > 0

    done, most = 0, min(len(item), len(doc))
    while most >= length and common(length):
        low, high = length, most + 1  # runs of `low` are common, runs of `high` are not
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if common(mid) else (low, mid)
        n = low
        (at, h), (places, hashes) = runs(item_sums, in_item, n), runs(doc_sums, in_doc, n)
        places = places[np.isin(hashes, h)]
        hashes = (doc_sums[places + n] - doc_sums[places]) * scale[top - 1 - places]
        order = np.argsort(hashes, kind="stable")  # places of one hash stay in order
        places, (values, begin) = places[order], np.unique(hashes[order], return_index=True)
        end, k = np.append(begin[1:], len(order)).tolist(), begin.tolist()
        slot = np.minimum(np.searchsorted(values, h), len(values) - 1)
        met = values[slot] == h
        free = 0
        for i, s in zip(at[met].tolist(), slot[met].tolist()):
            if i < free:
                continue
            for q in range(k[s], end[s]):
                d = int(places[q])
                if in_doc[d] or in_doc[d + n - 1]:  # tiles of this length can only reach in from an end
                    if q == k[s]:
                        k[s] += 1  # no run that begins here will be free again
                    continue
                if (item[i : i + n] == doc[d : d + n]).all():
                    in_item[i : i + n] = in_doc[d : d + n] = True
                    done, free = done + n, i + n
                    break
        most = n - 1
    return done


class Index:
    """Seeds of a block of benchmark items; rows: (item id, text), nulls and empty texts are never matched."""

    def __init__(self, rows: list[tuple], length: int = SEED, coverage: float = COVERAGE):
        self.length, self.coverage, self.vocab = length, coverage, {}
        self.items, self.ids = [], []
        grams: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for item, text in rows:
            words = tokens(text)
            if item is None or not words:
                continue
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int64)
            grams.setdefault(min(length, len(ids)), []).append((ids, len(self.items), len(ids)))
            self.items.append(item)
            self.ids.append(ids)
        # For each seed length (items shorter than a seed have their own): sorted hashes with item and position.
        self.tables = {}
        for n, group in grams.items():
            hashes = np.concatenate([seeds(ids, n) for ids, _, _ in group])
            item = np.concatenate([np.full(len(ids) - n + 1, k) for ids, k, _ in group])
            place = np.concatenate([np.arange(len(ids) - n + 1) for ids, _, _ in group])
            order = np.argsort(hashes, kind="stable")
            unique, begin = np.unique(hashes[order], return_index=True)
            self.tables[n] = (unique, np.append(begin, len(order)), item[order], place[order])

    def matches(self, texts: list[str | None]) -> list[list[tuple[float, object]]]:
        """(coverage, item id) of each text's items at or above the threshold, best first, then smallest id."""
        get = self.vocab.get
        ids = [np.array([get(w, -1) for w in tokens(t)], np.int64) for t in texts]
        ends = np.cumsum([len(x) for x in ids])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        found: list[dict[int, int]] = [{} for _ in texts]
        for n, (unique, begin, item, place) in self.tables.items():
            known = flat >= 0
            run = known[: max(0, len(flat) - n + 1)].copy()
            for j in range(1, n):
                run &= known[j : j + len(run)]
            at = np.flatnonzero(run)
            owner = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[owner] if len(at) else np.zeros(0, bool)
            at, owner = at[inside], owner[inside]
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = h * _BASE + (flat[at + j] + 2).astype(np.uint64)
            slot = np.minimum(np.searchsorted(unique, h), len(unique) - 1)
            hit = unique[slot] == h
            at, owner, slot = at[hit], owner[hit], slot[hit]
            for k in np.unique(owner).tolist():
                mine = owner == k
                self._document(ids[k], at[mine] - (ends[k] - len(ids[k])), slot[mine], n, begin, item, place, found[k])
        out = []
        for f in found:
            pairs = [(n / len(self.ids[k]), self.items[k]) for k, n in f.items() if n >= self.coverage * len(self.ids[k]) - 1e-9]
            out.append(sorted(pairs, key=lambda p: (-p[0], p[1])))
        return out

    def _document(self, doc, at, slot, n, begin, item, place, found) -> None:
        # Which places of which items this document's seeds reach: each seed counts once here.
        seen = np.unique(slot)
        reach = np.concatenate([np.arange(begin[s], begin[s + 1]) for s in seen.tolist()])
        items, places = item[reach], place[reach]
        order = np.lexsort((places, items))
        items, places = items[order], places[order]
        gap = np.full(len(items), n)
        gap[1:] = np.where(np.diff(items) == 0, np.minimum(n, np.diff(places)), n)
        which, first = np.unique(items, return_index=True)
        most = np.add.reduceat(gap, first)
        slots = np.repeat(seen, begin[seen + 1] - begin[seen])[order]
        ends = np.append(first[1:], len(items))
        for k, bound, b, e in zip(which.tolist(), most.tolist(), first.tolist(), ends.tolist()):
            ids = self.ids[k]
            if bound < self.coverage * len(ids) - 1e-9:
                continue  # all its seeds together can't cover enough
            mine = at[np.isin(slot, slots[b:e])]
            # The document without what no seed of the item reaches: runs of tokens, parted by an id that matches nothing.
            reached = np.zeros(len(doc) + 1, np.int64)
            np.add.at(reached, mine, 1)
            np.add.at(reached, mine + n, -1)
            reached = np.cumsum(reached[:-1]) > 0
            kept = reached.copy()
            kept[1:] |= reached[:-1]  # and one token after each run, to part it from the next
            found[k] = tile(ids, np.where(reached, doc, -1)[kept], n)


def _match_column(text: Column, index: Index, spark, kind: str) -> Column:
    shared = spark.sparkContext.broadcast(index)

    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        for texts in batches:
            found = [m for part in slices(texts, 2 << 20) for m in index.matches(part.to_pylist())]
            yield pa.array([[{"coverage": c, "item_id": i} for c, i in m] for m in found], pa.list_(pa.struct([("coverage", pa.float64()), ("item_id", pa.int64() if kind == "long" else pa.string())])))

    match = giving_back(match)
    match.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(match, f"array<struct<coverage:double,item_id:{kind}>>")(text)


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", length: int = SEED, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row with contaminated, coverage (the best, 0 below the threshold), item_id (of the best, else null) and
    item_ids (all items at or above the threshold, best first); columns of df with those names are replaced.

    Workers hold the benchmark where it has at most block_bytes, which is checked; a larger one is taken in blocks of that
    size, one scan of the documents for each. Null and empty texts match nothing; an item of fewer tokens than a seed
    is matched as a whole; an empty benchmark leaves all rows clean.
    """
    spark = df.sparkSession
    added = ["contaminated", "coverage", "item_id", "item_ids"]
    df = df.drop(*[c for c in df.columns if c.lower() in added and c != id_col])
    kind = "long" if dict(benchmark.dtypes)[item_col] in ("tinyint", "smallint", "int", "bigint") else "string"
    items = benchmark.select(F.col(item_col).cast(kind).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def index(k: int) -> Index:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        return Index(sorted(map(tuple, part.collect()), key=lambda r: (r[0], r[1])), length, coverage)

    hits = f"{OWN}hits"
    if blocks == 1:
        found = df.withColumn(hits, _match_column(F.col(text_col), index(0), spark, kind))
    else:
        # One narrow table a block: only contaminated rows are kept and met again by row number.
        df = stage(df.withColumn(f"{OWN}row", F.monotonically_increasing_id()), "decontam-rows")
        parts = []
        for k in range(blocks):
            made = df.select(f"{OWN}row", _match_column(F.col(text_col), index(k), spark, kind).alias("m"))
            parts.append(stage(made.where(F.size("m") > 0), "decontam-block"))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        every = every.groupBy(F.col(f"{OWN}row").alias(f"{OWN}of")).agg(F.flatten(F.collect_list("m")).alias(hits))
        by_best = F.array_sort(F.transform(hits, lambda x: F.struct((-x["coverage"]).alias("less"), x["item_id"].alias("item_id"))))
        best_first = F.transform(by_best, lambda x: F.struct((-x["less"]).alias("coverage"), x["item_id"].alias("item_id")))
        found = df.join(every, F.col(f"{OWN}row") == F.col(f"{OWN}of"), "left").withColumn(hits, F.coalesce(best_first, F.array().cast(f"array<struct<coverage:double,item_id:{kind}>>"))).drop(f"{OWN}row", f"{OWN}of")
    any_hit = F.size(hits) > 0
    return (
        found.withColumn("contaminated", any_hit)
        .withColumn("coverage", F.coalesce(F.get(hits, F.lit(0))["coverage"], F.lit(0.0)))
        .withColumn("item_id", F.get(hits, F.lit(0))["item_id"])
        .withColumn("item_ids", F.transform(hits, lambda x: x["item_id"]))
        .drop(hits)
    )
