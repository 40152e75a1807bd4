"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target number of words. A source whose target exceeds its size is taken whole that many times; for the
remaining budget its documents are counted by exact length, a proportional part of each length is taken short of the budget
by FILL words, and bounded-knapsack dynamic programming over all documents left fills what remains as nearly as any choice of
them can. Which documents of a length are taken follows a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, stage

#: Documents of one source and length that one task ranks.
RANK_ROWS = 2000
#: The knapsack fills a rest of about so many words; larger rests are first filled by whole lengths.
FILL = 1 << 16
#: Lengths of all sources, and parts of large ones, that are broadcast at most.
PLAN_ROWS = 50_000


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Sources in code-point order, null last, have the weights in turn. They share `share` of all words by weight; a target
    above `most` times its source's size stops there and the excess goes to the others by weight, until none is above.
    In order of cap / weight the sources that stop come first, so prefix sums give the level of the others. All sources meet
    in one task, a row of two numbers each.
    """
    listed = F.expr(f"element_at(array({','.join(map(str, weights))}), cast(({OWN}rank - 1) % {len(weights)} as int) + 1)")
    everything = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn(f"{OWN}rank", F.row_number().over(everything)).withColumn(f"{OWN}w", listed.cast("double"))
    cap, w = F.col(f"{OWN}cap"), F.col(f"{OWN}w")
    ranked = ranked.withColumn(f"{OWN}cap", (F.col("source_size") * most).cast("double"))
    by_ratio = Window.orderBy(cap / w, f"{OWN}rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = ranked.withColumn(
        f"{OWN}level",
        (F.sum("source_size").over(whole) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        / (F.sum(w).over(whole) - F.coalesce(F.sum(w).over(before), F.lit(0.0))),
    )
    stopped = F.col(f"{OWN}level") * w > cap
    first_free = F.min_by(f"{OWN}level", F.when(~stopped, F.struct(cap / w, F.col(f"{OWN}rank")))).over(whole)
    return level.select("source", "source_size", F.when(stopped, cap).otherwise(F.least(cap, first_free * w)).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near the budget as possible.

    Where the budget is above FILL, a proportional part of each length first, short of the budget by FILL, then whole lengths
    from the longest while FILL is left; then bounded-knapsack dynamic programming over all documents left: reachable sums
    are the bits of one integer, counts are split into powers of two. A budget of at most FILL is met as nearly as any choice
    of documents can, from below where both sides are as near.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    # Exact integer parts; Python integers can't overflow.
    most = max(0, budget - FILL)
    taken = np.array([int(c) * most // total if n else 0 for n, c in zip(lengths, counts)], np.int64)
    rest = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if rest <= 2 * FILL or not lengths[i]:
            break
        more = min(int(counts[i] - taken[i]), (rest - FILL) // int(lengths[i]))
        taken[i] += more
        rest -= more * int(lengths[i])
    # Sums of up to twice the rest: none further above it is nearer than taking nothing.
    mask, reach, items = (1 << (2 * rest + 1)) - 1, 1, []
    for i in order[::-1]:  # short lengths reach many sums with few items
        left, size = int(counts[i] - taken[i]), int(lengths[i])
        if not size or size > 2 * rest:
            continue
        left, k = min(left, 2 * rest // size), 1
        while left and not reach >> rest & 1:
            use = min(k, left)
            new = reach | reach << size * use & mask
            if new != reach:
                items.append((i, use, size * use, reach))
                reach = new
            left, k = left - use, k * 2
        if reach >> rest & 1:
            break
    below = (reach & (1 << (rest + 1)) - 1).bit_length() - 1
    above = reach >> rest
    above = rest + (above & -above).bit_length() - 1 if above else None
    best = above if above is not None and above - rest < rest - below else below
    for i, use, weight, before in reversed(items):
        if not before >> best & 1:
            taken[i] += use
            best -= weight
    return taken


def _fit_source(lengths: pd.DataFrame) -> pd.DataFrame:
    """One source's (source, size, n, source_size, target): the documents to take of each length; copies is common to all."""
    lengths = lengths.sort_values("size").reset_index(drop=True)
    size, target = int(lengths["source_size"].iloc[0]), float(lengths["target"].iloc[0])
    copies = int(target // size) if size else 0
    budget = int(round(target - copies * size))
    take = fit(lengths["size"].to_numpy(), lengths["n"].to_numpy(), budget)
    return lengths.assign(copies=np.int64(copies), take=take)[["source", "size", "n", "source_size", "target", "copies", "take"]]


def mix(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Every row with size, source_size, target and times: how often the mix takes it (0 to most).

    carry names further columns to return (default: the others of df, whole rows). Null texts have size 0, a null source
    is a source of its own. Sources of size 0 have target 0. Rows of one source and length are chosen by a seeded hash of
    id and text, and equal rows by their number in the scan, so that reruns agree. Columns of df with the
    names of added ones are replaced. An empty table gives no rows.
    """
    added = {"size", "source_size", "target", "times"}
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in added | {id_col.lower(), source_col.lower()}]
    rows = stage(
        df.select(
            F.col(id_col).alias(f"{OWN}id"),
            F.col(source_col).alias(f"{OWN}source"),
            words(F.col(text_col)).alias(f"{OWN}size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias(f"{OWN}hash"),
            F.monotonically_increasing_id().alias(f"{OWN}row"),
            *[F.col(f"`{c}`") for c in carry],
        ),
        "mix-sizes",
    )
    own = lambda c: F.col(f"{OWN}{c}")
    lengths = stage(rows.groupBy(own("source").alias("source"), own("size").alias("size")).agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    goals = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    goals = goals.withColumnRenamed("source", "goal_of")
    with_goals = lengths.join(goals, F.col("source").eqNullSafe(F.col("goal_of"))).select("source", "size", "n", "source_size", "target")
    plan = with_goals.groupBy("source").applyInPandas(_fit_source, "source string, size long, n long, source_size long, target double, copies long, take long")
    # One row for each source and length, which the fit of a lost task must not change: written once.
    plan = stage(plan, "mix-plan").select(*[F.col(c).alias(f"{OWN}{k}") for c, k in _PLAN.items()], F.expr(f"n div {RANK_ROWS} + 1").alias(f"{OWN}parts"))
    plan = _small(plan)
    chosen = rows.join(plan, own("source").eqNullSafe(own("s")) & (own("size") == own("z")))
    # The hash orders a length's documents; its upper part deals a large group into parts of about RANK_ROWS, in order.
    part = F.pmod(F.xxhash64(own("hash")), F.lit(1 << 20)) * own("parts") / F.lit(1 << 20)
    chosen = chosen.withColumn(f"{OWN}part", F.floor(part))
    group = [f"{OWN}s", f"{OWN}z", f"{OWN}part"]
    # Only the lengths of which some but not all are taken need ranks.
    some = (own("take") > 0) & (own("take") < own("n"))
    flat = chosen.where(~some).withColumn(f"{OWN}times", own("copies") + F.when(own("take") > 0, 1).otherwise(0))
    split = chosen.where(some)
    before = split.groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy(f"{OWN}s", f"{OWN}z").orderBy(f"{OWN}part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*[F.col(c).alias(f"{c}2") for c in group], F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias(f"{OWN}before"))
    before = _small(stage(before, "mix-before"))
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}2"))
    rank = own("before") + F.row_number().over(Window.partitionBy(*group).orderBy(f"{OWN}hash", f"{OWN}row"))
    ranked = split.join(before, same).withColumn(f"{OWN}rank", rank)
    ranked = ranked.withColumn(f"{OWN}times", own("copies") + F.when(own("rank") <= own("take"), 1).otherwise(0))
    out = [own("id").alias(id_col), own("source").alias(source_col), own("size").alias("size"), own("source_size").alias("source_size"), own("target").alias("target"), own("times").alias("times"), *[F.col(f"`{c}`") for c in carry]]
    return flat.select(*out).unionByName(ranked.select(*out))


#: Columns of the plan, and what they are called beside the rows' own columns.
_PLAN = {"source": "s", "size": "z", "n": "n", "source_size": "source_size", "target": "target", "copies": "copies", "take": "take"}


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast where it has at most PLAN_ROWS rows of a few numbers; else Spark chooses the join."""
    return F.broadcast(df) if df.count() <= PLAN_ROWS else df


def digest(mixed: DataFrame) -> DataFrame:
    """The columns of op10 from mixed rows."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
