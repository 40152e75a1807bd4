"""Regular expressions built by calls, folded as they are built, compiled when a query is planned.

Rx.matches(column) turns the minimal automaton into one native expression: a fold over the column's array of symbols through
a table literal, so that no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automata as A


@dataclass(frozen=True)
class Rx:
    """kind: empty, all, epsilon, any, lit, cat, alt, conj, repeat or comp; bounds: least and most (None: unlimited)."""

    alphabet: int
    kind: str
    parts: tuple[Rx, ...] = ()
    word: tuple[int, ...] = ()
    bounds: tuple[int, int | None] = (1, 1)

    def compile(self) -> A.Automaton:
        n, kind = self.alphabet, self.kind
        parts = [p.compile() for p in self.parts]
        if kind == "lit":
            return A.lit(n, *self.word)
        if kind == "repeat":
            least, most = self.bounds
            if most is None:
                return A.at_least(parts[0], least)
            return A.copies(parts[0], least) if least == most else A.between(parts[0], least, most)
        if kind == "conj":
            return A.conj(n, *(p.minimize() for p in parts))
        if kind == "comp":
            return A.comp(parts[0])
        if kind in ("cat", "alt"):
            return {"cat": A.cat, "alt": A.alt}[kind](n, *parts)
        return {"empty": A.empty, "all": A.all_words, "epsilon": A.epsilon, "any": A.any_symbol}[kind](n)

    def matches(self, word: Column) -> Column:
        """Whether the whole array of symbols is a word of the language; null stays null, symbols outside it reject."""
        dfa = self.compile().canonical()
        if dfa.is_empty():
            return F.when(word.isNotNull(), F.lit(False))
        n, dead = self.alphabet, len(dfa.rows)
        if dead == 1 and len(dfa.rows[0]) == n and 0 in dfa.accept:
            return F.when(word.isNotNull(), F.forall(word, lambda x: x.between(0, n - 1)))
        table = [next(iter(r[a])) if a in r else dead for r in [*dfa.rows, {}] for a in range(n)]
        step = lambda s, x: F.when(x.between(0, n - 1), F.element_at(F.array(*map(F.lit, table)), (s * n + x + 1).cast("int"))).otherwise(F.lit(dead))
        end = F.aggregate(word, F.lit(0), step)
        return end.isin(*sorted(dfa.accept))

    def enumerate(self) -> Iterator[tuple[int, ...]]:
        return self.compile().enumerate()

    def words(self, spark: SparkSession) -> DataFrame:
        """All words of a finite language as (word string of symbols joined by commas, length)."""
        return spark.createDataFrame([(",".join(map(str, w)), len(w)) for w in self.enumerate()], "word string, length int")

    def is_empty(self) -> bool:
        return self.compile().is_empty()

    def is_infinite(self) -> bool:
        return self.compile().is_infinite()

    def __str__(self) -> str:
        if self.kind == "lit":
            return "".join(map(str, self.word))
        if self.kind in ("empty", "all", "epsilon", "any"):
            return {"empty": "∅", "all": "Σ*", "epsilon": "ε", "any": "."}[self.kind]
        inner = [f"({p})" for p in self.parts]
        if self.kind == "repeat":
            least, most = self.bounds
            return inner[0] + f"{{{least},{'' if most is None else most}}}"
        return "~" + inner[0] if self.kind == "comp" else {"cat": "", "alt": "|", "conj": "&"}[self.kind].join(inner)


def empty(n: int) -> Rx:
    return Rx(n, "empty")


def all_words(n: int) -> Rx:
    return Rx(n, "all")


def epsilon(n: int) -> Rx:
    return Rx(n, "epsilon")


def any_symbol(n: int) -> Rx:
    return Rx(n, "any")


def lit(n: int, *word: int) -> Rx:
    return Rx(n, "lit", word=word) if word else epsilon(n)


def _flat(kind: str, parts, drop: str) -> list[Rx]:
    level = [q for p in parts for q in (p.parts if p.kind == kind else (p,))]
    return [p for p in level if p.kind != drop]


def cat(n: int, *parts: Rx) -> Rx:
    parts = _flat("cat", parts, "epsilon")
    if any(p.kind == "empty" for p in parts):
        return empty(n)
    return parts[0] if len(parts) == 1 else Rx(n, "cat", tuple(parts)) if parts else epsilon(n)


def alt(n: int, *parts: Rx) -> Rx:
    parts = list(dict.fromkeys(_flat("alt", parts, "empty")))
    return parts[0] if len(parts) == 1 else Rx(n, "alt", tuple(parts)) if parts else empty(n)


def conj(n: int, *parts: Rx) -> Rx:
    parts = list(dict.fromkeys(_flat("conj", parts, "all")))
    if any(p.kind == "empty" for p in parts):
        return empty(n)
    return parts[0] if len(parts) == 1 else Rx(n, "conj", tuple(parts)) if parts else all_words(n)


def repeat(x: Rx, least: int, most: int | None) -> Rx:
    n = x.alphabet
    if most == 0:
        return epsilon(n)
    if (least, most) == (1, 1) or x.kind in ("epsilon", "all"):
        return x
    if x.kind == "empty":
        return epsilon(n) if least == 0 else x
    if x.kind == "any" and (least, most) == (0, None):
        return all_words(n)
    if x.kind == "repeat":
        inner_least, inner_most = x.bounds
        if (least, most) == (0, None) and inner_least <= 1:
            return repeat(x.parts[0], 0, None)
        if least == most and inner_least == inner_most:  # both bounded and exact
            return repeat(x.parts[0], least * inner_least, least * inner_least)
    return Rx(n, "repeat", (x,), bounds=(least, most))


def star(x: Rx) -> Rx:
    return repeat(x, 0, None)


def plus(x: Rx) -> Rx:
    return repeat(x, 1, None)


def maybe(x: Rx) -> Rx:
    return repeat(x, 0, 1)


def comp(x: Rx) -> Rx:
    if x.kind == "comp":
        return x.parts[0]
    return {"empty": all_words, "all": empty}[x.kind](x.alphabet) if x.kind in ("empty", "all") else Rx(x.alphabet, "comp", (x,))


def at_positions(n: int, fixed: dict[int, Rx], length: int) -> Rx:
    """Words of `length` symbols with the given one-symbol expressions at some positions."""
    return cat(n, *(fixed.get(k, any_symbol(n)) for k in range(length)))


def at_least_of(x: Rx, required: int, total: int) -> Rx:
    """Words of `total` symbols with at least `required` that the one-symbol expression x has."""
    n = x.alphabet
    free = star(any_symbol(n))
    return conj(n, repeat(any_symbol(n), total, total), cat(n, free, *[y for _ in range(required) for y in (x, free)]))
