"""Table functions: the words of an automaton and the paths of a grid as rows, made where the rows that ask for them are."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.functions import udtf

from . import automata, puzzles


@udtf(returnType="word string, length int")
class Words:
    """The words of a finite language, depth first in symbol order; the automaton is given in its text form. Symbols of a word
    are joined by commas. An infinite language is an error."""

    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        for w in automata.parse(text).enumerate():
            yield ",".join(map(str, w)), len(w)


@udtf(returnType="path string, length int")
class Paths:
    """The paths without a repeated square between two squares of a grid, as numbers of squares joined by commas."""

    def eval(self, rows: int, columns: int, start: int, end: int) -> Iterator[tuple[str, int]]:
        for p in puzzles.grid_paths(rows, columns, start, end):
            yield ",".join(map(str, p)), len(p)
