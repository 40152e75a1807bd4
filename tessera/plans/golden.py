"""Expected results of gadget operations, which SQL can't compute. tests/test_gadgets.py holds each against a simulation of
walking agents that shares no code with the kernel. Edges are listed as state, from, to, next state; undirected ones first."""

from __future__ import annotations

#: Left, right, what is made, in how many ways: of a wire, a diode and a directed step between two states.
COMBINED = [
    (1, 1, '0010|', 4),
    (1, 2, '|0010', 8),
    (1, 3, '|0011 0020 1120', 4),
    (1, 3, '|0011 1120', 8),
    (2, 1, '|0010', 4),
    (2, 2, '|0010', 4),
    (2, 3, '|0010', 2),
    (2, 3, '|0011 0020', 2),
    (2, 3, '|0011 1120', 4),
    (2, 3, '|0011', 2),
    (3, 1, '|0011 0020 1120', 2),
    (3, 1, '|0011 1120', 4),
    (3, 2, '|0010', 2),
    (3, 2, '|0011 0020', 2),
    (3, 2, '|0011 1120', 4),
    (3, 2, '|0011', 2),
    (3, 3, '|0011 0030 1122', 4),
    (3, 3, '|0011 0232 1233 2013', 2),
    (3, 3, '|0011 1122 2013 2230 3231', 4),
    (3, 3, '|0030 0121 1031', 4),
    (3, 3, '|0030 0210', 2),
]
#: Source, and what closing it makes.
CLOSED = [
    (1, '0010|0200 0210'),
    (2, '|0011 0020 1120'),
    (3, '|0010 0031 0131 1200 1210 1231'),
]
#: Operation, inputs, where the right is put and how turned, the point, and the locations that vanish.
DELETED = [
    ('combine', 1, 3, 0, 1, 1, '0,1'),
    ('combine', 1, 3, 0, 1, 5, '0,3'),
    ('combine', 1, 3, 1, 0, 0, '0,1'),
    ('combine', 1, 3, 1, 0, 2, '0,1'),
    ('combine', 1, 3, 2, 1, 1, '0,1'),
    ('combine', 1, 3, 2, 1, 3, '2,3'),
    ('combine', 1, 3, 3, 0, 2, '2,3'),
    ('combine', 1, 3, 3, 0, 4, '2,3'),
    ('combine', 3, 1, 0, 1, 3, '0,3'),
    ('combine', 3, 1, 0, 1, 5, '2,3'),
    ('combine', 3, 1, 1, 0, 0, '0,3'),
    ('combine', 3, 1, 1, 0, 4, '0,3'),
    ('connect', 2, None, None, None, 3, '2,3'),
    ('connect', 2, None, None, None, 5, '0,3'),
]
#: Gadgets and generations of a search from a 3-split and a diode.
FOUND = [
    ('0010 0020 0030 0120 0130 0230|', 1),
    ('0010 0020 0120|', 0),
    ('0010 0020 0120|0030 0130 0230', 2),
    ('0010 0020 0120|0300 0310 0320', 2),
    ('0010 0230|0020 0030 0120 0130', 2),
    ('0010|', 1),
    ('0010|0020 0120', 1),
    ('0010|0200 0210', 1),
    ('|0010 0020 0120', 2),
    ('|0010 0020 0210', 2),
    ('|0010 0020', 2),
    ('|0010 0210', 2),
    ('|0010', 0),
]


def _sql(rows: list[tuple], columns: dict[str, str]) -> str:
    literal = lambda x: "NULL" if x is None else repr(x)
    values = ", ".join(f"({', '.join(map(literal, r))})" for r in rows) or f"({', '.join('NULL' for _ in columns)})"
    return f"SELECT {', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in columns.items())} FROM (VALUES {values}) t({', '.join(columns)})"


GOLDEN = {
    "combine": _sql(COMBINED, {"in1": "BIGINT", "in2": "BIGINT", "made": "VARCHAR", "n": "INTEGER"}),
    "close": _sql(CLOSED, {"in1": "BIGINT", "made": "VARCHAR"}),
    "deleted": _sql(DELETED, {"kind": "VARCHAR", "in1": "BIGINT", "in2": "BIGINT", "splice": "INTEGER", "rotation": "INTEGER", "point": "INTEGER", "deleted": "VARCHAR"}),
    "search": _sql(FOUND, {"edges": "VARCHAR", "generation": "INTEGER"}),
}
