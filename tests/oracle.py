"""Compare a query with its SQL, rows as multisets and columns by name."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def difference(df, con, sql: str) -> str:
    """Empty where both agree."""
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(r[k] for k in order) for r in rel.fetchall()]
    a, b = Counter(rows), Counter(want)
    return "" if a == b else f"{len(rows)} and {len(want)} rows; only here {list((a - b).items())[:3]}, only there {list((b - a).items())[:3]}"
