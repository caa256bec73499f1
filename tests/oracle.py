"""Compare a Spark result with the result of its SQL text in DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    return Counter(repr([plain(row[i]) for i in order]) for row in data)


def compare(con, df, sql) -> list[str]:
    """Differences as messages; empty if names, row count and values agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    theirs = rows(names, result.fetchall())
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if ours == theirs:
        return []
    return [
        f"rows {sum(ours.values())} vs {sum(theirs.values())}",
        f"only Spark: {list((ours - theirs).items())[:3]}",
        f"only SQL: {list((theirs - ours).items())[:3]}",
    ]
