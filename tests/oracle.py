"""Compare registered queries with their SQL twins."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(df, con, text: str) -> list[str]:
    """What differs: columns, row count, exact values."""
    found = con.execute(text)
    names = [d[0] for d in found.description]
    expected = _rows(names, found.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
        return problems
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows, expected {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if repr(a) != repr(e)]
    if wrong:
        near = all(
            all(
                x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-5))
                for x, y in zip(a, e)
            )
            for a, e in wrong
        )
        problems.append(f"{len(wrong)} rows differ{' slightly' if near else ''}, e.g. {wrong[:3]}")
    if not expected:
        problems.append("no rows")
    return problems
