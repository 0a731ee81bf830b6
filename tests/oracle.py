"""Compare a registered query with its SQL, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0 if v != 0 else 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, type(v).__name__, v if v is not None else 0) for v in r))


TYPES = {"long": "BIGINT", "integer": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty if equal in names, types and values."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    problems = []
    for f in df.schema.fields:
        mine = TYPES.get(f.dataType.typeName(), f.dataType.typeName())
        if mine != kinds[f.name]:
            problems.append(f"type of {f.name}: {mine} against {kinds[f.name]}")
    got, want = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(names, expected)
    if len(got) != len(want):
        problems.append(f"rows {len(got)} against {len(want)}")
    different = [(g, w) for g, w in zip(got, want) if g != w]
    if different:
        problems.append(f"{len(different)} different rows in {sorted(names)}, first {different[:2]}")
    return problems
