"""Order-free comparison of a Spark result with the SQL result on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def normalise(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if schema and values agree, else a short account."""
    relation = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in relation.description}
    theirs = normalise(list(kinds), relation.fetchall())
    ours = normalise(df.columns, [tuple(r) for r in df.collect()])
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    wrong = {c: (t, kinds[c]) for c, t in df.dtypes if KINDS.get(t) != kinds[c] and kinds[c] != "STRING"}
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]) - set(theirs[1]), set(theirs[1]) - set(ours[1])
        return f"values: {len(a)} only ours e.g. {sorted(a)[:2]}; only theirs {sorted(b)[:2]}"
    return f"types {wrong}" if wrong else None
