"""Compare a query with its SQL as the driver does: rows, columns, types by family, multiset of values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


#: Spark's type for each DuckDB type that a query may return.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "smallint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """An empty string, or what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cur = views(sf_dir).execute(sql)
    names = [x[0] for x in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours_types, theirs_types = {k: v.replace("_ntz", "") for k, v in df.dtypes}, {x[0]: TYPES.get(str(x[1]), str(x[1])) for x in cur.description}
    if ours_types != theirs_types:
        return f"types {sorted(set(ours_types.items()) ^ set(theirs_types.items()))}"
    if not ours:
        return "no rows, which proves nothing"
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"
    return ""
