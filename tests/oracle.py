"""Compare a Spark result with DuckDB: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(
        tuple(_plain(r[i]) for i in order) for r in rows
    )


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    rel = con.execute(sql)
    dn, db = _bag([d[0] for d in rel.description], rel.fetchall())
    sn, sb = _bag(df.columns, [tuple(r) for r in df.collect()])
    if dn != sn:
        return f"columns {sn} != {dn}"
    if sum(db.values()) != sum(sb.values()):
        return f"rows spark {sum(sb.values())} != sql {sum(db.values())}"
    if db != sb:
        return f"only spark {list((sb - db).items())[:2]} only sql {list((db - sb).items())[:2]}"
    return None
