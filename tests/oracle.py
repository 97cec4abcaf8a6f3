"""Compare a query's rows with its oracle's, as multisets with columns by name."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql: str) -> str:
    """'' if equal, else what differs."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows(names, got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(want) != len(have):
        return f"{len(have)} rows against {len(want)}; first {have[:1]} {want[:1]}"
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(bad)} of {len(want)} rows differ, e.g. {bad[:2]} columns {sorted(names)}" if bad else ""
