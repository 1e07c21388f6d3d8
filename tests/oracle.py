"""Compare the engine's queries with their SQL, as multisets of rows with columns sorted by name."""

import math
import time

import duckdb

from heddle.queries import NAMES


def connect(sf_dir):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v) if type(v).__name__ == "Decimal" else v


def normal(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


def difference(spark, con, plan, sql, sf_dir):
    began = time.time()
    df = plan(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - began
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = found.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}", took, len(got)
    a, b = normal(df.columns, got), normal(names, want)
    if a != b:
        return f"{len(a)} rows against {len(b)}: {sorted(set(a) - set(b))[:2]} / {sorted(set(b) - set(a))[:2]}", took, len(got)
    return None, took, len(got)
