"""Runs a query and its SQL on the same tables."""

import glob
import os

import duckdb


def compare(spark, queries, oracles, name: str, folder: str) -> str:
    """Empty if the rows are the same whatever their order, else what differs."""
    got = queries[name](spark, folder).toPandas()
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(oracles[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    cols = sorted(got.columns)
    rows = [sorted(tuple(_plain(v) for v in r) for r in df[cols].itertuples(index=False)) for df in (got, want)]
    differ = [(a, b) for a, b in zip(*rows, strict=True) if a != b]
    return f"{len(differ)} rows differ, as {differ[0]}" if differ else ""


def _plain(v) -> str:
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v:
        return "null"
    if isinstance(v, float | int) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)
