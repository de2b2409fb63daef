"""Runs queries beside their SQL: python tests/oracle.py DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """'' if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows; only here {list(set(mine) - set(theirs))[:2]}, only there {list(set(theirs) - set(mine))[:2]}"
    diff = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(diff)} of {len(mine)} rows differ: {diff[0]}" if diff else ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from kinloom.session import build_session

    spark, d = build_session(), sys.argv[1]
    con, qs, sqls = connect(d), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sorted(qs):
        t = time.time()
        if name not in sqls:
            if len(sys.argv) > 2:
                print(name, "rows", qs[name](spark, d).count(), round(time.time() - t, 1), flush=True)
            continue
        try:
            said = compare(spark, con, name, qs[name], sqls[name], d)
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:700]}"
        print(name, said or "same", round(time.time() - t, 1), flush=True)
