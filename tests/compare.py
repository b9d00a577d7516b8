"""Run registered queries on Spark and their statements on DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(glob.glob(f"{sf}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, query, sql):
    """None when equal, else a description of the difference."""
    df = query(spark, sf)
    scols, srows = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    dcols, drows = rows_of([d[0] for d in cur.description], cur.fetchall())
    if scols != dcols:
        return f"columns {scols} against {dcols}"
    if srows == drows:
        return None
    only_s, only_d = list((srows - drows).items()), list((drows - srows).items())
    return (f"{sum(srows.values())} against {sum(drows.values())} rows; "
            f"{len(only_s)} only in spark e.g. {sorted(only_s)[:2]}; {len(only_d)} only in duckdb e.g. {sorted(only_d)[:2]}")


if __name__ == "__main__":
    from conftest import make_session

    import __spark_entry__ as entry

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), duck(sf)
    oracle, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if name not in oracle or (wanted and not any(name.startswith(w) for w in wanted)):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, sf, name, query, oracle[name])
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{name:26s} {time.time() - t:6.1f}s", diff or "equal", flush=True)
    print("different:", bad)
