"""Compare registered queries with their oracle SQL, value by value."""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal

import duckdb

from plumbline.queries.registry import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_value(x) for x in v) + "]"
    return str(v)


def _kind(v):
    return "number" if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else type(v).__name__


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a short description of the first difference."""
    relation = con.execute(sql)
    want_cols = [d[0] for d in relation.description]
    want_types = {d[0]: str(d[1]) for d in relation.description}
    want = relation.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    integer = {"BIGINT", "INTEGER", "SMALLINT", "TINYINT", "HUGEINT"}
    for name, dtype in df.dtypes:
        t = want_types[name].upper()
        same = (
            (dtype in ("bigint", "int", "smallint", "tinyint") and t in integer - {"HUGEINT"})
            or (dtype in ("double", "float") and t in ("DOUBLE", "FLOAT"))
            or (dtype == "string" and t in ("VARCHAR", "STRING"))
            or (dtype == "boolean" and t in ("BOOLEAN", "BOOL"))
            or (dtype == "date" and t == "DATE")
            or (dtype.startswith("timestamp") and t.startswith("TIMESTAMP"))
            or (dtype.startswith("array") and t.endswith("[]"))
        )
        if not same:
            return f"type of {name}: {dtype} != {t}"
    a, b = _rows(df.columns, got), _rows(want_cols, want)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:3]
        lost = [x for x in b if x not in set(a)][:3]
        return f"rows {len(a)} != {len(b)}; extra {str(extra)[:300]}; lost {str(lost)[:300]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(df.columns)}: {str(x)[:400]} != {str(y)[:400]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from plumbline.queries import catalog
    from plumbline.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in catalog.ORACLE:
                problem = compare(df, con, catalog.ORACLE[name])
                rows = con.execute(f"SELECT count(*) FROM ({catalog.ORACLE[name]}) q").fetchone()[0]
            else:
                problem, rows = None, f"{len(df.collect())} (no oracle)"
        except Exception as e:  # noqa: BLE001 - report and go on
            problem, rows = f"{type(e).__name__}: {str(e)[:900]}", "-"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name} rows={rows} {problem or ''}", flush=True)
    print("failures:", bad)
