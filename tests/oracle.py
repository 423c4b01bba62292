"""Run registered queries against DuckDB and compare rows, columns and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from skytriage.plans.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}" if v != 0 else "0"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(list(v.asDict().values()))
    if isinstance(v, dict):
        return _norm(list(v.values()))
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return str(v)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir, name, fn, sql):
    """(ok, message) for one query."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    data = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return bool(data), f"{name}: rows only, {len(data)} rows, {took:.1f}s"
    t1 = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    ddata = cur.fetchall()
    dtook = time.time() - t1
    if sorted(cols) != sorted(dcols):
        return False, f"{name}: columns {sorted(cols)} vs {sorted(dcols)}"
    a, b = rows_of(cols, data), rows_of(dcols, ddata)
    types = dict(df.dtypes)
    odd = [f"{c}:{types[c]}/{dtypes[c]}" for c in cols if _family(types[c]) != _family(dtypes[c])]
    note = f" TYPES {odd}" if odd else ""
    if len(a) != len(b):
        return False, f"{name}: {len(a)} rows vs {len(b)}{note}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return False, f"{name}: {len(diff)} of {len(a)} rows differ, e.g. {diff[0]} (cols {sorted(cols)}){note}"
    return not odd, f"{name}: ok {len(a)} rows spark {took:.1f}s duckdb {dtook:.1f}s{note}"


def _family(t):
    t = t.lower()
    for key, fam in (("bigint", "long"), ("hugeint", "huge"), ("int", "int"), ("double", "double"), ("float", "float"),
                     ("varchar", "str"), ("string", "str"), ("bool", "bool"), ("timestamp", "ts"), ("decimal", "dec")):
        if t.startswith(key):
            return fam
    return "array" if t.startswith("array") or t.endswith("[]") else t[:6]


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from skytriage.session import build_session

    sf = argv[1]
    wanted = argv[2:]
    spark = build_session("oracle", "local[8]", 8, spark__ui__enabled="false", spark__driver__memory="12g")
    con = connect(sf)
    qs, os_ = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, msg = compare(spark, con, sf, name, fn, os_.get(name))
        except Exception as exc:  # report and go on with the others
            ok, msg = False, f"{name}: {type(exc).__name__} {str(exc)[:700]}"
        bad += not ok
        print("  " if ok else "BAD ", msg, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv)
