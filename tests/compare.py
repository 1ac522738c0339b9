"""Run registered queries on both engines and compare the results, order-free."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    return v


def _kind(v):
    return "none" if v is None else type(v).__name__


# queries whose result may be empty at the smallest scale
MAY_BE_EMPTY = frozenset({"audit_filter"})


def compare(spark, folder: str, fn, sql: str, name: str = "") -> tuple[bool, str]:
    df = fn(spark, folder)
    got = [{k: _plain(v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()]
    rel = connection(folder).execute(sql)
    names = [d[0] for d in rel.description]
    want = [dict(zip(names, map(_plain, r))) for r in rel.fetchall()]
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    cols = sorted(names)
    a = sorted((tuple(r[c] for c in cols) for r in got), key=repr)
    b = sorted((tuple(r[c] for c in cols) for r in want), key=repr)
    if a == b and not a and name not in MAY_BE_EMPTY:
        return False, "both results are empty: the query proves nothing here"
    if a == b:
        kinds = {(c, _kind(r[c])) for r in got for c in cols} ^ {(c, _kind(r[c])) for r in want for c in cols}
        return True, f"{len(a)} rows" + (f" KINDS {sorted(kinds)}" if kinds else "") + (
            "" if a else " EMPTY")
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return False, f"rows {len(a)} vs {len(b)}; cols {cols}\n   spark {only_a}\n   sql   {only_b}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from accountloom.session import local_session

    folder = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    qs, sqls = entry.queries(), entry.oracle_sql()
    spark = local_session()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                ok, msg = compare(spark, folder, fn, sqls[name], name)
            else:
                ok, msg = True, f"no sql, {len(fn(spark, folder).collect())} rows"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, round(time.time() - t, 1), msg, flush=True)
    print("failures", bad)
