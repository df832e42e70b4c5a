"""Compare registered Spark queries with their DuckDB checks.

``python -m tests.compare SF [name …]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    """(equal, Spark row count, check row count, first differences)."""
    s_cols, s_rows = df.columns, df.collect()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, len(s_rows), len(d_rows), [("columns", sorted(s_cols), sorted(d_cols))]
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    diff = []
    if a != b:
        sa, sb = set(a), set(b)
        diff = [("spark", r) for r in sorted(sa - sb)[:3]] + [("check", r) for r in sorted(sb - sa)[:3]]
        diff.append(("cols", sorted(s_cols)))
    return a == b, len(a), len(b), diff


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from tests.spark import session

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark = session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    qs, os_ = e.queries(), e.oracle_sql()
    bad = 0
    for n, q in qs.items():
        if names and n not in names:
            continue
        t0 = time.time()
        try:
            if n in os_:
                df = q(spark, sf_dir)
                ok, ns, nd, diff = compare(df, con, os_[n])
                print(("ok  " if ok else "BAD ") + f"{n} spark={ns} check={nd} {time.time() - t0:.1f}s", flush=True)
                bad += not ok
                for d in diff:
                    print("    ", str(d)[:1200])
            else:
                print(f"rows {n} {q(spark, sf_dir).count()} {time.time() - t0:.1f}s", flush=True)
        except Exception as ex:  # report and go on with the next query
            bad += 1
            print(f"ERR  {n} {str(ex)[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
