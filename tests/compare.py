"""Run registered queries next to their SQL in DuckDB: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def normal(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def differences(df, con, sql: str) -> str | None:
    got = normal(df.columns, df.collect())
    cur = con.execute(sql)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} vs {len(want[1])}; only here {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return None if got[1] else "no rows"


SAME = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def type_differences(df, con, sql: str) -> list[str]:
    """Columns whose types differ, such as INTEGER and BIGINT."""
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{f.name}: {f.dataType.simpleString()} / {theirs.get(f.name)}" for f in df.schema if SAME.get(f.dataType.simpleString()) != theirs.get(f.name)]


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from medweave.session import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(folder), oracle_sql(), 0
    for name, run in queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(n) for n in sys.argv[2:]):
            continue
        begin = time.time()
        try:
            if name in sql:
                df = run(spark, folder)
                problem = differences(df, con, sql[name]) or (f"types {t}" if (t := type_differences(df, con, sql[name])) else None)
            else:
                problem = None if run(spark, folder).count() else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - begin:.1f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
