"""Run named queries in Spark and their SQL in DuckDB and compare the results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, decimal.Decimal):
        return f"decimal:{value.normalize()}"
    return value


def compare(spark, con, folder: str, fn, sql: str) -> str | None:
    df = fn(spark, folder)
    names = sorted(df.columns)
    mine = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    if sorted(theirs_names) != names:
        return f"columns differ: {names} / {sorted(theirs_names)}"
    places = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(plain(r[p]) for p in places) for r in cursor.fetchall())
    kinds = [(type(a), type(b)) for a, b in zip(next(iter(mine), ()), next(iter(theirs), ()))
             if a is not None and b is not None and type(a) is not type(b)]
    if kinds:
        return f"types differ: {kinds} in {names}"
    if mine != theirs:
        return (
            f"{sum(mine.values())} / {sum(theirs.values())} rows; only Spark {list((mine - theirs).items())[:3]};"
            f" only DuckDB {list((theirs - mine).items())[:3]}"
        )
    return None


def main() -> None:
    import __spark_entry__ as entry
    from tallyframe.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, folder, fn, sqls[name])
            else:
                problem = None
                print(f"   rows only: {fn(spark, folder).count()}")
        except Exception:
            problem = traceback.format_exc(limit=-3)[-1500:]
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s"
              + (f"\n    {problem}" if problem else ""), flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
