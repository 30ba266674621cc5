"""Run registered queries next to their SQL and compare rows as sorted values.

    python tests/compare.py [query ...]      # all queries at $CHECK_SF_DIR
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def make_spark(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def make_duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def value(x):
    if x is None:
        return ""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, bool):
        return str(x)
    try:
        from decimal import Decimal

        if isinstance(x, Decimal):
            return "decimal " + str(x)
    except ImportError:
        pass
    return repr(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows), [names[i] for i in order]


def compare(spark, con, build, sql, sf_dir):
    """Problem text, or '' when both sides agree; with row count and seconds."""
    t = time.time()
    df = build(spark, sf_dir)
    got = df.collect()
    t_spark = time.time() - t
    left, names = rows_of(df.columns, [tuple(r) for r in got])
    if sql is None:
        return ("" if left else "no rows"), len(left), t_spark, 0.0
    t = time.time()
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    right, other = rows_of(columns, rel.fetchall())
    t_sql = time.time() - t
    if names != other:
        return f"columns {names} != {other}", len(left), t_spark, t_sql
    if left != right:
        a, b = set(left), set(right)
        only = sorted(a - b)[:3], sorted(b - a)[:3]
        return (
            f"rows {len(left)} / {len(right)}, differing {len(a - b)} / {len(b - a)}\n   spark {only[0]}\n   sql   {only[1]}",
            len(left), t_spark, t_sql,
        )
    return ("" if left else "no rows"), len(left), t_spark, t_sql


def main(names):
    import __spark_entry__ as entry

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = make_spark(), make_duck(sf_dir)
    sql = entry.oracle_sql()
    failed = []
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        try:
            problem, rows, a, b = compare(spark, con, build, sql.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            text = "".join(traceback.format_exception_only(error)) if "-v" not in sys.argv else traceback.format_exc()
            problem, rows, a, b = text[:1500], -1, 0.0, 0.0
        print(f"{'ok  ' if not problem else 'FAIL'} {name} rows={rows} spark={a:.1f}s sql={b:.1f}s{'' if name in sql else ' (rows only)'}", flush=True)
        if problem:
            failed.append(name)
            print("  ", problem, flush=True)
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main([a for a in sys.argv[1:] if not a.startswith("-")]))
