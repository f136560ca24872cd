"""Run registered queries in Spark and DuckDB and compare them.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def rows_of_frame(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    return names, Counter(tuple(_plain(v) for v in row) for row in rows)


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())


def _plain(value):
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") and value is not None else value


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        try:
            start = time.time()
            names, got = rows_of_frame(query(spark, folder))
            spent = time.time() - start
            start = time.time()
            sql = oracle_sql().get(name)
            if sql is None:
                print(f"rows  {name} {sum(got.values())} rows {spent:.1f}s", flush=True)
                continue
            expected_names, expected = rows_of_sql(con, sql)
            ok = names == expected_names and got == expected
            print(f"{'ok   ' if ok else 'DIFF '} {name} {sum(got.values())}/{sum(expected.values())} rows spark {spent:.1f}s duckdb {time.time() - start:.1f}s", flush=True)
            if not ok:
                bad += 1
                if names != expected_names:
                    print("   columns", names, expected_names)
                for label, rows in (("spark only", got - expected), ("duckdb only", expected - got)):
                    for row in sorted(rows, key=repr)[:1]:
                        print("  ", label, sum(rows.values()), repr(row)[:160])
        except Exception as error:  # one broken query must not hide the others
            bad += 1
            print(f"ERROR {name} {str(error)[:300]}", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
