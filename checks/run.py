"""Compare every query with its SQL on DuckDB: python -m checks.run [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(value)
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value) if value is not None and not isinstance(value, (bool, float)) else value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return columns, [str(d[1]) for d in cursor.description], normal(cursor.fetchall(), columns)


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def compare(spark, con, sf, query, sql) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, sf)
    rows = df.collect()
    if sql is None:
        return "" if rows else "no rows"
    columns, types, expected = oracle(con, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(columns)}"
    actual = normal(rows, df.columns)
    if actual != expected:
        wrong = [p for p in zip(actual, expected) if p[0] != p[1]][:2]
        return f"{len(actual)} vs {len(expected)} rows; {wrong}"
    return ""


def main(sf: str, names: list[str]) -> int:
    from checks.registry import ORACLES, QUERIES

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), 0
    for name in names or list(QUERIES):
        started = time.time()
        try:
            difference = compare(spark, con, sf, QUERIES[name], ORACLES.get(name))
        except Exception as error:
            difference = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(difference)
        checked = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if difference else 'ok':4} {time.time() - started:6.2f}s {checked:4} {name} {difference}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
