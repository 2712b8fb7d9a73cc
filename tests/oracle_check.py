"""Compare every query with its SQL twin: python tests/oracle_check.py [sf] [name ...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(app="check"):
    return (SparkSession.builder.master("local[8]").appName(app)
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k").getOrCreate())


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    return str(v)


def rows_of(frame: pd.DataFrame):
    columns = sorted(frame.columns)
    lines = frame[columns].astype(object).values.tolist()
    return columns, sorted(tuple(_cell(v) for v in line) for line in lines)


def kinds(frame):
    """Column kinds as far as the values decide them."""
    return {c: frame[c].dtype.kind for c in frame.columns if not frame[c].isna().any()}


def differences(spark_frame, sql_frame):
    mine, theirs = kinds(spark_frame), kinds(sql_frame)
    odd = {c: (mine[c], theirs[c]) for c in mine if c in theirs and mine[c] != theirs[c]}
    if odd:
        return f"kinds {odd}"
    sc, sr = rows_of(spark_frame)
    dc, dr = rows_of(sql_frame)
    if sc != dc:
        return f"columns {sc} / {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} / {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as E

    args = sys.argv[1:]
    sf_dir = f"/root/testdata/sf{args[0] if args else '0.001'}"
    names = args[1:] or list(E.queries())
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.time()
        try:
            mine = E.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - start
            sql = E.oracle_sql().get(name)
            if sql is None:
                print(f"--   {name:24} {len(mine):8} rows {took:6.1f}s  no SQL twin", flush=True)
                continue
            start = time.time()
            problem = differences(mine, con.execute(sql).df())
            print(f"{'FAIL' if problem else 'ok  '} {name:24} {len(mine):8} rows {took:6.1f}s  sql {time.time() - start:5.1f}s  {problem or ''}"[:700], flush=True)
            failed += bool(problem)
        except Exception as error:  # report and go on to the next query
            failed += 1
            print(f"FAIL {name:24} {type(error).__name__}: {str(error)[:500]}", flush=True)
    print(f"{failed} failed of {len(names)}")
