"""Runs queries beside their SQL: python tests/oracle.py [names]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return str(v)


def compare(spark, d, f, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    began = time.time()
    df = f(spark, d)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=str)
    took = time.time() - began
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    assert sorted(cols) == names, (sorted(cols), names)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in names) for r in res.fetchall()), key=str)
    differ = [(a, b) for a, b in zip(got, want) if a != b][:2]
    assert len(got) == len(want) and not differ, (len(got), len(want), differ)
    return len(got), took


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    names = [a for a in sys.argv[1:] if not a.startswith("/")]
    d = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    for name, f in entry.queries().items():
        if names and name not in names or not names and (name.startswith("op") or name == "pipeline"):
            continue
        try:
            if sql := entry.oracle_sql().get(name):
                print("ok", name, *compare(spark, d, f, sql), flush=True)
            else:
                print("ok", name, f(spark, d).count(), "rows only", flush=True)
        except Exception as e:
            print("BAD", name, type(e).__name__, str(e)[:600].replace("\n", " "), flush=True)
