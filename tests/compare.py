"""Spark against DuckDB on one folder of tables: python tests/compare.py DIR [NAME...]"""

import os
import re
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else (round(v, 6) if isinstance(v, float) else (str(pd.Timestamp(v)) if hasattr(v, "year") else (v.item() if hasattr(v, "item") else v)))
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def compare(spark, folder: str, name: str, query, sql: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        only = [x for x in a if x not in set(b)][:2] if len(a) < 20000 else a[:1]
        other = [x for x in b if x not in set(a)][:2] if len(b) < 20000 else b[:1]
        return f"{len(a)} and {len(b)} rows; Spark has {only}, DuckDB {other}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if not re.match(r"op\d+_", n) and n != "pipeline"]:
        began = time.time()
        try:
            said = compare(spark, sys.argv[1], name, queries[name], sqls[name]) if name in sqls else f"rows {queries[name](spark, sys.argv[1]).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
