"""Run queries on Spark and DuckDB over the same tables and compare values."""

import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda v: None if pd.isna(v) else (float(v) if isinstance(v, float) else v)
    rows = [tuple(clean(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr)


def check(spark, name, query, sql, sf, con):
    """Empty string when both agree, else what differs; and the seconds each took."""
    t0 = time.time()
    ours = query(spark, sf).toPandas()
    t1 = time.time()
    theirs = con.execute(sql).df()
    t2 = time.time()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} {sorted(theirs.columns)}", t1 - t0, t2 - t1
    a, b = normal(ours.astype(object)), normal(theirs.astype(object))
    if [tuple(map(str, r)) for r in a] == [tuple(map(str, r)) for r in b]:
        return "", t1 - t0, t2 - t1
    only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} vs {len(b)} rows; {str(only)[:600]}", t1 - t0, t2 - t1


def main(sf, names):
    import __spark_entry__ as contract
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), contract.oracle_sql()
    assert set(sqls) <= set(contract.queries())
    failed = []
    for name, query in contract.queries().items():
        if name not in sqls or (names and name not in names):
            continue
        try:
            said, mine, theirs = check(spark, name, query, sqls[name], sf, con)
        except Exception as e:  # report and go on
            said, mine, theirs = f"{type(e).__name__}: {str(e)[:700]}", 0, 0
        print(f"{'ok  ' if not said else 'FAIL'} {name:24s} spark {mine:6.1f}s duckdb {theirs:6.1f}s {said}", flush=True)
        failed += [name] if said else []
    print("failed:", failed)


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    main(sys.argv[1], sys.argv[2:])
