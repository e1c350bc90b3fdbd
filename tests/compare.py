"""Run registered queries next to their SQL twins: python tests/compare.py [sf] [name-part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_duck(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = [str(d[1]) for d in rel.description]
    return names, types, [tuple(r) for r in rel.fetchall()]


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    secs = time.time() - t
    if sql is None:
        return f"rows {len(rows)} {secs:.2f}s", len(rows) > 0
    names, types, expected = rows_of_duck(con, sql)
    if names != df.columns:
        return f"columns {df.columns} vs {names}", False
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a, b = sorted(rows, key=key), sorted(expected, key=key)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"DIFF {len(a)} vs {len(b)}: {diff}", False
    if not a:
        return "EMPTY", False
    return f"ok {len(a)} {secs:.2f}s", True


if __name__ == "__main__":
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    oracle, bad = e.oracle_sql(), []
    for name, fn in e.queries().items():
        if len(sys.argv) > 2 and not any(p in name for p in sys.argv[2:]):
            continue
        try:
            text, good = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as err:
            text, good = "ERROR " + str(err)[:1500], False
        print("  " if good else "!!", name, text, flush=True)
        if not good:
            bad.append(name)
    print("bad:", bad)
