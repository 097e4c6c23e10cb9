"""Hold queries against their SQL: python tests/compare.py SF_DIR [NAME...]"""

import glob
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tables(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(str([_plain(r[i]) for i in order]) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    """None if both agree, else what differs."""
    df = query(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return None
    a, b = set(got[1]), set(want[1])
    return f"{got[0]} {want[0]} rows {len(got[1])} {len(want[1])}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), tables(sys.argv[1])
    for name in sys.argv[2:] or sorted(oracles):
        t = time.time()
        try:
            found = compare(spark, con, sys.argv[1], queries[name], oracles[name])
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:600]}"
        print(name, "ok" if found is None else f"DIFFERS {found[:1500]}", f"{time.time() - t:.1f}s", flush=True)
