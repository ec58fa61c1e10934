"""Compare queries with their SQL: `python tests/oracle.py [sf_dir] [name ...]`."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    rel = con.execute(sql)
    return rows_of([d[0] for d in rel.description], rel.fetchall())


def difference(spark, con, sf, name):
    """None when equal, else a short description."""
    import bindings
    df = bindings.QUERIES[name](spark, sf)
    got = spark_rows(df)
    if name not in bindings.SQL:
        return None if got[1] else "no rows"
    rel = con.sql(bindings.SQL[name])
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    spark_kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    want = sql_rows(con, bindings.SQL[name])
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    odd = {c: (k, kinds[c]) for c, k in spark_kinds.items() if same.get(k, k) != kinds[c]}
    if odd:
        return f"types {odd}"
    if got[1] != want[1]:
        mine, theirs = set(got[1]), set(want[1])
        only_s, only_d = list(mine - theirs)[:3], list(theirs - mine)[:3]
        return f"rows {len(got[1])}/{len(want[1])}\n   spark {only_s}\n   sql   {only_d}"
    return None if got[1] else "no rows"


def main():
    from pyspark.sql import SparkSession
    import bindings
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(bindings.QUERIES)
    names = [n for n in bindings.QUERIES if any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        start = time.time()
        try:
            why = difference(spark, con, sf, name)
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:900]}"
        bad += why is not None
        print(f"{'ok ' if why is None else 'BAD'} {name} {time.time() - start:.1f}s {why or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
