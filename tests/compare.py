"""Run registered queries against their SQL: python tests/compare.py FOLDER [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The smallest tables; what the tests run on.
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE"}


def difference(spark, con, folder: str, run, sql: str) -> str | None:
    """None when both sides agree in columns, types and rows; otherwise what differs."""
    df = run(spark, folder)
    names = sorted(df.columns)
    mine = df.select(*[f"`{n}`" for n in names]).collect()
    con.execute(sql)
    theirs = con.fetchall()
    described = [(d[0], str(d[1])) for d in con.description]
    if sorted(n for n, _ in described) != names:
        return f"columns {set(names) ^ {n for n, _ in described}}"
    order = sorted(range(len(described)), key=lambda i: described[i][0])
    schema = dict(df.dtypes)
    types = {n: (schema[n], t) for n, t in described if TYPE_NAMES.get(schema[n], schema[n]) != t}
    a = sorted((tuple(r) for r in mine), key=repr)
    b = sorted((tuple(r[i] for i in order) for r in theirs), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        columns = {names[i] for x, y in bad[:50] for i in range(len(names)) if x[i] != y[i]}
        x, y = bad[0]
        cells = [(names[i], x[i], y[i]) for i in range(len(names)) if x[i] != y[i]]
        return f"{len(bad)} of {len(a)} rows differ in {sorted(columns)[:8]}: {cells[:3]}"
    return f"types {types}" if types else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = database(folder), 0
    for name, run in e.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            sql = e.oracle_sql().get(name)
            if sql is None:
                problem = None if run(spark, folder).count() else "no rows"
            else:
                problem = difference(spark, con, folder, run, sql)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
