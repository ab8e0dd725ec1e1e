"""Statistics from sorted rows against Spark's own aggregates."""

import math
import random

from pyspark.sql import functions as F

from starloom.operators import aggregate, runs
from starloom.operators.aggregate import bulk_stats
from starloom.operators.ordered import slope_folds, slope_over


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def odd_rows():
    rng = random.Random(5)
    rows = []
    for k in [None, -3, 0, 1, 2, 3, 4, 5, 6, 7, 8]:
        for i in range(rng.choice([1, 2, 9, 40])):
            x = rng.choice([None, 0.0, -0.0, 1.5, rng.gauss(0, 1e6)])
            big = rng.choice([None, 2**40, 2**40 + 1, -(2**50)])
            rows.append((k, i, x, None if k == 3 else rng.choice([1, 0]), big, rng.choice([1, 2, None]), 2.5, None, rng.choice(["b", "ä", "a", None]), rng.randrange(5)))
    rows += [(9, i, v, 1, 1, 1, v, None, None, 1) for i, v in enumerate([math.inf, 1.0, math.nan, math.nan])]
    return rows


SCHEMA = "k long, at int, x double, flag int, big long, small tinyint, same double, none float, s string, n int"


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isnan(a) and math.isnan(b) or a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b))
    return a == b


def both_ways(spark, monkeypatch, batch):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    folds, trend = slope_folds("at", "n", "n")
    folds |= {"last": ("max", F.col("s")), "rows": ("count", F.lit(1)), "late": ("count", F.when(F.col("at") > 2, 1)), "low": ("min", F.col("s")), "total": ("sum", F.col("x"))}
    columns = ["at", "x", "flag", "big", "small", "same", "none", "n"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = []
        for least in (1, 10_000):
            monkeypatch.setattr(aggregate, "RUN_COLUMNS", least)
            found = bulk_stats(df, ["k"], columns, folds=folds, distinct_only=["s"]).withColumn("trend", trend)
            assert ("MapInArrow" in plan(found)) == (least == 1)
            out.append((found.schema, {r["k"]: r.asDict() for r in found.collect()}))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    slopes = {r["k"]: r["slope"] for r in df.groupBy("k").agg(slope_over("at", "n").alias("slope")).collect()}
    return out, slopes


def test_sorted_rows_give_sparks_statistics(spark, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK_VALUES", 100)  # groups are cut by batches and blocks
    ((schema, got), (other, wanted)), slopes = both_ways(spark, monkeypatch, 3)
    assert [(f.name, f.dataType) for f in schema] == [(f.name, f.dataType) for f in other]
    assert got.keys() == wanted.keys() == {-3, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9}
    nan = {"x_nunique": 3, "same_nunique": 3}  # NaN counts as one value, as it does in groups of any other size
    for k, row in wanted.items():
        for c, v in row.items():
            v = nan.get(c, v) if k == 9 else v
            assert same(got[k][c], v), (k, c, got[k][c], v)
        assert same(got[k]["trend"], slopes[k])


def test_rows_that_lie_together_are_not_moved_again(spark, monkeypatch):
    from pyspark.sql import Window as W

    monkeypatch.setattr(aggregate, "RUN_COLUMNS", 1)
    df = spark.createDataFrame(odd_rows(), SCHEMA).withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("at")))
    groups = aggregate.HotKeys(["k"], None, 0, 10**6, 50)
    found = bulk_stats(df, ["k"], ["x", "r"], groups=groups, placed=True)
    text = plan(found)
    assert text.count("Exchange hashpartitioning") == 1 and "MapInArrow" in text
    assert found.count() == 11


def test_sums_beyond_64_bits_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(aggregate, "RUN_COLUMNS", 1)
    df = spark.createDataFrame([(1, 2**62), (1, 2**62), (2, 1)], "k long, big long")
    with pytest.raises(Exception, match="64 bits"):
        bulk_stats(df, ["k"], ["big"]).collect()
