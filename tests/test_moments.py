"""Moments of many columns in one scan, against Spark's own aggregates; the join of child tables writes no copy of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from starloom.functions import sqltext
from starloom.operators import generate, tables
from starloom.operators.aggregate import column_statistics, distinct_counts
from starloom.operators.moments import column_moments, levels_up_to, null_counts
from starloom.operators.select import ConstantDrop
from starloom.plans import credit_children as C
from starloom.suite.mapping import credit_tables, credit_target

SQL = {"count": "count(v)", "min": "min(v)", "max": "max(v)", "mean": "avg(v)", "variance": "var_pop(v)", "skew": sqltext.skew_g1("v")}


def close(a, b):
    return a is b is None or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-9, abs=1e-12)))


def test_moments_against_sql(spark):
    rng, big = random.Random(5), 2**53
    rows = [
        (rng.lognormvariate(0, 2), rng.randint(-5, 5), None, 0.1, float("nan") if i == 7 else 1.0, rng.choice([None, 2.5, -1.0]), big + i % 2, 1.0 if i == 3 else None, float("inf"))
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double, f double, g bigint, h double, i double").repartition(7)
    found, wanted = column_moments(df, df.columns), column_statistics(df, df.columns, SQL)
    for c in "abcdefgh":
        for k in SQL:
            assert close(found[c][k], wanted[c][k]) or (c == "g" and k in ("min", "max")), (c, k, found[c], wanted[c])
    assert found["g"]["min"] == big and found["g"]["max"] == big + 1 and not found["g"]["same"]  # equal as doubles
    assert [c for c in df.columns if found[c]["same"]] == ["d", "h", "i"] and found["c"]["same"] is None
    assert found["d"]["variance"] == 0 and found["i"]["skew"] is None or math.isnan(found["i"]["skew"])
    assert null_counts(df, df.columns) == (500, {c: 500 - found[c]["count"] for c in df.columns})
    exact = distinct_counts(df, [], df.columns, "").first()
    for most in (1, 2, 3, 10, 1000):
        assert levels_up_to(df, df.columns, most) == {c: min(most, exact[c]) for c in df.columns}
    empty = df.limit(0)
    assert column_moments(empty, ["a"])["a"]["count"] == 0 and null_counts(empty, ["a"]) == (0, {"a": 0}) and levels_up_to(empty, ["a"], 3) == {"a": 0}


def test_skewed_columns_need_no_count_of_all_their_values(spark, monkeypatch):
    monkeypatch.setattr(generate, "distinct_counts", None)  # shuffles every distinct value of every column
    df = spark.range(400).select(F.when(F.col("id") == 0, 1e9).otherwise(F.col("id")).alias("long_tail"), (F.col("id") == 5).cast("int").alias("two_values"))
    assert generate.SkewLog(5.0, 10).fit(df).state["columns"] == ["long_tail"]


def child(spark, name, rows):
    return spark.createDataFrame(rows, f"SK_ID_CURR long, {name}_x double, {name}_y int")


@pytest.mark.parametrize("driver", ["customer", "previous"])
def test_children_are_joined_as_by_outer_joins(spark, monkeypatch, driver):
    names = ["previous", "bureau", "credit_card", "pos_cash", "instalment"]
    rows = [[(1, 1.0, 1), (2, 2.0, 1)], [(2, 5.0, 1), (3, 6.0, 2)], [(1, None, 4), (4, None, 5)], [(1, 0.5, 7), (2, 0.25, 8)], [(5, 1.0, 1), (1, 3.0, 2)]]
    parts = [child(spark, n, r) for n, r in zip(names, rows, strict=True)]
    for n, part in zip(names, parts, strict=True):
        monkeypatch.setattr(C, f"{n}_features", lambda *a, part=part: part)
    sources = dict.fromkeys(["previous_application", "installments_payments", "bureau", "bureau_balance", "credit_card_balance", "pos_cash_balance"])
    wide = tables.star_join(parts[0], parts[1:], C.CUSTOMER, "left" if driver == "previous" else "full_outer")
    wanted = ConstantDrop(drop_null=False, keep=[C.CUSTOMER]).fit(wide).transform(wide)
    for packed in (1, 32):
        monkeypatch.setattr(tables, "PACKED_COLUMNS", packed)
        found = C.child_features(sources, None, driver)
        assert found.dtypes == wanted.dtypes and sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_children_are_written_once_and_shuffled_once(spark, folder, monkeypatch):
    written = []
    write = tables.materialise
    monkeypatch.setattr(C, "materialise", lambda df: written.append(df.columns) or write(df))
    children = C.child_features(credit_tables(spark, folder), credit_target(spark, folder))
    assert len(written) == 5 and max(map(len, written)) < len(children.columns)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = children._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "FullOuter" not in plan and plan.count("LeftOuter") == 5
    assert plan.count("Exchange hashpartitioning") == 6  # the keys and five parts, none of them again
