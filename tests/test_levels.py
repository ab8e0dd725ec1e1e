"""Columns of any number of levels, statistics of groups of mixed sizes, deviations free of the order of rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from starloom.operators import aggregate, encode, tables
from starloom.operators.aggregate import bulk_stats, crosstab_long, crosstab_shares, exact_std, grouped, pivot_counts, pivot_long
from starloom.operators.encode import CategoricalEncoder, CategoricalEncoderModel, Grouping, OneHot


def vectors(df, column, *keep):
    v = F.unwrap_udt(column)
    return sorted(map(tuple, df.select(*keep, v["size"], v["indices"], v["values"]).collect()), key=repr)


def test_pivot_of_many_levels(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.concat(F.lit("v"), F.col("id") % 20_000).alias("c"))
    with pytest.raises(ValueError, match="pivot_long"):
        pivot_counts(df, ["k"], "c")
    out = pivot_long(df, ["k"], "c")
    assert out.columns == ["k", "level", "n"] and out.count() == 60_000 and out.agg(F.sum("n")).first()[0] == 60_000
    assert out.select("level").distinct().count() == 20_000


def test_long_forms_are_those_of_the_columns(spark):
    rows = [(1, "a", "x"), (1, "a", None), (1, "b", "x"), (2, None, "y"), (2, "b", "y"), (None, "a", "x"), (None, "c", "x"), (3, None, None)]
    df = spark.createDataFrame(rows, "k int, c string, level string")
    wide = {(r["k"], c[2:]): r[c] for r in pivot_counts(df, ["k"], "c").collect() for c in ("c_a", "c_b", "c_c") if r[c]}
    assert {(r["k"], r["level"]): r["n"] for r in pivot_long(df, ["k"], "c").collect()} == wide
    shares = {(r["k"], c[2:]): r[c] for r in crosstab_shares(df, "k", "c").collect() for c in ("c_a", "c_b") if r[c]}
    assert {(r["k"], r["level"]): r["share"] for r in crosstab_long(df, "k", "c").collect()} == pytest.approx(shares)
    assert crosstab_long(df.limit(0), "k", "c").collect() == []


@pytest.mark.parametrize("most", [100_000, 2])
def test_sparse_one_hot(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(encode, "BROADCAST_ROWS", most)
    df = spark.createDataFrame([(1, "b"), (2, "a\"]"), (3, None), (4, "b"), (5, "ü")], "id int, c string")
    model = CategoricalEncoder(["c"], [OneHot(sparse=True)]).fit(df)
    new = spark.createDataFrame([(1, "b"), (2, "other"), (3, None)], "id int, c string")
    want = [(1, 4, [2], [1.0]), (2, 4, [], []), (3, 4, [0], [1.0])]
    assert vectors(model.transform(new), "c_LabelBinarizer", "id") == want
    assert model.transform(df).columns == ["id", "c_LabelBinarizer"]
    model.write().overwrite().save(str(tmp_path / "m"))
    assert vectors(CategoricalEncoderModel.load(str(tmp_path / "m")).transform(new), "c_LabelBinarizer", "id") == want
    grouping = CategoricalEncoder(["c"], [Grouping(OneHot(sparse=True), 2)]).fit(df).transform(new)
    assert [r[1:] for r in vectors(grouping, "c_GroupingEncoder", "id")] == [(3, [2], [1.0]), (3, [1], [1.0]), (3, [0], [1.0])]


def test_sparse_one_hot_of_many_levels(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(40_000).select("id", F.format_string("v%05d", F.col("id") % 20_000).alias("c"))
    with pytest.raises(ValueError, match="sparse=True"):
        CategoricalEncoder(["c"], [OneHot()]).fit(df)
    out = CategoricalEncoder(["c"], [OneHot(sparse=True)]).fit(df).transform(df)
    v = F.unwrap_udt("c_LabelBinarizer")
    wrong = out.where((v["size"] != 20_000) | (v["indices"][0] != F.col("id") % 20_000) | (F.size(v["indices"]) != 1))
    assert wrong.count() == 0 and out.count() == 40_000
    first = VectorAssembler(inputCols=["id", "c_LabelBinarizer"], outputCol="v").transform(out.where("id = 7")).first()["v"]
    assert first.size == 20_001 and list(first.indices) == [0, 8]


def mixed(spark):
    return spark.range(3_000).select(
        F.when(F.col("id") < 1_000, F.lit(-1)).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 400).alias("k"),
        (F.col("id") % 17).cast("int").alias("x"),
        F.concat(F.lit("s"), F.col("id") % 5).alias("s"),
    )


@pytest.mark.parametrize("top", [10_000, 0])
def test_one_large_group_leaves_the_plan_of_the_others(spark, monkeypatch, top):
    monkeypatch.setattr(tables, "TOP_KEYS", max(top, 1))
    df = mixed(spark)
    if not top:  # two large groups, more than are broadcast
        df = df.union(df.selectExpr("k - 500 AS k", "x", "s"))
    extra = [F.sum("x").alias("total")]
    plain = bulk_stats(df, ["k"], ["x"], extra=extra, distinct_only=["s"], exact=True)
    plan = plain._jdf.queryExecution().toString()
    assert "collect_set" in plan and "inline" not in plan
    monkeypatch.setattr(aggregate, "GROUP_VALUES", 100)
    split = bulk_stats(df, ["k"], ["x"], extra=extra, distinct_only=["s"], exact=True)
    plan = split._jdf.queryExecution().toString()
    assert "collect_set" in plan and "inline" in plan
    assert split.columns == plain.columns
    assert sorted(split.collect(), key=repr) == sorted(plain.collect(), key=repr)


def std(spark, values, parts=1):
    df = spark.createDataFrame([(v,) for v in values], "x int").repartition(parts)
    return grouped(df.withColumn("k", F.lit(0)), ["k"], {"s": exact_std("x")}).first()["s"]


def test_exact_deviations(spark):
    draw = random.Random(5)
    rows, want = [], {}
    for k in range(120):
        reach = draw.choice([1, 3, 1_000, 2**31 - 1])
        values = [draw.randint(-reach - (reach > 2**30), reach) for _ in range(draw.randint(0, 40))]
        want[k] = statistics.stdev(values) if len(values) > 1 else None
        rows += [(k, v) for v in values] + [(k, None)]
    found = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k int, x int").repartition(seed * 3 + 1)
        found.append({r["k"]: r["s"] for r in grouped(df, ["k"], {"s": exact_std("x")}).collect()})
    assert found[0] == found[1] == found[2]
    for k, v in want.items():
        assert found[0][k] == (None if v is None else pytest.approx(v, rel=1e-14))
    assert std(spark, [7, 7, 7], 3) == 0.0
    assert std(spark, [0, 1, 1]) == std(spark, [-1, 0, 0]) == std(spark, [2**31 - 2, 2**31 - 1, 2**31 - 1]) == std(spark, [-(2**31), -(2**31) + 1, -(2**31) + 1])


def test_exact_deviations_in_bulk_statistics(spark):
    df = spark.createDataFrame([(1, 1, 1.5), (1, 4, 2.5), (2, 3, None)], "k int, x int, y double")
    out = {r["k"]: (r["x_std"], r["y_std"]) for r in bulk_stats(df, ["k"], exact=True).collect()}
    assert out == {1: (pytest.approx(4.5**0.5), pytest.approx(0.5**0.5)), 2: (None, None)}
