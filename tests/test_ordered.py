"""Ordered operators give the same rows whether or not a key is split."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.operators.aggregate import bulk_stats
from starloom.operators.ordered import OrderedGroups, cumulative_levels, hash_ordered_position, last_n_counts
from starloom.operators.tables import HotKeys, attach_group_values, spread_join
from starloom.operators.validate import rolling_folds


@pytest.fixture(scope="module")
def orders(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(400)
    hot = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("long")).when(F.col("o_orderkey") % 3 == 1, F.lit(7)).otherwise(F.col("o_custkey"))
    return df.withColumns({"k": hot, "p": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))}).cache()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("order", [["o_orderdate", "o_orderkey"], ["-o_orderstatus", "p", "-o_orderkey"]])
def test_split_key(orders, keys, order):
    whole, split = OrderedGroups(orders, keys, order), OrderedGroups(orders, keys, order, rows_per_task=20)
    assert not whole.hot and split.hot
    for f in (
        lambda g: g.position(),
        lambda g: g.running_sum({"s": F.col("o_custkey")}),
        lambda g: g.running_sum({"s": F.col("o_custkey")}, inclusive=False),
        lambda g: g.previous({"x": "o_orderkey", "y": "p"}),
        lambda g: g.gaps({"x": "o_totalprice"}),
        lambda g: g.trend({"t": "o_totalprice", "u": "p"}).select(*keys, F.round("t", 5).alias("t"), F.round("u", 5).alias("u")),
    ):
        same(f(whole), f(split))


def test_trend_rules(spark):
    rows = [(1, 0, 5.0), (2, 0, 1.0), (2, 1, 3.0), (2, 2, 5.0), (3, 0, 1.0), (3, 1, None), (4, 0, None)]
    df = spark.createDataFrame(rows, "k int, t int, y double")
    got = {r["k"]: r["s"] for r in OrderedGroups(df, ["k"], ["t"]).trend({"s": "y"}).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: None, 4: None}


def test_distinct_strategies_agree(orders, monkeypatch):
    from starloom.operators import aggregate

    small = bulk_stats(orders, ["o_custkey"], ["p", "o_orderkey"], distinct_only=["o_orderstatus"])
    monkeypatch.setattr(aggregate, "GROUP_VALUES", 0)
    narrow = bulk_stats(orders, ["o_custkey"], ["p", "o_orderkey"], distinct_only=["o_orderstatus"])
    assert "collect_set" in small._jdf.queryExecution().toString() and "collect_set" not in narrow._jdf.queryExecution().toString()
    keep = [c for c in small.columns if c.endswith(("nunique", "min", "max"))]
    same(small.select("o_custkey", *keep), narrow.select("o_custkey", *keep))


def test_spread_join(orders):
    stats = orders.groupBy("k").agg(F.max("o_totalprice").alias("top"))
    hot = HotKeys.of(orders, ["k"], rows_per_task=20)
    assert 7 in [r["k"] for r in hot.table.collect()]
    same(spread_join(orders, stats, ["k"], ["top"], hot), attach_group_values(orders, ["k"], stats))


def test_last_rows_are_limited_before_the_shuffle(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    out = last_n_counts(orders, ["o_custkey"], ["-o_orderdate", "-o_orderkey"], [1, 5], {"n_{n}": F.col("o_orderstatus") == "F"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_levels_and_positions(orders):
    rows = cumulative_levels(orders, "o_orderpriority").orderBy("running").collect()
    assert rows[-1]["running"] == rows[-1]["total"] == 400
    h = orders.withColumn("h", F.md5(F.col("o_orderkey").cast("string")))
    placed = hash_ordered_position(h, ["o_orderstatus"], "h", "at")
    check = placed.withColumn("rn", F.row_number().over(W.partitionBy("o_orderstatus").orderBy("h")) - 1)
    assert check.where("at <> rn or at is null").count() == 0


def test_rolling_folds(spark):
    df = spark.range(23).select(F.col("id").alias("k"), F.col("id").alias("t"))
    out = rolling_folds(df, ["t"], 10, 3, rows_per_task=5)
    for fold in range((23 - 10) // 3):
        rows = [(r["k"], r["part"]) for r in out.where(F.col("foldId") == fold).collect()]
        assert sorted(k for k, p in rows if p == "train") == list(range(fold * 3, fold * 3 + 10))
        assert sorted(k for k, p in rows if p == "test") == list(range(fold * 3 + 10, fold * 3 + 13))
    assert out.select("foldId").distinct().count() == 4


def test_thousands_of_hot_keys_stay_off_the_driver(spark, monkeypatch):
    from starloom.operators import tables

    monkeypatch.setattr(tables, "TOP_KEYS", 40)
    key = F.when(F.col("id") % 9 < 3, F.lit(-1)).when(F.col("id") % 9 == 3, F.lit(None)).otherwise(F.col("id") % 3001).cast("long")
    df = spark.range(36_000).select(F.col("id").alias("t"), key.alias("k"), (F.col("id") * 7919 % 101).cast("double").alias("x")).repartition(6).cache()
    collected, real = [], type(df).collect

    def counted(self):
        rows = real(self)
        collected.append(len(rows))
        return rows

    monkeypatch.setattr(type(df), "collect", counted)
    whole, split = OrderedGroups(df, ["k"], ["t"]), OrderedGroups(df, ["k"], ["t"], rows_per_task=3)
    assert split.hot.count > 3_000 and not whole.hot
    results = [(f(whole), f(split)) for f in (lambda g: g.position(), lambda g: g.previous({"y": "x"}), lambda g: g.running_sum({"s": F.col("x")}))]
    stats = df.groupBy("k").agg(F.max("x").alias("top"))
    results.append((df.join(stats, "k", "left"), attach_group_values(df, ["k"], stats, rows_per_task=3)))
    assert max(collected, default=0) <= 1
    for a, b in results:
        same(a, b)
