"""Null, division, bin, text and date rules on hand-made rows."""

import statistics

from pyspark.sql import functions as F

from starloom.functions import rowwise as R
from starloom.functions import semantics as S
from starloom.operators.aggregate import column_profile, correlation_pairs, pivot_counts
from starloom.operators.generate import DateTimeFeatures, PairwiseInteractions, SkewLog, TextStatistics
from starloom.operators.ranks import column_medians


def one(spark, column, schema="a double, b double", rows=((1.0, 2.0),)):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def test_flags_and_ratios(spark):
    rows = [(1.0, 0.0), (0.0, 0.0), (None, 1.0), (-3.0, 0.0), (3.0, 2.0)]
    assert one(spark, S.ratio("a", "b"), rows=rows) == [None, None, None, None, 1.5]
    assert one(spark, S.ratio("a", "b", mode="ieee"), rows=rows) == [float("inf"), None, None, float("-inf"), 1.5]
    assert one(spark, S.flag(F.col("a") > 0), rows=rows) == [1, 0, 0, 0, 1]
    assert one(spark, S.differs("a", 1), rows=rows) == [0, 1, 1, 1, 1]


def test_floor_division_follows_the_remainder(spark):
    rows = [(v, 0.0) for v in (0.12, -7.0, 7.0, 365.25 * 20, -0.5)]
    assert one(spark, S.floor_div("a", 0.04), rows=rows[:1]) == [0.12 // 0.04] == [2.0]
    assert one(spark, S.floor_div("a", 2), rows=rows[1:3]) == [-4.0, 3.0]
    assert one(spark, S.floor_div("a", 365.25), rows=rows[3:]) == [20.0, -1.0]


def test_bins(spark):
    rows = [(v, 0.0) for v in (24.99, 25.0, 59.9, 60.0, None)]
    assert one(spark, S.bins("a", [25, 30, 40, 50, 60], [6, 5, 4, 3, 2, 1]), rows=rows) == [6, 5, 2, 1, 0]
    assert one(spark, S.bins("a", [25, 30], [2, 1]), rows=rows) == [2, 1, 0, 0, 0]


def test_row_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0), (1.0, None, 2.0), (None, None, None)], "a double, b double, c double")
    c = ["a", "b", "c"]
    got = df.select(R.row_mean(c), R.row_median(c), R.row_std(c), R.row_sum(c), R.null_count(c), R.row_range(c)).collect()
    assert tuple(got[0]) == (3.0, 2.0, statistics.pstdev([1, 2, 6]), 9.0, 0, 5.0)
    assert tuple(got[1]) == (1.5, 1.5, 0.5, 3.0, 1, 1.0)
    assert tuple(got[2]) == (None, None, None, 0.0, 3, None)


def test_text(spark):
    texts = ["abc def ghi", "", None, " +1.5e3 x 9", "É é!\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = TextStatistics(["t"]).transform(df).collect()
    words = [r["t_nb_words"] for r in got]
    assert words == [2, 0, None, 1, 0]
    assert [r["t_nb_numbers"] for r in got] == [0, 0, None, 2, 0]
    assert [r["t_nb_tokens"] for r in got] == [3, 1, None, 3, 2]
    assert [r["t_nb_whitespaces"] for r in got] == [2, 0, None, 3, 2]
    assert got[4]["t_nb_special_chars"] == 2


def test_dates(spark):
    df = spark.sql("select timestamp'2024-02-29 10:00:01' as a, timestamp'2024-03-02 09:00:00' as b")
    r = DateTimeFeatures(["a", "b"]).transform(df).first()
    assert (r["a_day"], r["a_day_of_week"], r["a_seconds"]) == (29, 3, 1)
    assert r["a_b_time_diff_secs"] == (2 * 86400 - 3601) % 86400
    assert DateTimeFeatures(["a", "b"], total=True).transform(df).first()["a_b_time_diff_secs"] == 2 * 86400 - 3601


def test_exact_medians(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice([1.0, 2.0, 2.0, 9.0]), rng.gauss(0, 5), None if i % 3 else float(i)) for i in range(1001)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    got = column_medians(df, ["a", "b", "c"])
    for i, c in enumerate("abc"):
        assert got[c] == statistics.median([r[i] for r in rows if r[i] is not None])
    assert column_medians(df.where("a > 100"), ["a"]) == {"a": None}


def test_profile_counts_null_as_a_level(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (2, "y")], "n int, s string")
    got = {r["feature"]: r for r in column_profile(df).collect()}
    assert (got["s"]["nb_nas"], got["s"]["nb_levels"], got["s"]["nb_distinct"]) == (1, 3, 2)


def test_correlation_of_a_constant_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert correlation_pairs(df, ["a", "b"]).first()["correlation"] is None


def test_pivot(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "k int, s string")
    assert {r["k"]: tuple(r)[1:] for r in pivot_counts(df, ["k"], "s").collect()} == {1: (2, None), 3: (None, 1)}
    assert {r["k"]: tuple(r)[1:] for r in pivot_counts(df, ["k"], "s", absent=0).collect()} == {1: (2, 0), 3: (0, 1)}


def test_interactions_drop_overflow(spark):
    df = spark.createDataFrame([(1.0, -1.0), (0.0, 2000.0)], "a double, b double")
    model = PairwiseInteractions().fit(df.withColumn("c", F.col("a") + 2))
    assert model.state["columns"] == []
    model = PairwiseInteractions(["a", "b"]).fit(df)
    assert "a_+_exp(b)" in model.state["overflow"] and "a_*_log(1_+_b)" in model.state["overflow"]
    assert "a_+_b" in model.transform(df).columns


def test_skew_log_needs_enough_values(spark):
    skewed = [(float(i),) for i in range(11)] + [(1e6,)]
    df = spark.createDataFrame(skewed, "v double")
    assert SkewLog(threshold=3.0).fit(df).state["columns"] == ["v"]
    assert SkewLog(threshold=3.0, min_distinct=13).fit(df).state["columns"] == []
