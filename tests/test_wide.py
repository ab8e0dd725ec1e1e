"""Whole-table operators on many columns: ranks, row partitions, masked sums and intervals, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import gramian, generate, partition, ranks
from starloom.operators.generate import PairwiseInteractions, all_interactions, overflowing
from starloom.operators.partition import one_to_one_pairs
from starloom.operators.ranks import binned, column_medians


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_medians_over_the_whole_range(spark):
    rng = random.Random(2)
    rows = [
        (rng.choice([None, math.exp(rng.gauss(0, 50)) * rng.choice([1, -1]), 0.0, -0.0]), rng.randrange(5), None, rng.choice([1e308, -1e308, 1.7e308, 5e-324]), rng.choice([float("inf"), 1.0, float("nan")]))
        for _ in range(1001)
    ]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double").repartition(5)
    got = column_medians(df, df.columns)
    for i, c in enumerate(df.columns):
        values = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i])
        assert got[c] == (values[(len(values) - 1) // 2] / 2 + values[len(values) // 2] / 2 if values else None)


def test_medians_need_few_passes_and_no_sketch(spark, monkeypatch):
    passes = []

    def counted(df, gaps):
        passes.append(binned(df, gaps))
        return passes[-1]

    monkeypatch.setattr(ranks, "binned", counted)
    df = spark.range(20_000).select(F.exp(F.col("id") / 50).alias("a"), (F.col("id") * 7919 % 20_011).alias("b"), F.lit(1.5).alias("c"))
    expected = [np.median(np.array(df.select(c).toPandas()[c])) for c in "abc"]
    assert list(column_medians(df, ["a", "b", "c"]).values()) == pytest.approx(expected, rel=1e-15)
    assert len(passes) <= 7 and not any("percentile" in plan(p) for p in passes)
    assert all("keys=[g" in plan(p) for p in passes)  # counted by gap and bin


def brute_pairs(rows, columns):
    levels = {c: len({r[i] for r in rows if r[i] is not None}) for i, c in enumerate(columns)}
    out = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            met = {(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None}
            if levels[a] == levels[columns[j]] > 1 and met and len(met) == len({x for x, _ in met}) == len({y for _, y in met}):
                out.append((a, columns[j]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_one_to_one_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(partition, "SAMPLE", 6)
    rng = random.Random(seed)
    base = [rng.randrange(3) for _ in range(40)]
    rows = []
    for v in base:
        w = rng.randrange(2)
        row = [v, f"x{v}", -2.5 * v if v else -0.0, None if rng.random() < 0.3 else v + 7, None if w else v, None if w else chr(97 + v), w, 1 - w, rng.randrange(3), rng.randrange(2), 4]
        rows += [tuple(row)] * rng.randrange(1, 3)  # repeated rows
    names = [f"c{i}" for i in range(11)]
    df = spark.createDataFrame(rows, "c0 int, c1 string, c2 double, c3 int, c4 int, c5 string, c6 int, c7 int, c8 int, c9 int, c10 int").repartition(3)
    assert sorted(one_to_one_pairs(df, names)) == sorted(brute_pairs(rows, names))


def test_scans_do_not_grow_with_the_columns(spark, monkeypatch):
    scans = []
    for name in ("verified", "signatures", "unrefuted"):
        real = getattr(partition, name)
        monkeypatch.setattr(partition, name, lambda *a, real=real, name=name: scans.append(name) or real(*a))
    rng = random.Random(5)
    for p in (20, 300):
        rows = [[rng.randrange(2) for _ in range(p - 2)] for _ in range(200)]
        rows = [tuple([*r, 1 - r[0], r[1] + 5]) for r in rows]
        df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(p)))
        scans.clear()
        assert one_to_one_pairs(df, df.columns) == [("c0", f"c{p - 2}"), ("c1", f"c{p - 1}")]
        assert len(scans) <= 4


def test_correlations_over_complete_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.gauss(1e9, 1)]), rng.randrange(5), None, float(i), 3.0, rng.choice([None, i + rng.random()]), rng.choice([float("inf"), 1.0, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double, f double, g double").repartition(6)
    for merged in (256, 1):
        monkeypatch.setattr(gramian, "MERGED", merged)  # added in more groups
        got = {(r[0], r[1]): r[2] for r in gramian.correlation_pairs(df, df.columns).collect()}
        assert len(got) == 21
        for (x, y), v in got.items():
            i, j = df.columns.index(x), df.columns.index(y)
            both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None], float)
            if "g" in (x, y):
                assert v is None and "c" in (x, y) or v != v
            elif not len(both) or min(np.ptp(both, axis=0)) == 0:
                assert v is None
            else:
                assert v == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)
    empty = gramian.correlation_pairs(df.limit(0), ["a", "b"]).collect()
    assert [tuple(r) for r in empty] == [("a", "b", None)]


def test_one_row_a_task_and_column_is_shuffled(spark):
    df = spark.range(10_000).select(*[(F.col("id") * (i + 3) % 101).cast("double").alias(f"c{i}") for i in range(8)]).repartition(4)
    sent = gramian.masked_sums(df, df.columns, [0.0] * 8)
    assert sent.where("sender >= 0").count() == 8 * 4


def slow_overflowing(df, columns):
    """Every interaction looked at in every row."""
    new = all_interactions(columns)
    bad = {}
    for n, e in new.items():
        x = F.coalesce(F.abs(e) == F.lit(float("inf")), F.lit(False))
        for c in columns:
            if f"log(1_+_{c})" in n:
                x = x | F.coalesce(F.col(c) == -1, F.lit(False))
        bad[n] = x
    row = df.agg(*[F.max(x).alias(str(i)) for i, x in enumerate(bad.values())]).first()
    return [n for i, n in enumerate(bad) if row and row[str(i)]]


VALUES = [0.0, -0.0, -1.0, 1.0, -1.5, 3.0, 709.0, 710.0, -800.0, 1e-300, 5e-324, 1e154, 1.4e154, 1e200, -1e300, 1.7e308, None, float("inf"), float("nan"), -0.9999999999999999]


@pytest.mark.parametrize("seed", range(6))
def test_intervals_drop_what_a_scan_of_all_rows_drops(spark, seed):
    rng = random.Random(seed)
    pools = [rng.sample(VALUES, rng.randrange(1, 5)) for _ in range(4)]
    rows = [tuple(rng.choice(p) for p in pools) for _ in range(8)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert overflowing(df, ["a", "b", "c", "d"]) == slow_overflowing(df, ["a", "b", "c", "d"])


def test_plain_columns_need_no_scan_of_the_pairs(spark, monkeypatch):
    df = spark.range(100).select(*[(F.col("id") % 50 + 1 + i).cast("double").alias(f"c{i}") for i in range(30)])
    monkeypatch.setattr(generate, "pair_interactions", lambda a, b: pytest.fail("an interaction was built"))
    assert overflowing(df, df.columns) == []


def test_fitted_interactions(spark):
    df = spark.createDataFrame([(1.0, -1.0, 3), (0.0, 2000.0, 4)], "a double, b double, c int")
    state = PairwiseInteractions(["a", "b", "c"]).fit(df).state
    assert state["overflow"] == slow_overflowing(df, ["a", "b", "c"])
