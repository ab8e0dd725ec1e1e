"""Pipelines on training rows, safe reuse of stages, metrics by name and by function."""

import tempfile

import pytest
from pyspark.sql import functions as F

from starloom.operators import encode as E
from starloom.operators.select import VarianceSelect
from starloom.operators.stage import TrainingPipeline
from starloom.operators.tables import materialise, rows_if_small
from starloom.operators.validate import fold_metrics
from starloom.plans.credit_application import rounded_units
from starloom.plans.staged import StagedPipeline, data_fingerprint

LEFT_OUT = {1: 0.5, 2: 1.0, 3: 0.5, 4: 0.0, 5: 1.0}


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "a", 1), (4, "b", 1), (5, "b", 0)], "k long, c string, y int")


def stages():
    return [E.CategoricalEncoder(["c"], [E.LeaveOneOut(noise=False)], label="y"), VarianceSelect(0.0, keep=["k", "y"])]


def values(df):
    name = next(c for c in df.columns if c.startswith("c_"))
    return {r["k"]: r[name] for r in df.collect()}


def test_training_rows_leave_their_own_label_out(labelled):
    staged = StagedPipeline(stages())
    assert values(staged.fit_transform(labelled)) == LEFT_OUT
    scored = values(staged.transform(labelled))
    assert scored[1] == scored[2] == pytest.approx(2 / 3) and scored[4] == scored[5] == 0.5
    model = TrainingPipeline(stages=stages()).fit(labelled)
    assert values(model.transform(labelled)) == scored


def test_stages_are_reused_only_for_the_same_rows(spark, labelled):
    folder = tempfile.mkdtemp(prefix="starloom-reuse-")
    labelled.write.parquet(f"{folder}/in")
    read = lambda: spark.read.parquet(f"{folder}/in")
    assert data_fingerprint(read()) == data_fingerprint(read())
    assert data_fingerprint(read().where("k > 1")) != data_fingerprint(read().where("k > 2"))
    assert StagedPipeline(stages(), f"{folder}/kept").fit(read()).reused == 0
    assert StagedPipeline(stages(), f"{folder}/kept").fit(read()).reused == 1
    assert StagedPipeline(stages(), f"{folder}/kept").fit(read().where("k > 1")).reused == 0
    before = data_fingerprint(read())
    labelled.withColumn("y", 1 - F.col("y")).write.mode("overwrite").parquet(f"{folder}/in")
    assert data_fingerprint(read()) != before
    with pytest.raises(ValueError):
        StagedPipeline(stages(), f"{folder}/kept").fit(labelled)


def test_metrics_by_name_and_function(spark):
    df = spark.createDataFrame([(0, 1, 0.8), (0, 0, 0.4), (0, 0, 0.6)], "f int, y int, prediction double")
    asked = {"mae": "mae", "accuracy": "accuracy", "top": lambda y, p: F.max(p), "hits": (lambda y, p: F.sum(p), "class")}
    got = fold_metrics(df, ["f"], "y", asked).first()
    assert got["mae"] == pytest.approx(1.2 / 3) and got["accuracy"] == pytest.approx(2 / 3)
    assert got["top"] == 0.8 and got["hits"] == 2 and got["rows"] == 3
    with pytest.raises(ValueError):
        fold_metrics(df, ["f"], "y", {"x": "nonsense"})


def test_small_tables_are_bounded_in_rows_and_bytes(spark):
    df = spark.createDataFrame([("x" * 100,), ("y" * 100,)], "level string")
    assert len(rows_if_small(df)) == 2
    assert rows_if_small(df, 1) is None
    assert rows_if_small(df, most_bytes=150) is None


def test_materialised_rows_keep_names_and_types(spark):
    df = spark.createDataFrame([(1, None), (2, "t")], "`a b;=` int, `A B;=2` string")
    back = materialise(df)
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())


def test_stepped_units(spark):
    df = spark.createDataFrame([(0.0004 * 341,), (None,)], "YEARS_BUILD_AVG double")
    assert [r[0] for r in rounded_units(df).collect()] == [20, None]
