"""Encoders, selectors, models and pipelines on small rows; state survives saving."""

import random
import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel

from starloom.operators import encode as E
from starloom.operators import tables
from starloom.operators.impute import MissingValuesImputer
from starloom.operators.model import BoostedTrees, best_round, roc_auc
from starloom.operators.select import ConstantDrop, DuplicateDrop, NullShareSelect, VarianceSelect
from starloom.operators.validate import cross_validate, random_folds
from starloom.plans.staged import StagedPipeline
from starloom.sources.tables import read_csv, write_predictions


@pytest.fixture(scope="module")
def levels(spark):
    rows = [(1, "b", 1), (2, "b", 0), (3, "a", 1), (4, None, 0), (5, "c", None), (6, "a", 1), (7, "a", 0)]
    return spark.createDataFrame(rows, "k long, c string, y int")


def column(df, name):
    return {r["k"]: r[name] for r in df.collect()}


ENCODERS = [E.Ordinal(), E.Grouping(E.Ordinal(), 2), E.Grouping(E.TargetMean(), 0.9), E.TargetMean(), E.LeaveOneOut(noise=False)]


def encoder():
    return E.CategoricalEncoder(["c"] * 5 + ["c"], [*ENCODERS, E.OneHot()], label="y", drop_inputs=False)


def test_encoders(levels):
    stage = E.CategoricalEncoder(["c"], [E.Ordinal()])
    model = stage.fit(levels.where("k <> 5"))
    assert column(model.transform(levels), "c_OrdinalEncoder") == {1: 2, 2: 2, 3: 1, 4: 0, 5: None, 6: 1, 7: 1}
    loo = E.CategoricalEncoder(["c"], [E.LeaveOneOut(noise=False)], label="y").fit(levels.where("y is not null"))
    train = column(loo.transform_training(levels.where("y is not null")), "c_LeaveOneOutEncoder")
    assert train == {1: 0.0, 2: 1.0, 3: 0.5, 4: 0.5, 6: 0.5, 7: 1.0}
    score = column(loo.transform(levels.drop("y")), "c_LeaveOneOutEncoder")
    assert score[4] == score[5] == 0.5 and score[1] == 0.5 and abs(score[3] - 2 / 3) < 1e-12
    two = E.CategoricalEncoder(["c"], [E.OneHot()]).fit(levels.where("c in ('a', 'b')"))
    assert column(two.transform(levels), "c_LabelBinarizer") == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    mapped = E.CategoricalEncoder(["c"], [E.Ordinal({"a": 5, "NA": 9})]).fit(levels).transform(levels)
    assert column(mapped, "c_OrdinalEncoder")[4] == 9 and column(mapped, "c_OrdinalEncoder")[1] is None
    with pytest.raises(ValueError):
        E.CategoricalEncoder(["c"], [])


def test_large_level_tables_give_the_same(levels, monkeypatch):
    def run():
        stage = E.CategoricalEncoder(["c"], [E.Ordinal()], label="y")
        outs = []
        for e in ENCODERS:
            stage = E.CategoricalEncoder(["c"], [e], label="y")
            outs.append(column(stage.fit(levels).transform(levels), f"c_{e.suffix}"))
        return outs

    small = run()
    monkeypatch.setattr(E, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(tables.SizedTable.of.__func__, "__defaults__", (1,))
    monkeypatch.setattr(tables.rows_if_small, "__defaults__", (1,))
    assert run() == small


def test_saved_state(levels):
    path = tempfile.mkdtemp(prefix="starloom-model-")
    model = Pipeline(stages=[encoder(), MissingValuesImputer("median")]).fit(levels)
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a, b = model.transform(levels), again.transform(levels)
    assert a.columns == b.columns and a.exceptAll(b).count() == 0


def test_selectors(spark):
    rows = [(i, float(i), 2.0 * i, "v" + str(i), 1, None, i % 2, 1.0 if i == 0 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, a double, twice double, s string, one int, nothing double, b int, sparse double")
    assert ConstantDrop().fit(df).state["dropped"] == ["one", "nothing", "sparse"]
    assert ConstantDrop(drop_null=False).fit(df).state["dropped"] == ["one", "sparse"]
    assert DuplicateDrop(ignore=["k"]).fit(df).state["dropped"] == ["twice", "s"]
    assert NullShareSelect(0.85).fit(df).state["dropped"] == ["nothing", "sparse"]
    assert VarianceSelect(0.25).fit(df.select("a", "b", "one")).state["dropped"] == ["b", "one"]


def test_imputer_removes_infinity(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("inf"), None), (3.0, "y"), (None, "z"), (float("nan"), "z")], "a double, s string")
    assert [tuple(r) for r in MissingValuesImputer("mean").fit(df).transform(df).collect()][1] == (2.0, "NA")
    assert [r["a"] for r in MissingValuesImputer(-999).fit(df).transform(df).collect()] == [1.0, -999.0, 3.0, -999.0, -999.0]


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), float(rng.randint(0, 8))) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, y int, s double")
    pos, neg = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(roc_auc(df, "y", "s").first()["auc"] - want) < 1e-12
    assert abs(roc_auc(df, "y", "s", rows_per_task=3).first()["auc"] - want) < 1e-12
    assert roc_auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_folds_are_even(spark):
    df = spark.range(23).selectExpr("id as k", "cast(id < 5 as int) as y")
    sizes = [r["count"] for r in random_folds(df, "k", 4, label="y").groupBy("y", "fold").count().collect()]
    assert sorted(sizes) == [1, 1, 1, 2, 4, 4, 5, 5]


def test_best_round():
    assert best_round([3.0, 2.0, 2.5, 1.0]) == 4
    assert best_round([3.0, 2.0, 2.5, 2.6, 1.0], patience=2) == 2


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), i % 2) for i in range(300)]
    rows = [(k, a + 1.5 * y, b, "u" if y else "v", y) for k, a, b, y in rows]
    return spark.createDataFrame(rows, "k long, a double, b double, c string, y int")


def test_cross_validation(separable):
    models = {"trees": BoostedTrees("y", ["a", "b"], rounds=4, select_rounds="none", max_depth=2, key="k")}
    result = cross_validate(models, separable, "k", "y", {"auc": "auc", "r2": "r2"}, k=3)
    assert result.predictions.count() == 300
    assert result.whole.first()["auc"] > 0.7
    assert result.statistics.count() == 3 and result.summary.first()["auc_std"] is not None
    rolled = cross_validate(models, separable, "k", "y", {"auc": "auc"}, rolling=(["k"], 120, 60))
    assert rolled.statistics.count() == 3 and rolled.predictions.count() == 180


def test_staged_pipeline_reuses_the_unchanged_prefix(spark, separable):
    folder = tempfile.mkdtemp(prefix="starloom-stages-")

    def stages(threshold):
        return [
            E.CategoricalEncoder(["c"], [E.Ordinal()]),
            VarianceSelect(threshold, keep=["k", "y"]),
            BoostedTrees("y", ["a", "b"], rounds=2, select_rounds="none", max_depth=2, key="k"),
        ]

    first = StagedPipeline(stages(0.0), folder, version="v1").fit(separable)
    again = StagedPipeline(stages(0.0), folder, version="v1").fit(separable)
    changed = StagedPipeline(stages(0.1), folder, version="v1").fit(separable)
    other = StagedPipeline(stages(0.0), folder, version="v2").fit(separable)
    assert (first.reused, again.reused, changed.reused, other.reused) == (0, 2, 1, 0)
    a = {r["k"]: r["prediction"] for r in first.predict(separable).collect()}
    b = {r["k"]: r["prediction"] for r in again.predict(separable).collect()}
    assert a == b


def test_csv_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="starloom-csv-")
    df = spark.createDataFrame([(1, 0.25), (2, 0.5)], "SK_ID_CURR long, prediction double")
    write_predictions(df, f"{folder}/out")
    back = read_csv(spark, f"{folder}/out")
    assert dict(back.dtypes)["SK_ID_CURR"] == "bigint" and back.count() == 2
    raw = spark.createDataFrame([("1", "12.0", ""), ("2", "", "x")], "SK_ID_CURR string, OWN_CAR_AGE string, CODE_GENDER string")
    raw.write.option("header", True).csv(f"{folder}/typed")
    typed = {r["SK_ID_CURR"]: r for r in read_csv(spark, f"{folder}/typed").collect()}
    assert typed[1]["OWN_CAR_AGE"] == 12 and typed[2]["OWN_CAR_AGE"] is None and typed[1]["CODE_GENDER"] is None
