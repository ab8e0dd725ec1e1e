"""Boosting with a shared softmax, row and class weights, and penalties on leaves."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from starloom.operators.model import BoostedTrees, BoostedTreesModel
from starloom.operators.newton import NewtonTrees, leaf_value
from starloom.operators.select import assembled


@pytest.fixture(scope="module")
def three(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        x, y, z = rng.random(), rng.random(), rng.random()
        p = [math.exp(3 * x - 1), math.exp(3 * y - 1), math.exp(2 * (1 - x) * (1 - y))]
        rows.append((i, x, y, z, float(rng.choices([0, 1, 2], p)[0]), 1.0 + (i % 2)))
    return spark.createDataFrame(rows, "id long, x double, y double, z double, kind double, w double").repartition(3).cache()


def log_loss(rows):
    return sum(-math.log(max(1e-15, r["probabilities"][int(r["kind"])])) for r in rows) / len(rows)


def test_shared_softmax_beats_one_against_the_rest(spark, three, tmp_path):
    train, test = three.where("id % 3 > 0"), three.where("id % 3 = 0")
    model = BoostedTrees("kind", ["x", "y", "z"], rounds=6, select_rounds="cv", folds=2, learning_rate=0.3, max_depth=2, leaf_l2=1.0, key="id").fit(train)
    assert len(model.state["history"]) == 6 and 1 <= model.state["rounds"] <= 6 and len(model.state["values"]) == model.state["rounds"]
    scored = model.transform(test).collect()
    assert all(sum(r["probabilities"]) == pytest.approx(1) and r["prediction"] == np.argmax(r["probabilities"]) for r in scored)
    rest = OneVsRest(classifier=GBTClassifier(maxIter=model.state["rounds"], stepSize=0.3, maxDepth=2, labelCol="label"), labelCol="label")
    others = rest.fit(assembled(train, ["x", "y", "z"]).withColumn("label", F.col("kind"))).transform(assembled(test, ["x", "y", "z"]))
    own = F.transform(vector_to_array("rawPrediction"), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * m)))
    others = others.withColumn("own", own).select("kind", F.transform("own", lambda p: p / F.aggregate("own", F.lit(0.0), lambda a, b: a + b)).alias("probabilities"))
    prior = [r[1] / train.count() for r in sorted(train.groupBy("kind").count().collect())]
    assert log_loss(scored) < log_loss(others.collect())
    assert log_loss(scored) < sum(-math.log(prior[int(r["kind"])]) for r in scored) / len(scored)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = {r["id"]: r["probabilities"] for r in BoostedTreesModel.load(str(tmp_path / "m")).transform(test).collect()}
    assert all(again[r["id"]] == pytest.approx(r["probabilities"]) for r in scored)
    assert [f for f, _ in model.importance_rows()][2] == "z"


def test_weights(spark, three):
    config = dict(rounds=1, select_rounds="none", max_depth=1, learning_rate=1.0, key="id")
    plain = BoostedTrees("kind", ["x"], **config).fit(three).state["start"]
    balanced = BoostedTrees("kind", ["x"], class_weights="balanced", **config).fit(three).state["start"]
    assert balanced == pytest.approx([math.log(201 / 603)] * 3) and plain != pytest.approx(balanced)
    twice = three.withColumn("w", F.lit(1.0)).unionByName(three.where("id % 2 = 1").withColumn("w", F.lit(1.0)))
    weighted = BoostedTrees("kind", ["x"], weight="w", **config).fit(three).state["start"]
    assert weighted == pytest.approx(BoostedTrees("kind", ["x"], **config).fit(twice).state["start"])
    counts = [BoostedTrees("kind", ["x"], class_weights=w, **config).fit(three).transform(three).where("prediction = 2").count() for w in (None, [1, 1, 50])]
    assert counts[1] > counts[0]


def test_leaf_penalties(spark):
    config = {"learning_rate": 0.5, "leaf_l1": 2.0, "leaf_l2": 3.0}
    assert leaf_value(5.0, 7.0, config) == 0.5 * 3.0 / 10.0 and leaf_value(-5.0, 7.0, config) == -0.15 and leaf_value(1.5, 7.0, config) == 0.0
    rows = [(i, float(i % 2), 10.0 * (i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    fitted = BoostedTrees("y", ["x"], "regression", rounds=1, select_rounds="none", learning_rate=1.0, max_depth=1, leaf_l2=20.0, key="id").fit(df)
    # twenty rows a leaf with a gradient of five each: half of the step is left
    assert sorted({round(r["prediction"], 9) for r in fitted.transform(df).collect()}) == [2.5, 7.5]
    still = BoostedTrees("y", ["x"], "regression", rounds=1, select_rounds="none", max_depth=1, leaf_l1=1e6, key="id").fit(df)
    assert {r["prediction"] for r in still.transform(df).collect()} == {5.0}
    two = BoostedTrees("z", ["x"], rounds=2, select_rounds="holdout", max_depth=1, leaf_l2=1.0, key="id").fit(df.withColumn("z", (F.col("x") > 0).cast("int")))
    assert two.transform(df).where("(prediction > 0.5) = (x > 0)").count() == 40


def test_derivatives_follow_the_loss(spark):
    rows = spark.createDataFrame([(2.0, 1.5, [0.3, -0.2, 0.9])], "label double, weight double, m array<double>")
    trees = NewtonTrees({}, 3)
    r, step = trees.derivatives(rows).first(), 1e-5
    loss = lambda m: 1.5 * -math.log(math.exp(m[2]) / sum(map(math.exp, m)))
    for k in range(3):
        moved = lambda d, k=k: [v + d * (i == k) for i, v in enumerate([0.3, -0.2, 0.9])]
        assert r[f"g{k}"] == pytest.approx(-(loss(moved(step)) - loss(moved(-step))) / (2 * step), abs=1e-6)
        assert r[f"h{k}"] == pytest.approx((loss(moved(step)) - 2 * loss(moved(0)) + loss(moved(-step))) / step**2, abs=1e-4)


def test_settings_that_do_not_go_together(three):
    for more in ({"positive_weight": 2.0}, {"subsample": 0.5}, {"metric": "auc"}):
        with pytest.raises(ValueError):
            BoostedTrees("kind", ["x"], rounds=1, key="id", **more).fit(three)
