"""Boosted trees deal rows to folds only where folds choose the rounds."""

import pytest
from pyspark.sql import functions as F

from starloom.operators import model as M
from starloom.operators.model import BoostedTrees


def test_folds_are_made_for_choosing_rounds_only(spark, monkeypatch):
    df = spark.range(80).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 3 % 11).cast("double").alias("z"))
    given = dict(label="y", rounds=2, key="k", max_depth=2, folds=2)
    seen = []
    position = M.hash_ordered_position
    monkeypatch.setattr(M, "hash_ordered_position", lambda rows, *a: seen.append(rows.columns) or position(rows, *a))
    for how in ("none", "holdout"):
        BoostedTrees(select_rounds=how, **given).fit(df)
    assert seen == []
    assert BoostedTrees(select_rounds="cv", **given).fit(df).state["history"] == pytest.approx(BoostedTrees(select_rounds="cv", **given).fit(df).state["history"])
    assert len(seen) == 2 and "features" in seen[0] and "x" not in seen[0]
