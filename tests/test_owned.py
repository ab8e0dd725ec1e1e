"""Written tables go with the job that wrote them; keys of CSV files are whole or an error; reports are of checked size."""

import os
import tempfile
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

import pytest
from pyspark.sql import functions as F

from starloom.operators import tables as tables_module
from starloom.operators.model import BoostedTrees
from starloom.operators.tables import discard, materialise, owned_tables
from starloom.operators.validate import cross_validate
from starloom.plans.credit_run import run
from starloom.sources import tables as sources
from starloom.sources.tables import read_csv, write_report
from starloom.suite.mapping import credit_tables


@pytest.fixture
def shared(monkeypatch):
    folder = tempfile.mkdtemp(prefix="starloom-shared-")
    monkeypatch.setattr(tables_module, "checkpoint_folder", lambda spark: folder)
    return folder


def test_tables_go_with_their_job(spark, shared):
    outside = materialise(spark.range(3))
    with owned_tables(spark) as outer:
        a = materialise(spark.range(4))
        with owned_tables(spark) as inner:
            b, c = materialise(spark.range(5)), materialise(spark.range(6))
            with ThreadPoolExecutor(2) as pool:
                d = pool.submit(copy_context().run, materialise, spark.range(7)).result()
            assert len(os.listdir(shared)) == 5 and d.count() == 7
            inner.keep(b, spark.range(1))
        assert len(os.listdir(shared)) == 3 and b.count() == 5
        outer.keep(a)
    assert len(os.listdir(shared)) == 2 and a.count() == 4 and outside.count() == 3
    with pytest.raises(ZeroDivisionError), owned_tables(spark):
        materialise(spark.range(4))
        1 / 0  # noqa: B018
    discard(a, outside, spark.range(1))
    assert os.listdir(shared) == []


def test_a_run_leaves_its_predictions_only(spark, shared, folder):
    tables = credit_tables(spark, folder)
    app = tables["application"]
    out = tempfile.mkdtemp(prefix="starloom-out-")
    result = run(tables, app.where("TARGET IS NOT NULL"), app, output=out, rounds=2, select_rounds="none", max_depth=2)
    assert len(os.listdir(shared)) == 1
    assert result.predictions.count() == app.count() and result.importance.count() > 0
    result.discard()
    assert os.listdir(shared) == []
    assert spark.read.option("header", True).csv(f"{out}/predictions").count() == app.count()


def test_cross_validation_leaves_its_predictions_only(spark, shared):
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("x"))
    models = {"m": BoostedTrees(label="y", rounds=2, key="k", select_rounds="none", max_depth=2)}
    done = cross_validate(models, df, "k", "y", {"auc": "auc"}, k=2)
    assert len(os.listdir(shared)) == 1 and done.predictions.count() == 60 and done.statistics.count() == 2
    discard(done.predictions)
    assert os.listdir(shared) == []


def test_keys_are_whole_or_an_error(spark):
    def read(*keys):
        folder = tempfile.mkdtemp(prefix="starloom-keys-") + "/t"
        spark.createDataFrame([(k, "1.0") for k in keys], "SK_ID_CURR string, TARGET string").coalesce(1).write.option("header", True).csv(folder)
        return [r["SK_ID_CURR"] for r in read_csv(spark, folder).collect()]

    assert read("12.0", "9007199254740993", " 7 ", None, "NaN", "-3", "1e3") == [12, 9007199254740993, 7, None, None, -3, 1000]
    for bad in ("12.5", "x7", "99999999999999999999"):
        with pytest.raises(Exception, match="not a whole number"):
            read("1", bad)


def test_reports_are_one_file_if_small(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="starloom-report-")
    parts = lambda name: sum(f.startswith("part-") for f in os.listdir(f"{folder}/{name}"))
    write_report(spark.range(0, 100, 1, 4), f"{folder}/small")
    monkeypatch.setattr(sources, "rows_if_small", lambda df: tables_module.rows_if_small(df, 10))
    write_report(spark.range(0, 100, 1, 4), f"{folder}/large")
    assert parts("small") == 1 and parts("large") == 4
    assert spark.read.option("header", True).csv(f"{folder}/small").count() == spark.read.option("header", True).csv(f"{folder}/large").count() == 100
