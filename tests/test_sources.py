"""Catalog, dataset cache, label split and report sinks."""

import tempfile

from pyspark.sql import functions as F

from starloom.operators.encode import CategoricalEncoder, LeaveOneOut
from starloom.operators.validate import CrossValidation
from starloom.sources.schemas import schema_for
from starloom.sources.tables import Catalog, cached_tables, path_exists, read_csv_inferred, split_label, write_cross_validation


def test_catalog_and_views(spark, folder):
    catalog = Catalog(spark, folder, {"orders": "orders.parquet", "customer": "customer.parquet"})
    catalog.register()
    assert spark.sql("select count(*) from orders join customer on o_custkey = c_custkey").first()[0] == 1500
    features, target = split_label(catalog.table("customer"), "c_custkey", "c_acctbal")
    assert "c_acctbal" not in features.columns and target.columns == ["c_custkey", "target"]


def test_cache_is_written_once(spark):
    folder, calls = tempfile.mkdtemp(prefix="starloom-cache-"), []

    def make():
        calls.append(1)
        return spark.range(5)

    assert cached_tables(spark, folder, {"t": make})["t"].count() == 5
    assert cached_tables(spark, folder, {"t": make})["t"].count() == 5
    assert len(calls) == 1


def test_inferred_csv(spark):
    folder = tempfile.mkdtemp(prefix="starloom-infer-") + "/t"
    spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "n int, s string, x double").write.option("header", True).csv(folder)
    df = read_csv_inferred(spark, folder)
    assert dict(df.dtypes) == {"n": "int", "s": "string", "x": "double"}
    assert df.where("s is null").count() == 1


def test_schema_by_column_name():
    types = {f.name: f.dataType.simpleString() for f in schema_for(["SK_ID_CURR", "DAYS_BIRTH", "AMT_CREDIT", "ELEVATORS_AVG", "CODE_GENDER", "FLAG_DOCUMENT_7"])}
    assert types == {
        "SK_ID_CURR": "bigint",
        "DAYS_BIRTH": "int",
        "AMT_CREDIT": "double",
        "ELEVATORS_AVG": "double",
        "CODE_GENDER": "string",
        "FLAG_DOCUMENT_7": "int",
    }


def test_cross_validation_sink(spark):
    rows = spark.createDataFrame([("m", 0, 1, 7, 1.0, 0.25)], "modelName string, mcSeed int, foldId int, k long, label double, prediction double")
    folder = tempfile.mkdtemp(prefix="starloom-cv-")
    small = rows.select("modelName", F.lit(0.5).alias("auc"))
    write_cross_validation(CrossValidation(rows, small, small, small), folder)
    assert path_exists(spark, f"{folder}/statistics/_SUCCESS")
    assert spark.read.parquet(f"{folder}/predictions").where("foldId = 1").count() == 1


def test_noise_is_around_one(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 4).cast("string").alias("c"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    exact = CategoricalEncoder(["c"], [LeaveOneOut(noise=False)], label="y", drop_inputs=False).fit(df).transform_training(df)
    noisy = CategoricalEncoder(["c"], [LeaveOneOut(sigma=0.05)], label="y", drop_inputs=False).fit(df).transform_training(df)
    both = exact.withColumnRenamed("c_LeaveOneOutEncoder", "e").join(noisy.select("k", F.col("c_LeaveOneOutEncoder").alias("n")), "k")
    r = both.agg(F.avg(F.col("n") / F.col("e")).alias("mean"), F.stddev("n").alias("s"), F.stddev(F.col("n") / F.col("e")).alias("sigma")).first()
    assert abs(r["mean"] - 1) < 0.01 and abs(r["sigma"] - 0.05) < 0.01
