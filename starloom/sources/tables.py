"""Table sources: typed CSV, inferred CSV, Parquet, a name -> path catalog, a dataset cache."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import as_col, nan_to_null
from ..operators.tables import rows_if_small
from .schemas import FILES, csv_header, schema_for


def read_csv(spark: SparkSession, path: str, types: dict[str, T.DataType] | None = None) -> DataFrame:
    """CSV with a header and fixed types; whole numbers written as "12.0" are read as well.

    Empty fields and NaN are NULL.  A 64-bit number, as keys are, that is not whole or not a number is an error.
    """
    header = csv_header(spark, path)
    schema = schema_for(header, types)
    # Integer columns with gaps are often written with a decimal point: read them wide first, keys as exact text.
    read_as = {T.IntegerType: T.DoubleType(), T.LongType: T.StringType()}
    wide = T.StructType([T.StructField(f.name, read_as.get(type(f.dataType), f.dataType)) for f in schema.fields])
    raw = nan_to_null(spark.read.option("header", True).option("nanValue", "NaN").schema(wide).csv(path))
    typed = {f.name: whole_key(f.name) if isinstance(f.dataType, T.LongType) else as_col(f.name).cast(f.dataType) for f in schema.fields}
    return raw.select(*[c.alias(n) for n, c in typed.items()])


def whole_key(column: str) -> Column:
    """Text as a 64-bit whole number; NULL only for an empty field or NaN."""
    text = F.trim(as_col(column))
    number = text.try_cast("decimal(38,18)")
    whole = F.coalesce(text.try_cast("bigint"), F.when(number == F.floor(number), F.floor(number).try_cast("bigint")))
    blank = text.isNull() | (text == "") | (F.lower(text) == "nan")
    wrong = F.raise_error(F.concat(F.lit(f"{column} is not a whole number: "), text))
    return F.when(blank, F.lit(None).cast("bigint")).when(whole.isNotNull(), whole).otherwise(wrong.cast("bigint"))


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and types guessed from the values (one more pass over the file)."""
    return nan_to_null(spark.read.option("header", True).option("inferSchema", True).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class Catalog:
    """Name -> path of the tables of one folder, CSV or Parquet."""

    def __init__(self, spark: SparkSession, folder: str, files: dict[str, str] | None = None):
        self.spark, self.folder, self.files = spark, folder, FILES if files is None else files

    def table(self, name: str) -> DataFrame:
        path = os.path.join(self.folder, self.files[name])
        if path.endswith(".csv"):
            return read_csv(self.spark, path)
        return nan_to_null(read_parquet(self.spark, path))

    def register(self) -> None:
        """Temporary views of every table, for SQL."""
        for name in self.files:
            self.table(name).createOrReplaceTempView(name)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def cached_tables(spark: SparkSession, folder: str, make: dict) -> dict[str, DataFrame]:
    """Typed Parquet copies of tables, written on first use and read from then on.

    ``make`` maps a name to a function giving the table.  A copy counts only when its
    write finished.
    """
    out = {}
    for name, build in make.items():
        path = f"{folder}/{name}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def bucketed_table(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Table bucketed and sorted by a key, so that later joins and aggregates on it do not shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).format("parquet").mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def split_label(df: DataFrame, key: str, label: str, name: str = "target") -> tuple[DataFrame, DataFrame]:
    """(features without the label, (key, label) table)."""
    return df.drop(label), df.select(as_col(key), as_col(label).alias(name))


# -- sinks ----------------------------------------------------------------------


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str, key: str = "SK_ID_CURR", name: str = "TARGET") -> None:
    """(key, prediction) as CSV with a header."""
    out = df.select(as_col(key), F.col("prediction").alias(name))
    out.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A table (importance, statistics) as CSV: one file if its checked size is small, else one for each partition."""
    rows = rows_if_small(df)
    if rows is not None:
        df = df.sparkSession.createDataFrame(rows, df.schema).coalesce(1)
    df.write.mode("overwrite").option("header", True).csv(path)


def write_cross_validation(result, folder: str) -> None:
    """Statistics and summaries as reports, predictions as Parquet by model, repeat and fold."""
    write_report(result.statistics, f"{folder}/statistics")
    write_report(result.summary, f"{folder}/summary")
    write_report(result.whole, f"{folder}/whole")
    result.predictions.write.mode("overwrite").partitionBy("modelName", "mcSeed", "foldId").parquet(f"{folder}/predictions")
