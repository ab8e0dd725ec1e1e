"""Metrics, boosted trees, cross-validation and staged pipelines."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import hash_bucket
from ..operators.aggregate import metric_summary
from ..operators.encode import CategoricalEncoder, Ordinal
from ..operators.impute import MissingValuesImputer
from ..operators.model import BoostedTrees, r2_percent, roc_auc
from ..operators.select import VarianceSelect
from ..operators.tables import checkpoint_folder
from ..operators.validate import cross_validate
from ..plans.staged import StagedPipeline
from .aggregates import bucket_sql
from .base import labelled_documents, query, table
from .selectors import TEXT_NUMBERS, text_numbers

SCORED = "(select *, n_chars // 50 as score from documents join labels using (doc_id))"


def auc_sql(by: str) -> str:
    return f"""with s as (select {by} as g, quality, score, rank() over (partition by {by} order by score)
    + (count(*) over (partition by {by}, score) - 1) / 2.0::double as r from {SCORED})
    select g as {by}, (sum(case when quality = 1 then r end) - sum(quality) * (sum(quality) + 1) / 2.0::double)
    / nullif(sum(quality)::double * sum(1 - quality), 0) as auc from s group by 1"""


@query("roc_auc", auc_sql("lang"), "auc")
def auc_by_language(spark, sf):
    df = labelled_documents(spark, sf, "inner").withColumn("score", F.floor(F.col("n_chars") / 50))
    return roc_auc(df, "quality", "score", ["lang"])


@query(
    "r2",
    """select l_returnflag, 100 * (1 - sum((l_extendedprice - p) * (l_extendedprice - p)) / (count(*) * var_pop(l_extendedprice))) as r2
    from (select *, l_quantity * 1500 as p from lineitem) group by 1""",
    "r2",
)
def r2(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return df.groupBy("l_returnflag").agg(r2_percent("l_extendedprice", "p").alias("r2"))


def _price_folds(spark, sf) -> DataFrame:
    """Two simple price models over five folds of the lines."""
    df = table(spark, sf, "lineitem").withColumn("foldId", hash_bucket("l_orderkey", 5))
    models = {"flat": F.lit(38000.0), "per_unit": F.col("l_quantity") * 1500}
    parts = [df.withColumns({"modelName": F.lit(n), "p": p}) for n, p in models.items()]
    return reduce(DataFrame.unionByName, parts)


FOLD_SQL = f"""with f as (select *, {bucket_sql('l_orderkey', 5, 0)} as fold from lineitem),
    s as (select 'flat' as m, fold, l_extendedprice as y, 38000.0::double as p from f union all select 'per_unit', fold, l_extendedprice, l_quantity * 1500 from f),
    e as (select m, fold, 100 * (1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y))) as r2 from s group by 1, 2)"""


@query("cv_summary", FOLD_SQL + ' select m as "modelName", avg(r2) as r2_mean, stddev_samp(r2) as r2_std from e group by 1', "r2_mean r2_std")
def cv_summary(spark, sf):
    per_fold = _price_folds(spark, sf).groupBy("modelName", "foldId").agg(r2_percent("l_extendedprice", "p").alias("r2"))
    return metric_summary(per_fold, ["modelName"], ["r2"])


@query(
    "whole_metric",
    FOLD_SQL + ' select m as "modelName", 100 * (1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y))) as r2 from s group by 1',
    "r2",
)
def whole_metric(spark, sf):
    return _price_folds(spark, sf).groupBy("modelName").agg(r2_percent("l_extendedprice", "p").alias("r2"))


# -- models (no SQL form) -----------------------------------------------------------


@query("gbt_scores")
def gbt_scores(spark, sf):
    df = text_numbers(spark, sf)
    trees = BoostedTrees("quality", TEXT_NUMBERS, rounds=8, folds=3, max_depth=3, key="doc_id")
    return trees.fit(df).transform(df).select("doc_id", "prediction")


@query("gbt_log_probabilities")
def gbt_log_probabilities(spark, sf):
    df = text_numbers(spark, sf)
    model = BoostedTrees("quality", TEXT_NUMBERS, rounds=8, select_rounds="holdout", max_depth=3, key="doc_id").fit(df)
    out = model.log_probabilities(df)
    return out.select("doc_id", F.get("log_probabilities", 0).alias("log_p0"), F.get("log_probabilities", 1).alias("log_p1"))


@query("gbt_importance")
def gbt_importance(spark, sf):
    trees = BoostedTrees("quality", TEXT_NUMBERS, rounds=8, select_rounds="none", max_depth=3, key="doc_id")
    return trees.fit(text_numbers(spark, sf)).feature_importance(spark)


@query("gbt_regress")
def gbt_regress(spark, sf):
    df = table(spark, sf, "orders").join(
        table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("amount"), F.count(F.lit(1)).cast("double").alias("n_lines")),
        "o_orderkey",
    )
    trees = BoostedTrees("o_totalprice", ["amount", "n_lines"], "regression", rounds=5, folds=3, max_depth=3, key="o_orderkey")
    return trees.fit(df).transform(df).select("o_orderkey", "prediction")


@query("gbt_multiclass")
def gbt_multiclass(spark, sf):
    df = text_numbers(spark, sf).withColumn("kind", F.col("quality") + F.col("toxic") * 2 - F.col("quality") * F.col("toxic"))
    trees = BoostedTrees("kind", TEXT_NUMBERS, rounds=4, select_rounds="cv", folds=2, learning_rate=0.3, max_depth=3, class_weights="balanced", leaf_l2=1.0, key="doc_id")
    return trees.fit(df).transform(df).select("doc_id", "prediction")


@query("gbt_ranges", "select doc_id, true as scored, true as distributed, true as likeliest from documents")
def gbt_ranges(spark, sf):
    """Every document has a probability, and probabilities of three classes that sum to one."""
    df = text_numbers(spark, sf).withColumn("kind", F.col("quality") + F.col("toxic") * 2 - F.col("quality") * F.col("toxic"))
    two = BoostedTrees("quality", TEXT_NUMBERS, rounds=3, select_rounds="none", max_depth=3, key="doc_id").fit(df).transform(df)
    three = BoostedTrees("kind", TEXT_NUMBERS, rounds=2, select_rounds="none", max_depth=3, leaf_l1=0.1, leaf_l2=1.0, key="doc_id").fit(df)
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    several = three.transform(df).select(
        "doc_id",
        ((F.size(p) == 3) & F.forall(p, lambda x: (x > 0) & (x < 1)) & (F.abs(total - 1) < 1e-9)).alias("distributed"),
        (F.element_at(p, (F.col("prediction") + 1).cast("int")) == F.array_max(p)).alias("likeliest"),
    )
    return two.select("doc_id", F.col("prediction").between(0, 1).alias("scored")).join(several, "doc_id")


@query("cross_validate")
def cross_validation(spark, sf):
    df = text_numbers(spark, sf).where("quality IS NOT NULL")
    models = {
        "shallow": BoostedTrees("quality", TEXT_NUMBERS, rounds=4, select_rounds="none", max_depth=2, key="doc_id"),
        "deep": BoostedTrees("quality", TEXT_NUMBERS, rounds=4, select_rounds="none", max_depth=4, key="doc_id"),
    }
    result = cross_validate(models, df, "doc_id", "quality", {"auc": "auc", "r2": "r2"}, k=3, seeds=[1, 2])
    return result.statistics


def _stages():
    return [
        MissingValuesImputer("mean", columns=TEXT_NUMBERS),
        CategoricalEncoder(["lang"], [Ordinal()]),
        VarianceSelect(1e-6, keep=["doc_id", "quality"]),
        BoostedTrees("quality", TEXT_NUMBERS, rounds=4, select_rounds="none", max_depth=3, key="doc_id"),
    ]


@query("stage_reuse")
def stage_reuse(spark, sf):
    """The second fit reads the written stage outputs of the first."""
    df = text_numbers(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    folder = f"{checkpoint_folder(spark)}/stages-{hashlib.sha256(sf.encode()).hexdigest()[:8]}"
    labelled = df.where("quality IS NOT NULL")
    first = StagedPipeline(_stages(), folder).fit(labelled)
    second = StagedPipeline(_stages(), folder).fit(labelled)
    both = first.transform(df).withColumnRenamed("prediction", "first")
    again = second.transform(df).select("doc_id", F.col("prediction").alias("second"))
    return both.join(again, "doc_id").select("doc_id", "first", "second", F.lit(second.reused).alias("stages_reused"))
