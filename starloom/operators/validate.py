"""Fold assignment and cross-validation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import as_col, hash_bucket, md5_of
from .aggregate import metric_summary
from .model import r2_percent, roc_auc
from .ordered import OrderedGroups, hash_ordered_position
from .tables import materialise, owned_tables


def random_folds(df: DataFrame, key: str, k: int, seed=0, label: str | None = None, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 by position in md5 order of the key, within each label when one is given.

    Fold sizes differ by one row at most (per label), and the result does not depend on
    the order or partitioning of the rows.
    """
    hashed = df.withColumn("__hash", md5_of(key, seed))
    groups = [label] if label else ["__one"]
    hashed = hashed if label else hashed.withColumn("__one", F.lit(0))
    placed = hash_ordered_position(hashed, groups, "__hash", "__position")
    return placed.withColumn(name, (F.col("__position") % k).cast("int")).drop("__hash", "__position", "__one")


def repeated_folds(df: DataFrame, key: str, k: int, seeds: list[int], label: str | None = None) -> DataFrame:
    """Rows once per repeat, with ``mcSeed`` and fold id = repeat x k + fold."""
    parts = []
    for i, seed in enumerate(seeds):
        part = random_folds(df, key, k, seed, label, "foldId")
        parts.append(part.withColumns({"mcSeed": F.lit(seed), "foldId": F.col("foldId") + i * k}))
    return reduce(DataFrame.unionByName, parts)


def rolling_positions(df: DataFrame, order: list[str], name: str = "position", rows_per_task: int | None = None) -> DataFrame:
    """Global 0-based row index in time order."""
    return OrderedGroups(df, [], order, rows_per_task).position(name)


def rolling_folds(df: DataFrame, order: list[str], train: int, test: int, rows_per_task: int | None = None) -> DataFrame:
    """Rows once per fold and part: fold f trains [f·test, f·test+train) and tests the next ``test``.

    There are (rows - train) // test folds.  Each row is copied to the folds it belongs to
    by arithmetic on its position.
    """
    n = df.count()
    folds = max(0, (n - train) // test)
    rows = rolling_positions(df, order, "position", rows_per_task)
    p = F.col("position")
    first = F.greatest(F.lit(0), F.floor((p - train - test) / test) + 1)
    last = F.least(F.lit(folds - 1), F.floor(p / test))
    rows = rows.withColumn("foldId", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))))
    start = F.col("foldId").cast("long") * test
    part = F.when((p >= start) & (p < start + train), F.lit("train")).when((p >= start + train) & (p < start + train + test), F.lit("test"))
    return rows.withColumn("part", part).where(F.col("part").isNotNull())


def train_test_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows split by the md5 of their key: the same rows each time, wherever they lie."""
    test = hash_bucket(key, 10_000, seed) < F.lit(int(round(test_share * 10_000)))
    return df.where(~test), df.where(test)


@dataclass
class CrossValidation:
    """Tables a cross-validation gives."""

    predictions: DataFrame
    statistics: DataFrame
    summary: DataFrame
    whole: DataFrame


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))


#: Metrics known by name, as aggregates of (label, prediction); for two classes the prediction is a probability.
METRICS = {
    "r2": r2_percent,
    "mae": lambda y, p: F.avg(F.abs(y - p)),
    "mse": lambda y, p: F.avg((y - p) * (y - p)),
    "rmse": lambda y, p: F.sqrt(F.avg((y - p) * (y - p))),
    "log_loss": lambda y, p: -F.avg(y * F.log(_clipped(p)) + (1 - y) * F.log(_clipped(1 - p))),
    "accuracy": lambda y, p: F.avg((F.when(p >= 0.5, 1.0).otherwise(0.0) == y).cast("double")),
}


def fold_metrics(df: DataFrame, by: list[str], label: str, metrics: dict) -> DataFrame:
    """Metrics per group.

    ``metrics`` maps an output name to "auc", a name in METRICS, or a function of the label and prediction
    columns that gives an aggregate; a pair (function, "class") gets the predicted class instead of the probability.
    """
    plain, curves = [], []
    for n, kind in metrics.items():
        if kind == "auc":
            curves.append(n)
            continue
        wanted, kind = ("class", kind[0]) if isinstance(kind, tuple) and kind[1] == "class" else ("score", kind[0] if isinstance(kind, tuple) else kind)
        if isinstance(kind, str) and kind not in METRICS:
            raise ValueError(f"no metric is called {kind!r}; known are auc, {', '.join(METRICS)}")
        y, p = as_col(label).cast("double"), F.col("prediction").cast("double")
        p = F.when(p >= 0.5, 1.0).otherwise(0.0) if wanted == "class" else p
        plain.append((METRICS[kind] if isinstance(kind, str) else kind)(y, p).alias(n))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *plain)
    for n in curves:
        out = out.join(roc_auc(df, label, "prediction", by, n), by, "left")
    return out


def cross_validate(
    models: dict,
    df: DataFrame,
    key: str,
    label: str,
    metrics: dict,
    k: int = 5,
    seeds=(0,),
    stratified: bool = True,
    rolling: tuple[list[str], int, int] | None = None,
    parallelism: int = 4,
) -> CrossValidation:
    """Fit every model on every fold and keep its predictions on the rows left out.

    ``rolling`` = (order, train rows, test rows) replaces random folds by time windows.
    Folds are a column of one written table; a few driver threads overlap their jobs.  Of the tables written, only the
    predictions stay.
    """
    with owned_tables(df.sparkSession) as owned:
        predictions, notes = _fold_predictions(models, df, key, label, k, seeds, stratified, rolling, parallelism)
        owned.keep(predictions)
    by = ["modelName", "mcSeed", "foldId"]
    notes = df.sparkSession.createDataFrame(notes, "modelName string, mcSeed int, foldId int, modelIterations int")
    statistics = fold_metrics(predictions, by, "label", metrics).join(F.broadcast(notes), by, "left")
    summary = metric_summary(statistics, ["modelName"], list(metrics))
    whole = fold_metrics(predictions, by[:2], "label", metrics)
    return CrossValidation(predictions, statistics, summary, whole)


def _fold_predictions(models, df, key, label, k, seeds, stratified, rolling, parallelism) -> tuple[DataFrame, list[tuple]]:
    """(predictions of all models on all folds as one written table, rounds each took)."""
    if rolling:
        order, train_rows, test_rows = rolling
        placed = materialise(rolling_positions(df, order, "__at").withColumn("mcSeed", F.lit(0)))
        folds = [(0, f) for f in range(max(0, (placed.count() - train_rows) // test_rows))]
    else:
        placed = materialise(repeated_folds(df, key, k, list(seeds), label if stratified else None))
        folds = [(seed, i * k + f) for i, seed in enumerate(seeds) for f in range(k)]

    def split(seed, fold):
        here = placed.where(F.col("mcSeed") == seed)
        if not rolling:
            return here.where(F.col("foldId") != fold), here.where(F.col("foldId") == fold)
        start, at = fold * test_rows, F.col("__at")
        middle = start + train_rows
        here = here.withColumn("foldId", F.lit(fold))
        return here.where((at >= start) & (at < middle)), here.where((at >= middle) & (at < middle + test_rows))

    def run(task):
        name, (seed, fold) = task
        train, test = split(seed, fold)
        model = models[name].fit(train.drop("mcSeed", "foldId", "__at"))
        scored = model.transform(test)
        iterations = next((s.state["rounds"] for s in getattr(model, "stages", [model]) if "rounds" in getattr(s, "state", {})), None)
        out = scored.select(
            F.lit(name).alias("modelName"), "mcSeed", "foldId", as_col(key), as_col(label).cast("double").alias("label"), "prediction"
        )
        return out, (name, seed, fold, iterations)

    tasks = [(m, f) for m in models for f in folds]
    with ThreadPoolExecutor(parallelism) as pool:
        done = [job.result() for job in [pool.submit(copy_context().run, run, task) for task in tasks]]
    return materialise(reduce(DataFrame.unionByName, [d[0] for d in done])), [d[1] for d in done]
