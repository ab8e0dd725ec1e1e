"""Filling missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import sqltext
from ..functions.semantics import FLOATING
from .aggregate import column_statistics, numeric_columns, string_columns
from .ranks import column_medians
from .stage import FeatureStage, FittedStage


class MissingValuesImputer(FeatureStage):
    """±inf and NULL filled: strings with a constant, numbers with mean, median or a constant.

    Fill values come from the fitted rows; ``refit`` computes them anew on each transform.
    """

    def __init__(self, numeric="mean", strings="NA", columns=None, refit=False):
        super().__init__(numeric=numeric, strings=strings, columns=columns, refit=refit)

    def _fit(self, dataset: DataFrame) -> MissingValuesImputerModel:
        cols = self.config["columns"] or dataset.columns
        numbers = [c for c in numeric_columns(dataset) if c in cols]
        texts = [c for c in string_columns(dataset) if c in cols]
        state = {"strings": texts, "numbers": numbers, "fill": fill_values(dataset, numbers, self.config["numeric"])}
        return MissingValuesImputerModel(self.config, state)


def clean(df: DataFrame, c: str) -> str:
    """SQL of a column with ±inf and NaN as NULL."""
    return sqltext.finite(sqltext.name(c)) if isinstance(df.schema[c].dataType, FLOATING) else sqltext.name(c)


def fill_values(df: DataFrame, numbers: list[str], how) -> dict[str, float | None]:
    if how not in ("mean", "median"):
        return {c: float(how) for c in numbers}
    if not numbers:
        return {}
    if how == "median":
        return column_medians(df.selectExpr(*sqltext.named({c: clean(df, c) for c in numbers})), numbers)
    means = column_statistics(df, numbers, {"mean": f"avg({sqltext.finite('v')})"})
    return {c: means[c]["mean"] for c in numbers}


class MissingValuesImputerModel(FittedStage):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        cfg, s = self.config, self.state
        fill = fill_values(dataset, s["numbers"], cfg["numeric"]) if cfg["refit"] else s["fill"]
        new = {c: f"coalesce({sqltext.name(c)}, {sqltext.literal(cfg['strings'])})" for c in s["strings"]}
        for c in s["numbers"]:
            value = fill[c]
            if value is None:
                new[c] = clean(dataset, c)
                continue
            whole = not isinstance(dataset.schema[c].dataType, FLOATING) and float(value).is_integer()
            text = f"CAST({int(value)} AS {dataset.schema[c].dataType.simpleString()})" if whole else sqltext.literal(float(value))
            new[c] = f"coalesce({clean(dataset, c)}, {text})"
        return dataset.selectExpr(*sqltext.named({c: new.get(c, sqltext.name(c)) for c in dataset.columns}))
