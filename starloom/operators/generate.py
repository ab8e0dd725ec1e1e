"""Stages that add columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext
from ..functions.dates import calendar_parts, diff_seconds
from ..functions.semantics import as_col, log1p_or_null, ratio, sqrt_or_null
from ..functions.text import joined_text, special_chars, text_counts
from .aggregate import column_statistics, distinct_counts, numeric_columns
from .moments import column_moments, levels_up_to
from .stage import FeatureStage, FittedStage, PlainStage


class TextStatistics(PlainStage):
    """Character, token and word counts per text column.

    ``concatenate``: "no" counts each column, "yes" only their concatenation, "both" all.
    """

    def __init__(self, columns, concatenate="no"):
        super().__init__(columns=list(columns), concatenate=concatenate)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns, mode = self.config["columns"], self.config["concatenate"]
        joined = "concatenated_text"
        df = dataset if mode == "no" else dataset.withColumn(joined, joined_text(columns))
        targets = {"no": columns, "yes": [joined], "both": columns + [joined]}[mode]
        df = df.withColumns({f"{c}_{s}": e for c in targets for s, e in text_counts(c).items()})
        df = df.withColumns({f"{c}_nb_special_chars": special_chars(c) for c in targets})
        return df.drop(joined) if mode != "no" else df


class DateTimeFeatures(PlainStage):
    """Calendar parts per timestamp column and time differences per pair of columns."""

    def __init__(self, columns, total=False):
        super().__init__(columns=list(columns), total=total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = self.config["columns"]
        new = {f"{c}_{s}": e for c in columns for s, e in calendar_parts(c).items()}
        for i, a in enumerate(columns):
            for b in columns[i + 1 :]:
                new[f"{a}_{b}_time_diff_secs"] = diff_seconds(a, b, self.config["total"])
        return dataset.withColumns(new)


# How each function of a column is written in a feature name.
UNARY = {"log(1_+_{})": log1p_or_null, "exp({})": lambda c: F.exp(as_col(c)), "sqrt({})": sqrt_or_null}
COMBINE = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}


def pair_interactions(a: str, b: str) -> dict[str, Column]:
    """The 22 combinations of two numeric columns, by feature name."""
    x, y = as_col(a).cast("double"), as_col(b).cast("double")
    out = {f"{a}_{op}_{b}": f(x, y) for op, f in COMBINE.items()}
    out[f"{a}_/_{b}"] = ratio(a, b, mode="ieee")
    for shape, function in UNARY.items():
        right, left = function(y), function(x)
        out |= {f"{a}_{op}_{shape.format(b)}": f(x, right) for op, f in COMBINE.items()}
        out |= {f"{shape.format(a)}_{op}_{b}": f(left, y) for op, f in COMBINE.items()}
    return out


class PairwiseInteractions(FeatureStage):
    """Interactions of every pair of numeric columns.

    Without a column list all numeric columns are used but those with two values.  Columns
    in which the fitted rows overflow to ±inf are dropped, and the list is remembered;
    log(1+x) overflows at x = -1.
    """

    def __init__(self, columns=None, drop_overflow=True):
        super().__init__(columns=columns, drop_overflow=drop_overflow)

    def _fit(self, dataset: DataFrame) -> PairwiseInteractionsModel:
        columns = self.config["columns"]
        if columns is None:
            numbers = numeric_columns(dataset)
            if not numbers:
                raise TypeError("no numeric columns")
            levels = distinct_counts(dataset, [], numbers, "").first()
            columns = [c for c in numbers if levels[c] != 2]
        else:
            columns = [c for c in columns if c in numeric_columns(dataset)]
        overflow = overflowing(dataset, columns) if self.config["drop_overflow"] and len(columns) > 1 else []
        return PairwiseInteractionsModel(self.config, {"columns": columns, "overflow": overflow})


# Largest x whose exponential is finite, and a margin for what rounding adds to a bound.
EXP_LIMIT, MARGIN = 709.782712893384, 1 + 1e-9
# Flags packed into one integer.
PACKED = 62


class Interval:
    """What one aggregate tells of a column: finite bounds, its least magnitude but zero, and whether it has 0, -1 or infinities."""

    def __init__(self, low, high, least, zero, minus_one, infinite):
        self.known = low is not None
        self.low, self.high = (low, high) if self.known else (0.0, 0.0)
        self.size, self.least = max(abs(self.low), abs(self.high)), least
        self.zero, self.minus_one, self.infinite = bool(zero), bool(minus_one), bool(infinite)

    def transformed(self, shape: str) -> Interval:
        """Bounds of log(1 + x), exp(x) or sqrt(x) where they have a value."""
        out = Interval(self.low, self.high, None, False, False, self.infinite)
        if shape.startswith("log"):
            out.size = max(abs(math.log1p(max(self.low, -1 + 2.0**-53))), abs(math.log1p(max(self.high, -1 + 2.0**-53))), 40.0)
        elif shape.startswith("exp"):
            out.infinite |= self.high > EXP_LIMIT
            out.size = math.exp(min(self.high, EXP_LIMIT))
        else:
            out.size = math.sqrt(max(self.high, 0.0))
        return out


def may_overflow(op: str, x: Interval, y: Interval) -> bool:
    """Whether some pair of values within the bounds gives an infinity."""
    if x.infinite or y.infinite:
        return True
    if op == "/":
        return y.zero or y.least is not None and x.size / MAX_DOUBLE * MARGIN >= y.least
    if op == "*":
        return x.size > 0 and y.size > MAX_DOUBLE / x.size / MARGIN
    return x.size / 2 + y.size / 2 > MAX_DOUBLE / 2 / MARGIN


MAX_DOUBLE = 1.7976931348623157e308


def intervals(df: DataFrame, columns: list[str]) -> dict[str, Interval]:
    """One aggregate of a few statistics a column."""
    x = sqltext.finite("v")
    found = column_statistics(
        df.selectExpr(*[f"CAST({sqltext.name(c)} AS DOUBLE) AS {sqltext.name(c)}" for c in columns]),
        columns,
        {
            "low": f"min({x})",
            "high": f"max({x})",
            "least": f"min(CASE WHEN v <> 0 THEN abs({x}) END)",
            "zero": "coalesce(bool_or(v = 0), false)",
            "minus_one": "coalesce(bool_or(v = -1), false)",
            "infinite": "coalesce(bool_or(abs(v) = double('inf') OR isnan(v)), false)",
        },
    )
    return {c: Interval(**found[c]) for c in columns}


def overflowing(df: DataFrame, columns: list[str]) -> list[str]:
    """Names of the interactions that are infinite in some row, or take the logarithm of 1 + x where x is -1.

    The columns' intervals decide nearly all: a logarithm by its column alone, and whatever can't overflow.  The rest,
    such as divisions by a column with zeros, are looked at row by row in one more scan, their flags packed
    into integers.
    """
    bounds = intervals(df, columns)
    changed = {c: {shape: bounds[c].transformed(shape) if shape else bounds[c] for shape in ("", *UNARY)} for c in columns}
    names, certain, open_forms = [], set(), {}
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            forms = None
            for op, left, right in pair_shapes():
                n = f"{left.format(a) if left else a}_{op}_{right.format(b) if right else b}"
                names.append(n)
                if left.startswith("log") and bounds[a].minus_one or right.startswith("log") and bounds[b].minus_one:
                    certain.add(n)
                elif may_overflow(op, changed[a][left], changed[b][right]):
                    forms = forms or pair_interactions(a, b)
                    open_forms[n] = forms[n]
    if open_forms:
        flags = [F.coalesce(F.abs(e) == F.lit(float("inf")), F.lit(False)).cast("long") for e in open_forms.values()]
        packed = [reduce(Column.__add__, [f * F.lit(1 << i) for i, f in enumerate(flags[at : at + PACKED])]) for at in range(0, len(flags), PACKED)]
        row = df.select(F.posexplode(F.array(*packed)).alias("p", "f")).groupBy("p").agg(F.bit_or("f").alias("f")).collect()
        seen = {r["p"]: r["f"] for r in row}
        certain |= {n for i, n in enumerate(open_forms) if seen.get(i // PACKED, 0) >> (i % PACKED) & 1}
    return [n for n in names if n in certain]


def pair_shapes() -> list[tuple[str, str, str]]:
    """(operation, shape of the left side, of the right side) in the order of ``pair_interactions``."""
    out = [(op, "", "") for op in COMBINE] + [("/", "", "")]
    for shape in UNARY:
        out += [(op, "", shape) for op in COMBINE] + [(op, shape, "") for op in COMBINE]
    return out


def all_interactions(columns: list[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            out |= pair_interactions(a, b)
    return out


class PairwiseInteractionsModel(FittedStage):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        new = all_interactions(self.state["columns"])
        dropped = set(self.state["overflow"])
        return dataset.select("*", *[e.alias(n) for n, e in new.items() if n not in dropped])


class SkewLog(FeatureStage):
    """sign(x) log(1+|x|) on numeric columns that have enough values and are very skewed."""

    def __init__(self, threshold=5.0, min_distinct=10, ignore=(), columns=None):
        super().__init__(threshold=threshold, min_distinct=min_distinct, ignore=list(ignore), columns=columns)

    def _fit(self, dataset: DataFrame) -> SkewLogModel:
        cfg = self.config
        columns = [c for c in numeric_columns(dataset) if c not in cfg["ignore"] and c in (cfg["columns"] or dataset.columns)]
        if not columns:
            return SkewLogModel(cfg, {"columns": []})
        skews = column_moments(dataset, columns)
        # Few columns are skewed, and of their values only so many as decide are worth counting.
        skewed = [c for c in columns if abs(skews[c]["skew"] or 0.0) > cfg["threshold"]]
        levels = levels_up_to(dataset, skewed, cfg["min_distinct"])
        return SkewLogModel(cfg, {"columns": [c for c in skewed if levels[c] >= cfg["min_distinct"]]})


class SkewLogModel(FittedStage):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        new = {c: sqltext.signed_log(sqltext.name(c)) for c in self.state["columns"]}
        return dataset.selectExpr(*sqltext.named({c: new.get(c, sqltext.name(c)) for c in dataset.columns}))
