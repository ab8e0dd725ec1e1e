"""Statistics over several columns of one row, NULLs left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import as_col
from .sqltext import name


def null_count(columns) -> Column:
    """How many of the columns are NULL in this row."""
    return F.expr(" + ".join(["0"] + [f"CAST({name(c)} IS NULL AS INT)" for c in columns]))


def row_sum(columns) -> Column:
    """Sum with NULL as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_col(c).cast("double"), F.lit(0.0)) for c in columns], F.lit(0.0))


def row_product(columns) -> Column:
    return reduce(lambda a, b: a * b, [as_col(c).cast("double") for c in columns])


def row_count(columns) -> Column:
    return F.lit(len(columns)) - null_count(columns)


def row_mean(columns) -> Column:
    return F.try_divide(row_sum(columns), row_count(columns))


def row_range(columns) -> Column:
    values = F.array(*[as_col(c).cast("double") for c in columns])
    return F.abs(F.array_max(values) - F.array_min(values))


def row_std(columns) -> Column:
    """Population standard deviation."""
    mean = row_mean(columns)
    squares = [F.pow(as_col(c).cast("double") - mean, F.lit(2.0)) for c in columns]
    return F.sqrt(F.try_divide(row_sum(squares), row_count(columns)))


def row_median(columns) -> Column:
    """Middle value, or the mean of the two middle values."""
    present = F.array_sort(F.filter(F.array(*[as_col(c).cast("double") for c in columns]), lambda v: v.isNotNull()))
    n = F.size(present)
    low = F.get(present, F.floor((n - 1) / 2).cast("int"))
    high = F.get(present, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)
