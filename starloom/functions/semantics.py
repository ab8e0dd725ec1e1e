"""The null, division and comparison contract every operator follows.

A missing value is always SQL NULL.  NaN and infinity are turned into NULL where
data enters, comparisons with NULL give 0 (or 1 for "differs"), and division never
raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
FLOATING = (T.FloatType, T.DoubleType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def as_col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def flag(condition: Column, when_null: bool = False) -> Column:
    """1 where the condition holds, 0 elsewhere; NULL counts as ``when_null``."""
    return F.coalesce(condition, F.lit(when_null)).cast("int")


def differs(a: Column | str, b) -> Column:
    """1 where a is not b; a missing side differs from every value."""
    return flag(as_col(a) != b, when_null=True)


def ratio(a: Column | str, b: Column | str, mode: str = "null", scale: float | None = None) -> Column:
    """a / b.  ``null``: zero divisor gives NULL.  ``ieee``: gives ±inf, and NULL for 0/0."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    out = F.try_divide(a, b)
    if mode == "ieee":
        inf = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
        out = F.when(b == 0, inf).otherwise(out)
    elif mode != "null":
        raise ValueError(f"unknown ratio mode {mode!r}")
    return out * F.lit(float(scale)) if scale is not None else out


def finite(c: Column | str) -> Column:
    """NaN and ±inf become NULL."""
    c = as_col(c)
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL instead of NaN in every floating column; other columns pass through."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    if not floating:
        return df
    return df.select(
        *[F.nanvl(as_col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in floating else as_col(c) for c in df.columns]
    )


def floor_div(a: Column | str, b: float) -> Column:
    """Division by a positive constant rounded down, taken from the exact remainder.

    0.12 by 0.04 gives 2: the stored 0.12 is a little less than three times 0.04.
    """
    a, d = as_col(a).cast("double"), F.lit(float(b))
    rest = a % d
    return F.rint((a - rest) / d) - F.when(rest < 0, F.lit(1.0)).otherwise(F.lit(0.0))


def signed_log(c: Column | str) -> Column:
    c = as_col(c)
    return F.signum(c.cast("double")) * F.log1p(F.abs(c))


def abs_log(c: Column | str) -> Column:
    return F.log1p(F.abs(as_col(c)))


def log1p_or_null(c: Column | str) -> Column:
    """log(1+x), NULL from -1 downwards."""
    return F.log1p(as_col(c))


def sqrt_or_null(c: Column | str) -> Column:
    c = as_col(c).cast("double")
    return F.when(c >= 0, F.sqrt(c))


def skew_g1(c: Column | str) -> Column:
    """Bias-corrected skewness (aggregate); NULL under three values or for a constant."""
    c = as_col(c)
    n = F.count(c).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n > 2, F.skewness(c) * factor)


def pair_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over rows where both are present; NULL when one is constant."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def hash_bucket(key_columns, buckets: int, seed: str | int = 0) -> Column:
    """Bucket 0..buckets-1 from the md5 of the key: independent of row order and cluster."""
    cols = [key_columns] if isinstance(key_columns, (str, Column)) else list(key_columns)
    text = F.concat_ws("|", F.lit(str(seed)), *[as_col(c).cast("string") for c in cols])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return (head % F.lit(int(buckets))).cast("int")


def md5_of(key_columns, seed: str | int = 0) -> Column:
    cols = [key_columns] if isinstance(key_columns, (str, Column)) else list(key_columns)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_col(c).cast("string") for c in cols]))


def sentinel_to_null(c: Column | str, *values) -> Column:
    c = as_col(c)
    return F.when(~c.isin(*values), c)


def null_outside(c: Column | str, low=None, high=None) -> Column:
    """Keep values in [low, high]; others and NULL become NULL."""
    c = as_col(c)
    tests = ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])
    return F.when(reduce(lambda p, q: p & q, tests), c)


def bins(c: Column | str, edges: list, values: list, default=0) -> Column:
    """Ordinal bin of a number.

    ``edges`` are ascending cut points; bin i holds edges[i-1] <= x < edges[i], the first
    is open below, and the last is open above when there are as many values as needed.
    NULL falls to the default.
    """
    c = as_col(c)
    out = F.when(c.isNull(), F.lit(default))
    for edge, value in zip(edges, values):
        out = out.when(c < edge, F.lit(value))
    rest = values[len(edges)] if len(values) > len(edges) else default
    return out.otherwise(F.lit(rest))


def value_map(c: Column | str, mapping: dict) -> Column:
    """Fixed value map; anything unmatched becomes NULL."""
    c = as_col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def epoch_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), as_col(c).cast("timestamp_ntz"))
