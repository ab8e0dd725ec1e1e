"""Aggregates per key, whole-table profiles, pivots and level statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import FLOATING, NUMERIC, WHOLE, as_col, differs, pair_corr, skew_g1
from ..functions.sqltext import literal, name, named
from .gramian import correlation_pairs
from .runs import NATIVE, can_run, folded, run_statistics
from .tables import HotKeys, SizedTable, attach_group_values, group_sizes, materialise, rows_if_small

SIX = ("mean", "std", "min", "max", "sum", "nunique")
MAX_LEVELS = 10_000
# Most values (rows x columns) of one group that are kept as sets while counting them; larger groups are counted apart.
GROUP_VALUES = 20_000
# Columns to be counted from which on statistics of small groups are taken from sorted rows.
RUN_COLUMNS = 8


def numeric_columns(df: DataFrame, but=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in but]


def string_columns(df: DataFrame, but=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in but]


# -- distinct counts ------------------------------------------------------------


def _storage(data_type: T.DataType) -> tuple[str, str]:
    """(field, SQL type) a value of this type keeps its exact value in."""
    if isinstance(data_type, FLOATING):
        return "d", "double"
    if isinstance(data_type, WHOLE + (T.BooleanType,)):
        return "l", "bigint"
    return "s", "string"


def long_values(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep, __f, value fields): one row per column and row, NULL values left out."""
    kinds = {c: _storage(df.schema[c].dataType) for c in columns}
    fields = dict(sorted(set(kinds.values())))
    entries = []
    for i, c in enumerate(columns):
        values = [f"CAST({name(c) if kinds[c][0] == f else 'NULL'} AS {sql}) AS __{f}" for f, sql in fields.items()]
        entries.append(f"struct({i} AS __f, {', '.join(values)})")
    out = df.selectExpr(*map(name, keep), f"inline(array({', '.join(entries)}))")
    return out.where(" OR ".join(f"__{f} IS NOT NULL" for f in fields))


def distinct_counts(df: DataFrame, keys: list[str], columns: list[str], suffix: str = "_nunique") -> DataFrame:
    """Distinct non-NULL values of each column per key.

    Values are deduplicated as narrow (key, column, value) rows before and after the
    shuffle and counted afterwards, so neither one key's values nor one copy of the
    row per column ever gather in a task.
    """
    unique = long_values(df, columns, keys).distinct()
    counts = {c + suffix: f"count(CASE WHEN __f = {i} THEN 1 END)" for i, c in enumerate(columns)}
    return grouped(unique, keys, counts)


def grouped(df: DataFrame, keys: list[str], expressions: dict[str, str], extra: list[Column] = ()) -> DataFrame:
    """Aggregates given as SQL text (and further ones as columns) per key, in one step."""
    if not expressions:
        return df.groupBy(*map(as_col, keys)).agg(*extra)
    wide = F.expr(f"struct({', '.join(named(expressions))})").alias("__wide")
    out = df.groupBy(*map(as_col, keys)).agg(wide, *extra)
    rest = [c for c in out.columns if c not in keys and c != "__wide"]
    return out.selectExpr(*map(name, keys), "__wide.*", *map(name, rest))


def column_statistics(df: DataFrame, columns: list[str], statistics: dict[str, str], numbers_as_double: bool = True) -> dict[str, dict]:
    """The same statistics of many columns of a whole table: column -> statistic -> value.

    Columns of one kind are unpivoted into (position, v) rows inside each task and grouped
    by position, so a handful of aggregates serves any number of columns and only one row
    per column and task is shuffled.  ``statistics`` are SQL texts over ``v``.
    """
    kinds: dict[str, list[str]] = {}
    for c in columns:
        sql = _storage(df.schema[c].dataType)[1]
        kinds.setdefault("double" if sql == "bigint" and numbers_as_double else sql, []).append(c)
    out = {}
    for sql, members in kinds.items():
        values = ", ".join(f"CAST({name(c)} AS {sql})" for c in members)
        rows = df.selectExpr(f"posexplode(array({values})) AS (f, v)")
        found = {r["f"]: r for r in grouped(rows, ["f"], statistics).collect()}
        empty = dict.fromkeys(statistics)
        out |= {c: {s: found[i][s] for s in statistics} if i in found else empty for i, c in enumerate(members)}
    return out


# -- per key --------------------------------------------------------------------


# SQL of each statistic.
STATISTICS = {
    "mean": "avg({})",
    "std": "stddev_samp({})",
    "min": "min({})",
    "max": "max({})",
    "sum": "coalesce(sum({}), 0)",
    "count": "count({})",
}


def exact_std(column: str) -> str:
    """SQL of the sample deviation of a whole number of up to 32 bits, the same in whatever order rows are summed.

    Squares are summed in three parts of 21 bits, which hold 2^42 rows, and centred at the truncated mean as whole numbers;
    only the last division and root round.  Rows of equal values, and shifted ones, have equal deviations.
    """
    x = name(column)
    square = f"(CAST({x} AS BIGINT) * CAST({x} AS BIGINT))"
    parts = [f"shiftright({square}, 42)", f"(shiftright({square}, 21) & 2097151L)", f"({square} & 2097151L)"]
    high, middle, low = (f"CAST(sum({part}) AS DECIMAL(38, 0))" for part in parts)
    squares = f"({high} * 4398046511104 + {middle} * 2097152 + {low})"
    n, total = f"CAST(count({x}) AS DECIMAL(20, 0))", f"CAST(sum({x}) AS DECIMAL(20, 0))"
    mean = f"CAST(sum({x}) div nullif(count({x}), 0) AS DECIMAL(10, 0))"
    rest = f"({total} - {mean} * {n})"
    centred = f"({squares} - 2 * {mean} * {total} + {n} * {mean} * {mean})"
    whole = f"CAST(try_subtract(try_multiply({n}, {centred}), {rest} * {rest}) AS DOUBLE) / CAST({n} * ({n} - 1) AS DOUBLE)"
    rounded = f"(CAST({centred} AS DOUBLE) - CAST({rest} AS DOUBLE) * CAST({rest} AS DOUBLE) / count({x})) / (count({x}) - 1)"
    return f"CASE WHEN count({x}) > 1 THEN sqrt(coalesce({whole}, {rounded})) END"


def large_groups(df: DataFrame, keys: list[str], most: int) -> tuple[HotKeys, bool]:
    """(groups of more than ``most`` rows, whether there are others); a written table only where there are both."""
    sizes = group_sizes(df, keys)
    over = F.col("__rows") > most
    largest, count, total = sizes.agg(F.coalesce(F.max("__rows"), F.lit(0)), F.count_if(over), F.count(F.lit(1))).first()
    table = materialise(sizes.where(over)) if 0 < count < total else None
    return HotKeys(keys, table, count, most, largest), count < total


def bulk_stats(
    df: DataFrame,
    keys: list[str],
    columns: list[str] | None = None,
    stats=SIX,
    extra: list[Column] = (),
    distinct_only: list[str] = (),
    prefix: str = "",
    groups: HotKeys | None = None,
    placed: bool = False,
    exact: bool = False,
    folds: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Several statistics of every numeric column per key, plus further aggregates.

    Columns come out as ``column_stat``.  ``distinct_only`` columns of any type get their
    distinct count alone.  Rows with a NULL key are left out.

    Rows of small groups are brought together by key and all statistics, distinct sets included, are taken in one
    step; ``placed`` says that they already lie together.  Of large groups sums are combined before the shuffle and
    distinct values counted as narrow rows, whatever the other groups look like.  ``groups`` may give the group sizes
    if known.  ``folds`` are further aggregates, name -> (kind, expression on rows); with them, and without ``extra``, small
    groups of many columns are taken from sorted rows (``run_statistics``).  ``exact`` takes deviations of whole numbers of up to 32 bits without regard to the order of rows.
    """
    columns = numeric_columns(df, keys) if columns is None else list(columns)
    rows = df.where(reduce(lambda a, b: a & b, [as_col(k).isNotNull() for k in keys]))
    forms = {(c, s): STATISTICS[s].format(name(c)) for c in columns for s in stats if s != "nunique"}
    if exact:
        narrow = (T.ByteType, T.ShortType, T.IntegerType)
        forms |= {(c, s): exact_std(c) for c, s in forms if s == "std" and isinstance(df.schema[c].dataType, narrow)}
    plain = {f"{c}_{s}": sql for (c, s), sql in forms.items()}
    counted = ([*columns] if "nunique" in stats else []) + list(distinct_only)
    folds = folds or {}
    rows, wanted = folded(rows, folds)
    wanted = {f"{c}_{s}": (c, s) for c, s in forms} | wanted | {f"{c}_nunique": (c, "nunique") for c in counted}
    runs = wanted if not extra and not exact and len(counted) >= RUN_COLUMNS and can_run(rows, keys, list(wanted.values())) else None
    extra = [*extra, *[NATIVE[kind](as_col(c)).alias(n) for n, (c, kind) in wanted.items() if n in folds]]
    if not plain and not extra:
        plain = {"__n": "count(1)"}
    if not counted:
        out = grouped(rows, keys, plain, extra)
    else:
        out = _with_distinct(rows, keys, plain, extra, list(dict.fromkeys(counted)), groups, placed, runs)
    order = [f"{c}_{s}" for c in columns for s in stats] + [f"{c}_nunique" for c in distinct_only]
    known = {*order, *keys, "__n"}
    rest = [c for c in out.columns if c not in known]
    counts = {f"{c}_nunique" for c in counted}
    picked = {prefix + c: f"coalesce(CAST({name(c)} AS BIGINT), 0L)" if c in counts else name(c) for c in order + rest}
    return out.selectExpr(*map(name, keys), *named(picked))


def _with_distinct(rows, keys, plain, extra, counted, groups, placed, runs=None) -> DataFrame:
    """Statistics and distinct counts: sorted rows or sets for small groups, narrow rows for large ones."""

    def gathered(part: DataFrame, lying: bool) -> DataFrame:
        if runs is not None:
            # rows that do lie together are not moved again: the planner drops this exchange
            return run_statistics(part.repartition(*map(as_col, keys)), keys, runs)
        sets = {f"{c}_nunique": f"size(collect_set({name(c)}))" for c in counted}
        return grouped(part if lying else part.repartition(*map(as_col, keys)), keys, plain | sets, extra)

    def narrow(part: DataFrame) -> DataFrame:
        return grouped(part, keys, plain, extra).join(distinct_counts(part, keys, counted), keys, "left")

    most = GROUP_VALUES // len(counted)
    if groups is not None and groups.largest <= most:
        return gathered(rows, placed)
    large, others = large_groups(rows, keys, most)
    if not large:
        return gathered(rows, placed)
    if not others:
        return narrow(rows)
    marked = large.join(rows, large.table.select(*map(as_col, keys), F.lit(True).alias("__large")))
    return gathered(marked.where("__large IS NULL").drop("__large"), placed).unionByName(narrow(marked.where("__large").drop("__large")))


def distinct_levels(df: DataFrame, column: str, limit: int = MAX_LEVELS) -> list:
    """Sorted non-NULL levels of a column that is about to become columns."""
    found = rows_if_small(df.where(as_col(column).isNotNull()).select(as_col(column)).distinct(), limit)
    if found is None:
        raise ValueError(f"{column} has more than {limit} levels; they cannot become columns, take pivot_long or crosstab_long")
    return sorted(r[0] for r in found)


def level_folds(column: str, levels: list, prefix: str) -> dict[str, tuple[str, Column]]:
    """``level_counts`` with 0 for absent levels, as folds of ``bulk_stats``."""
    return {f"{prefix}{level}": ("count", F.expr(f"CASE WHEN {name(column)} = {literal(level)} THEN 1 END")) for level in levels}


def level_counts(column: str, levels: list, prefix: str, absent) -> list[Column]:
    """One count per level, for use inside any aggregate."""
    out = []
    for level in levels:
        n = f"count(CASE WHEN {name(column)} = {literal(level)} THEN 1 END)"
        out.append(F.expr(n if absent is not None else f"nullif({n}, 0)").alias(f"{prefix}{level}"))
    return out


def pivot_counts(
    df: DataFrame, keys: list[str], column: str, levels: list | None = None, absent=None, prefix: str | None = None
) -> DataFrame:
    """Rows per level as columns, NULL (or 0) where a key lacks the level; NULL levels do not count."""
    levels = distinct_levels(df, column) if levels is None else levels
    prefix = f"{column}_" if prefix is None else prefix
    rows = df.where(as_col(column).isNotNull())
    return rows.groupBy(*[as_col(k) for k in keys]).agg(*level_counts(column, levels, prefix, absent))


def pivot_long(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, level, n): the pivot as rows, for any number of levels; NULL levels do not count."""
    rows = df.where(as_col(column).isNotNull())
    return rows.groupBy(*[as_col(k) for k in keys], as_col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def two_level(df: DataFrame, keys: list[str], inner: list[str], first: list[Column], then: list[Column]) -> DataFrame:
    """Aggregate per (keys, inner), then aggregate those results per keys."""
    by = [as_col(k) for k in keys]
    return df.groupBy(*by, *[as_col(k) for k in inner]).agg(*first).groupBy(*by).agg(*then)


def conditional_percentage(condition: Column) -> Column:
    """100 x rows meeting the condition / all rows."""
    return F.count(F.when(condition, 1)) * 100.0 / F.count(F.lit(1))


def conditional_sum(value: Column | str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, as_col(value)).otherwise(F.lit(0))), F.lit(0))


def share_where_differs(c: Column | str, value) -> Column:
    """Mean of the 0/1 flag "not this value", NULL being different."""
    return F.avg(differs(c, value))


def label_rate(df: DataFrame, level: str, target: str, labelled_only: bool = False, out: str = "rate") -> DataFrame:
    """Sum of the label over the rows of each level; unlabelled rows count unless told otherwise."""
    rows = F.count(as_col(target)) if labelled_only else F.count(F.lit(1))
    rate = F.try_divide(F.coalesce(F.sum(as_col(target)).cast("double"), F.lit(0.0)), rows)
    return df.where(as_col(level).isNotNull()).groupBy(as_col(level)).agg(rate.alias(out))


def keyed_label_rates(rows: DataFrame, key: str, columns: list[str], target: DataFrame, label: str, labelled_only: bool = False) -> SizedTable:
    """(column, level, rate) for several columns of a child table whose label hangs on the key.

    Rows are counted per (key, column, level) before they meet the labels, so a key with
    many rows joins as a few.
    """
    entries = [F.struct(F.lit(c).alias("column"), as_col(c).cast("string").alias("level")) for c in columns]
    narrow = rows.select(as_col(key), F.inline(F.array(*entries))).where(F.col("level").isNotNull())
    counted = narrow.groupBy(as_col(key), "column", "level").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(target.select(as_col(key), as_col(label).cast("double").alias("y")), key, "left")
    over = F.sum(F.when(F.col("y").isNotNull(), F.col("n"))) if labelled_only else F.sum("n")
    rate = F.try_divide(F.coalesce(F.sum(F.col("y") * F.col("n")), F.lit(0.0)), over.cast("double"))
    return SizedTable.of(joined.groupBy("column", "level").agg(rate.alias("rate")))


def with_label_rates(df: DataFrame, rates: SizedTable, columns: list[str], suffix: str = "_TgtAvg") -> DataFrame:
    """Each column's label rate beside it; levels without one get NULL."""
    for c in columns:
        if rates.small:
            rows = [(r["level"], r["rate"]) for r in rates.rows if r["column"] == c]
            part = SizedTable.from_rows(df.sparkSession, rows, "level string, rate double")
        else:
            part = SizedTable(rates.df.where(F.col("column") == c).drop("column"), None)
        df = part.lookup(df, {c: "level"}, {"rate": c + suffix})
    return df


def crosstab_shares(df: DataFrame, a: str, b: str, levels: list | None = None) -> DataFrame:
    """Share of each level of b within each level of a."""
    rows = df.where(as_col(a).isNotNull() & as_col(b).isNotNull())
    levels = distinct_levels(rows, b) if levels is None else levels
    shares = [(F.count(F.when(as_col(b) == F.lit(v), 1)) / F.count(F.lit(1))).alias(f"{b}_{v}") for v in levels]
    return rows.groupBy(as_col(a)).agg(*shares)


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, level, share): the shares of ``crosstab_shares`` above zero as rows, for any number of levels."""
    counts = materialise(pivot_long(df.where(as_col(a).isNotNull()), [a], b))
    totals = counts.groupBy(as_col(a)).agg(F.sum("n").alias("__total"))
    share = (F.col("n") / F.col("__total")).alias("share")
    return attach_group_values(counts, [a], totals).select(as_col(a), "level", share)


# -- whole table ----------------------------------------------------------------


def unpivot_row(row: DataFrame, columns: list[str], stats: list[str], types: dict[str, str]) -> DataFrame:
    """One row with columns ``stat__i`` -> one row per feature."""
    entries = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{s}__{i}").cast(types[s]).alias(s) for s in stats])
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*entries)))


def column_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: NULLs, levels (NULL being one), distinct values, mean, skew, variance."""
    columns = df.columns if columns is None else columns
    exprs = []
    for i, c in enumerate(columns):
        x, number = as_col(c), isinstance(df.schema[c].dataType, NUMERIC)
        d = x.cast("double") if number else F.lit(None).cast("double")
        exprs += [
            F.count(F.lit(1)).alias(f"nb_rows__{i}"),
            F.count(F.when(x.isNull(), 1)).alias(f"nb_nas__{i}"),
            F.avg(d).alias(f"mean__{i}"),
            F.var_pop(d).alias(f"variance__{i}"),
            skew_g1(d).alias(f"skew__{i}"),
        ]
        if approximate:
            exprs.append(F.approx_count_distinct(x).alias(f"nb_distinct__{i}"))
    stats = ["nb_rows", "nb_nas", "mean", "variance", "skew"] + (["nb_distinct"] if approximate else [])
    types = {"nb_rows": "bigint", "nb_nas": "bigint", "nb_distinct": "bigint"} | dict.fromkeys(["mean", "variance", "skew"], "double")
    out = unpivot_row(df.agg(*exprs), columns, stats, types)
    if not approximate:
        narrow = long_values(df, columns).distinct()
        per = narrow.groupBy("__f").agg(F.count(F.lit(1)).alias("nb_distinct"))
        feature = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__f") + 1)
        out = out.join(F.broadcast(per.select(feature.alias("feature"), "nb_distinct")), "feature", "left")
        out = out.fillna({"nb_distinct": 0})
    return out.select(
        "feature",
        "nb_rows",
        "nb_nas",
        (F.col("nb_distinct") + (F.col("nb_nas") > 0).cast("bigint")).alias("nb_levels"),
        "nb_distinct",
        F.try_divide(F.col("nb_nas"), F.col("nb_rows")).alias("null_share"),
        "mean",
        "variance",
        "skew",
    )


def feature_report(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Column profile with each numeric column's correlation to the target."""
    profile = column_profile(df, columns)
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NUMERIC)]
    row = df.agg(*[pair_corr(c, target).alias(f"target_correlation__{i}") for i, c in enumerate(numbers)])
    corr = unpivot_row(row, numbers, ["target_correlation"], {"target_correlation": "double"})
    return profile.join(F.broadcast(corr), "feature", "left")


def correlated_pairs(df: DataFrame, columns: list[str], over: float) -> DataFrame:
    """Pairs whose absolute correlation is above the threshold."""
    return correlation_pairs(df, columns).where(F.abs("correlation") > over)


def log_effect(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Correlation of each column with the target, before and after log(1+x)."""

    def side(stat, make):
        row = df.agg(*[pair_corr(make(c), target).alias(f"{stat}__{i}") for i, c in enumerate(columns)])
        return unpivot_row(row, columns, [stat], {stat: "double"})

    plain = side("correlation", as_col)
    logged = side("log_correlation", lambda c: F.log1p(as_col(c)))
    return plain.join(F.broadcast(logged), "feature", "inner")


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """(bin, low, high, n) over equal widths between minimum and maximum; empty bins included."""
    lo, hi = df.agg(F.min(as_col(column)), F.max(as_col(column))).first()
    spark = df.sparkSession
    schema = "bin int, low double, high double, n bigint"
    if lo is None:
        return spark.createDataFrame([], schema)
    width = (hi - lo) / bins if hi > lo else 1.0
    index = F.least(F.floor((as_col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(as_col(column).isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = frame.join(counts, "bin", "left")
    return out.select(
        "bin",
        (F.lit(lo) + F.col("bin") * width).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def metric_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric per group."""
    return df.groupBy(*by).agg(*[e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])


