"""Registration of queries and the shared pieces of their SQL.

Doubles are compared after rounding to four decimals; a small shift first keeps exact
halves from falling either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sqltext import name
from ..session import tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHIFT = 1e-7


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Every double column rounded."""
    out = []
    for f in df.schema.fields:
        c, r = name(f.name), f"round({name(f.name)} + {SHIFT}D, 4)"
        out.append(f"CASE WHEN {r} = 0 THEN 0.0D ELSE {r} END AS {c}" if isinstance(f.dataType, T.DoubleType) else c)
    return df.selectExpr(*out)


def tidy_sql(sql: str, doubles) -> str:
    """The same rounding around a SQL text, for the named columns."""
    names = doubles.split() if isinstance(doubles, str) else list(doubles)
    if not names:
        return sql
    swaps = ", ".join(
        f'case when round("{c}"::double + {SHIFT}, 4) = 0 then 0.0::double else round("{c}"::double + {SHIFT}, 4) end as "{c}"' for c in names
    )
    return f"select * replace ({swaps}) from ({sql}) as q"


def query(key: str, sql: str | None = None, doubles=()):
    """Register a query; ``doubles`` names the SQL columns to round."""

    def register(f):
        QUERIES[key] = lambda spark, folder: tidy(f(tuned(spark), folder))
        if sql is not None:
            ORACLES[key] = tidy_sql(sql, doubles)
        return f

    return register


def sql_six(columns: dict[str, str]) -> tuple[str, list[str]]:
    """Six statistics per column in SQL; kinds: d double, i int, l bigint.  (select list, doubles)"""
    out, doubles = [], []
    for c, kind in columns.items():
        q = f'"{c}"'
        zero_sum = f"coalesce(sum({q}), 0)::{'double' if kind == 'd' else 'bigint'}"
        parts = {
            "mean": f"avg({q})::double",
            "std": f"stddev_samp({q})",
            "min": f"min({q})",
            "max": f"max({q})",
            "sum": zero_sum,
            "nunique": f"count(distinct {q})",
        }
        out += [f'{e} as "{c}_{s}"' for s, e in parts.items()]
        doubles += [f"{c}_{s}" for s in (("mean", "std", "min", "max", "sum") if kind == "d" else ("mean", "std"))]
    return ", ".join(out), doubles


def lines_with_customer(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, folder, "lineitem").join(orders, "l_orderkey")


def labelled_documents(spark: SparkSession, folder: str, how: str = "left") -> DataFrame:
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", how)
