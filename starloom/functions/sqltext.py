"""Expressions as SQL text, for stages that build hundreds of them at once.

One text costs one call to the JVM however long it is; the same expression built from
column functions costs one call per function.
"""

from __future__ import annotations


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def literal(value) -> str:
    """SQL literal of a Python value of the same type."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D" if abs(value) != float("inf") and value == value else f"double('{value}')"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def named(expressions: dict[str, str]) -> list[str]:
    """``expression AS name`` for each entry."""
    return [f"{e} AS {name(n)}" for n, e in expressions.items()]


def flag(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INT)"


def finite(x: str) -> str:
    return f"CASE WHEN NOT (isnan({x}) OR abs({x}) = double('inf')) THEN {x} END"


def skew_g1(x: str) -> str:
    n = f"CAST(count({x}) AS DOUBLE)"
    return f"CASE WHEN count({x}) > 2 THEN skewness({x}) * try_divide(sqrt({n} * ({n} - 1)), {n} - 2) END"


def signed_log(x: str) -> str:
    return f"signum(CAST({x} AS DOUBLE)) * log1p(abs({x}))"


def lookup(key: str, pairs: list[tuple]) -> str:
    """Value of a key in a small fixed map; NULL when absent."""
    entries = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in pairs)
    return f"try_element_at(map({entries}), {key})" if entries else "NULL"
