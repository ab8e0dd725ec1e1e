"""Calendar parts and differences of timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import as_col, epoch_micros


def calendar_parts(c: Column | str) -> dict[str, Column]:
    """Suffix -> calendar part; Monday is day 0 of the week."""
    c = as_col(c)
    return {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "day_of_week": F.weekday(c),
        "hour": F.hour(c),
        "minutes": F.minute(c),
        "seconds": F.second(c),
    }


def diff_seconds(a: Column | str, b: Column | str, total: bool = False) -> Column:
    """Absolute difference in whole seconds; by default only the part below one day."""
    seconds = F.floor(F.abs(epoch_micros(a) - epoch_micros(b)) / F.lit(1_000_000)).cast("long")
    return seconds if total else seconds % F.lit(86_400)


def day_offset(c: Column | str, origin: str) -> Column:
    """Whole days since the origin date."""
    return F.datediff(as_col(c).cast("date"), F.lit(origin).cast("date"))
