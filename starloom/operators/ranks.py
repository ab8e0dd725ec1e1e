"""Exact medians of whole columns by parallel rank selection.

All columns are unpivoted into (gap, value) rows inside each task and counted by bins, so every pass is one scan
and shuffles at most BINS rows a gap and task; nothing is sorted, sketched or merged in one task.  The first bins are
the values' binary magnitudes, later ones cut the gap that holds a middle rank, from its least to its largest value, into
BINS equal parts.  A gap within one magnitude holds at most 2**52 doubles, so five more passes always end at one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sqltext import literal, name

BINS = 4096
# Bin of a value's magnitude: monotone, as the floor of a monotone logarithm is; zero and infinities have bins of their own.
MAGNITUDE = "CASE WHEN v = 0 THEN 0 WHEN abs(v) = double('inf') THEN sign(v) * 4000 ELSE sign(v) * (floor(log2(abs(v))) + 1100) END"


def binned(df: DataFrame, gaps: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """(g, bin, n, low, high): counts and bounds of the bins of each gap (column, least, largest); no bounds: the whole column."""
    entries = []
    for g, (c, low, high) in enumerate(gaps):
        x = f"CAST({name(c)} AS DOUBLE)"
        entries.append(f"struct({g} AS g, {x} AS v, CAST({literal(low)} AS DOUBLE) AS a, CAST({literal(high)} AS DOUBLE) AS b)")
    rows = df.selectExpr(f"inline(array({', '.join(entries)}))").where("v IS NOT NULL AND NOT isnan(v) AND (a IS NULL OR v BETWEEN a AND b)")
    # halves keep the width of a gap finite
    part = f"least(floor((v / 2 - a / 2) / (b / 2 - a / 2) * {BINS}), {BINS - 1})"
    rows = rows.selectExpr("g", f"CAST(CASE WHEN a IS NULL THEN {MAGNITUDE} ELSE {part} END AS BIGINT) AS bin", "v + 0.0D AS v")
    return rows.groupBy("g", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians; the mean of both middle values where their number is even, None without values."""
    gaps: list[tuple[str, float | None, float | None]] = [(c, None, None) for c in dict.fromkeys(columns)]
    ranks: list[list[int] | None] = [None] * len(gaps)  # within the gap; both middle ones at first
    found: dict[str, list[float]] = {c: [] for c, _, _ in gaps}
    while gaps:
        by_gap = Window.partitionBy("g")
        cum = binned(df, gaps).withColumns({"upto": F.sum("n").over(by_gap.orderBy("bin")), "total": F.sum("n").over(by_gap)})
        wanted = F.array(*[F.array(*[F.lit(r).cast("bigint") for r in rank or []]).cast("array<bigint>") for rank in ranks])
        middle = F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))
        own = F.element_at(wanted, F.col("g") + 1)
        asked = cum.withColumn("rank", F.explode(F.when(F.size(own) > 0, own).otherwise(middle)))
        hit = asked.where("rank >= upto - n AND rank < upto").select("g", "rank", (F.col("upto") - F.col("n")).alias("before"), "low", "high")
        following: dict[tuple[str, float, float], list[int]] = {}
        for r in hit.distinct().collect():  # at most two rows a column
            c = gaps[r["g"]][0]
            if r["low"] == r["high"]:
                found[c].append(r["low"])
            else:
                following.setdefault((c, r["low"], r["high"]), []).append(r["rank"] - r["before"])
        gaps, ranks = list(following), list(following.values())
    return {c: v[0] / 2 + v[-1] / 2 if v else None for c, v in found.items()}
