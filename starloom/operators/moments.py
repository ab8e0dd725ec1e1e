"""Moments and extremes of many columns of a whole table in one scan.

Each task takes its Arrow batches column by column (numpy) into counts, extremes, means and centred sums of squares and cubes,
and sends one row of fixed size; rows of tasks are added in two levels.  Whole numbers keep their extremes as whole numbers.
NULL, NaN and infinities are treated as Spark's aggregates treat them: NULL is left out, NaN is above all numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import WHOLE
from ..functions.sqltext import name

#: Rows of tasks added at once.
MERGED = 256
#: Sums of a column: rows, values, least, most, mean, centred squares and cubes; and its extremes as whole numbers.
KINDS, EXTREMES = 7, 2


def _functions():
    """(sums of a batch, sum of two), made in a function so that they travel to the workers as they are."""
    import numpy as np

    def extremes(x):
        if x.dtype.kind != "i":
            return float(np.fmin.reduce(x)), float(np.maximum.reduce(x)), 0, 0
        low, high = int(x.min()), int(x.max())
        return float(low), float(high), low, high

    def of_batch(batch):
        out, whole = np.zeros((KINDS, batch.num_columns)), np.zeros((EXTREMES, batch.num_columns), np.int64)
        out[0] = batch.num_rows
        for i, column in enumerate(batch.columns):
            x = (column.drop_null() if column.null_count else column).to_numpy(zero_copy_only=False)
            if not len(x):
                continue
            low, high, whole[0, i], whole[1, i] = extremes(x)
            out[1:4, i] = len(x), low, high
            if whole[0, i] == whole[1, i] and low == high and np.isfinite(low):
                out[4, i] = low  # equal values have no spread, whatever a mean of them would round to
                continue
            x = x.astype(np.float64)
            mean = x.mean()
            d = x - mean
            rest = d.mean()
            d -= rest
            square = d * d
            out[4:, i] = mean + rest, square.sum(), square @ d
        return out, whole

    def merged(a, b):
        (x, v), (y, w) = a, b
        none_x, none_y = x[1] == 0, y[1] == 0
        n = np.maximum(x[1] + y[1], 1)
        d = np.where(x[4] == y[4], 0.0, y[4] - x[4])
        d = np.where(none_x | none_y, 0.0, d)
        p, q = x[1], y[1]
        out = np.empty_like(x)
        out[0], out[1] = x[0] + y[0], x[1] + y[1]
        out[2], out[3] = np.fmin(x[2], y[2]), np.maximum(x[3], y[3])
        out[4] = x[4] + d * q / n
        out[5] = x[5] + y[5] + d * d * p * q / n
        out[6] = x[6] + y[6] + d**3 * p * q * (p - q) / n**2 + 3 * d * (p * y[5] - q * x[5]) / n
        whole = np.stack([np.minimum(v[0], w[0]), np.maximum(v[1], w[1])])
        out = np.where(none_x, y, np.where(none_y, x, out))
        out[0] = x[0] + y[0]
        return out, np.where(none_x, w, np.where(none_y, v, whole))

    return of_batch, merged


def column_moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Column -> rows, count, min, max, same (one value only), mean, variance (of the population) and skew (bias-corrected).

    Numbers only.  What SQL has no value for is None: all but the counts without values, skewness of fewer than three
    or of equal ones.
    """
    import numpy as np

    columns = list(columns)
    if not columns:
        return {}
    p = len(columns)
    kinds = {c: "BIGINT" if isinstance(df.schema[c].dataType, WHOLE) else "DOUBLE" for c in columns}
    of_batch, merged = _functions()

    def unpacked(body):
        return np.frombuffer(body, np.float64, KINDS * p).reshape(KINDS, p), np.frombuffer(body, np.int64, EXTREMES * p, 8 * KINDS * p).reshape(EXTREMES, p)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = None
        with np.errstate(all="ignore"):
            for batch in batches:
                if batch.num_rows:
                    found = of_batch(batch)
                    total = found if total is None else merged(total, found)
        if total is not None:
            sender, body = TaskContext.get().partitionId(), total[0].tobytes() + total[1].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([sender], pa.int64()), pa.array([body], pa.binary())], ["sender", "sums"])

    def add(table):
        import pyarrow as pa

        total = None
        with np.errstate(all="ignore"):
            for body in table.column("sums"):
                part = unpacked(body.as_buffer())
                total = part if total is None else merged(total, part)
        return pa.table({"sender": table.column("sender").slice(0, 1), "sums": pa.array([total[0].tobytes() + total[1].tobytes()], pa.binary())})

    values = df.selectExpr(*[f"CAST({name(c)} AS {kinds[c]}) AS c{i}" for i, c in enumerate(columns)])
    sent = values.mapInArrow(run, "sender bigint, sums binary")
    groups = max(1, -(-values.rdd.getNumPartitions() // MERGED))
    rows = sent.groupBy(F.pmod("sender", F.lit(groups)).alias("g")).applyInArrow(add, sent.schema).collect()
    total = None
    with np.errstate(all="ignore"):
        for r in rows:
            part = unpacked(bytes(r["sums"]))
            total = part if total is None else merged(total, part)
    sums, whole = total if total is not None else (np.zeros((KINDS, p)), np.zeros((EXTREMES, p), np.int64))
    return {c: _finished(sums[:, i], whole[:, i], kinds[c] == "BIGINT") for i, c in enumerate(columns)}


def _finished(sums, whole, is_whole: bool) -> dict:
    rows, n, low, high, mean, squares, cubes = (float(x) for x in sums)
    out = {"rows": int(rows), "count": int(n)} | dict.fromkeys(("min", "max", "same", "mean", "variance", "skew"))
    if not n:
        return out
    low, high = (int(whole[0]), int(whole[1])) if is_whole else (low, high)
    both_nan = low != low and high != high
    out |= {"min": low, "max": high, "same": low == high or both_nan, "mean": mean, "variance": squares / n}
    if n > 2 and squares != 0:
        out["skew"] = n**0.5 * cubes / squares**1.5 * (n * (n - 1)) ** 0.5 / (n - 2)
    return out


def null_counts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """(rows, NULLs of each column), of columns of any type; a value travels as one bit."""
    import numpy as np

    columns = list(columns)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(1 + len(columns), np.int64)
        for batch in batches:
            total += [batch.num_rows, *(c.true_count for c in batch.columns[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["f", "n"])

    flags = df.selectExpr("true AS c", *[f"{name(c)} IS NULL AS c{i}" for i, c in enumerate(columns)])
    found = {r["f"]: r["n"] for r in flags.mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    return found.get(0, 0), {c: found.get(i + 1, 0) for i, c in enumerate(columns)}


def levels_up_to(df: DataFrame, columns: list[str], most: int) -> dict[str, int]:
    """Number of distinct values of each column of numbers, or ``most`` where there are at least that many.

    A task sends at most ``most`` values of a column: if it has so many, that settles the column.  NaN is one value,
    and so are both zeros.
    """
    import numpy as np

    columns = list(columns)
    if not columns:
        return {}
    kinds = ["BIGINT" if isinstance(df.schema[c].dataType, WHOLE) else "DOUBLE" for c in columns]

    def run(batches):
        import pyarrow as pa

        kept = [None] * len(columns)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                if kept[i] is None or len(kept[i]) < most:
                    x = (column.drop_null() if column.null_count else column).to_numpy(zero_copy_only=False)
                    found = np.unique(x if kept[i] is None else np.concatenate([kept[i], x]))
                    kept[i] = found[:most]
        for i, x in enumerate(kept):
            if x is not None and len(x):
                whole = kinds[i] == "BIGINT"
                fields = [pa.array(x if whole else [None] * len(x), pa.int64()), pa.array([None] * len(x) if whole else x, pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(x), pa.int32()), *fields], ["f", "l", "d"])

    values = df.selectExpr(*[f"CAST({name(c)} AS {k}) AS c{i}" for i, (c, k) in enumerate(zip(columns, kinds, strict=True))])
    found = values.mapInArrow(run, "f int, l bigint, d double").distinct().groupBy("f").count().collect()
    counts = {r["f"]: min(most, r["count"]) for r in found}
    return {c: counts.get(i, 0) for i, c in enumerate(columns)}
