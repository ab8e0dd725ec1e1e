"""Correlations of all pairs of columns from masked Gramian matrices.

Each task multiplies its batches of centred values and presence masks into sums over the rows where both columns are
present: numbers of rows, sums, squares and products.  It sends one row for each column; these are added in two levels, so
that no task gets the rows of all tasks.  One scan serves all pairs, and the products are matrix multiplications
(numpy, in Arrow batches), not a struct for each pair and row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import name

# Sums kept for each pair: rows, sums of either, squares of either, products, rows with NaN or infinity.
KINDS = 7
# Messages of one column added at once.
MERGED = 256
# Variance, as a share of the mean square about the column's mean, that counts as none: what rounding leaves of equal values.
NOTHING = 1e-13


def masked_sums(df: DataFrame, columns: list[str], centres: list[float]) -> DataFrame:
    """(i, sender, sums): for column i the KINDS sums with each column, from each task."""
    p, kinds = len(columns), KINDS

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros((kinds, p, p))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - centres
            here = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
            odd = ~np.isfinite(x) * here
            x = np.where(here * (1 - odd) > 0, x, 0.0)
            sums, squares, spoilt = x.T @ here, (x * x).T @ here, odd.T @ here
            total += np.stack([here.T @ here, sums, sums.T, squares, squares.T, x.T @ x, spoilt + spoilt.T])
        rows = [total[:, i, :].tobytes() for i in range(p)]
        sender = pa.array([TaskContext.get().partitionId()] * p, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), sender, pa.array(rows, pa.binary())], ["i", "sender", "sums"])

    values = df.selectExpr(*[f"CAST({name(c)} AS DOUBLE) AS c{i}" for i, c in enumerate(columns)])
    sent = values.mapInArrow(run, "i int, sender bigint, sums binary")
    none = df.sparkSession.range(p).select(F.col("id").cast("int").alias("i"), F.lit(-1).cast("bigint").alias("sender"), F.lit(bytearray(8 * kinds * p)).alias("sums"))
    return sent.unionByName(none)


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_1, feature_2, correlation) of every pair, each over its complete rows; NULL where one is constant there."""
    columns = list(columns)
    p, kinds, nothing = len(columns), KINDS, NOTHING
    if p < 2:
        return df.sparkSession.createDataFrame([], "feature_1 string, feature_2 string, correlation double")
    means = df.agg(F.array(*[F.avg(F.expr(f"CASE WHEN abs(CAST({name(c)} AS DOUBLE)) < double('inf') THEN CAST({name(c)} AS DOUBLE) END")) for c in columns])).first()[0]
    sent = masked_sums(df, columns, [m or 0.0 for m in means])

    def add(table):
        import numpy as np
        import pyarrow as pa

        total = sum(np.frombuffer(b.as_buffer()) for b in table.column("sums"))
        return pa.table({"i": table.column("i").slice(0, 1), "sender": table.column("sender").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    def finish(table):
        import numpy as np
        import pyarrow as pa

        i = table.column("i")[0].as_py()
        n, sx, sy, qx, qy, xy, spoilt = sum(np.frombuffer(b.as_buffer()) for b in table.column("sums")).reshape(kinds, p)[:, i + 1 :]
        with np.errstate(all="ignore"):
            vx, vy = qx / n - (sx / n) ** 2, qy / n - (sy / n) ** 2
            found = (xy / n - sx / n * sy / n) / np.sqrt(vx * vy)
            known = (n > 0) & (vx > nothing * qx / n) & (vy > nothing * qy / n)
        found = np.where(spoilt > 0, np.nan, np.clip(found, -1, 1))
        names = [pa.array(x, pa.string()) for x in ([columns[i]] * len(n), columns[i + 1 :])]
        return pa.table({"feature_1": names[0], "feature_2": names[1], "correlation": pa.array(found, pa.float64(), mask=~(known | (spoilt > 0)))})

    groups = max(1, -(-df.rdd.getNumPartitions() // MERGED))
    merged = sent.groupBy("i", F.pmod("sender", F.lit(groups)).alias("g")).applyInArrow(add, sent.schema)
    return merged.groupBy("i").applyInArrow(finish, "feature_1 string, feature_2 string, correlation double")
