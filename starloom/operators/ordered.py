"""Ordered groups: positions, gaps, running sums and trends per key.

A key that fits one task goes through an ordinary window.  A hot key is cut along its
order into chunks of bounded size: the window then runs per (key, chunk), and a small
table with one row per chunk carries counts, sums and last values from chunk to chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import as_col
from .tables import ROWS_PER_TASK, HotKeys, SizedTable, materialise

SAMPLES_PER_CHUNK = 50
# Cuts are searched in two steps: first among the blocks, then inside one block.
CUTS_PER_BLOCK = 64
# Chunks of one key at most; those of a still larger key hold more rows each, which are sorted with spilling.
MOST_CHUNKS = 65_536


class OrderedGroups:
    """Rows of a table grouped by ``keys`` and ordered by ``order``.

    ``order`` lists column names, a leading minus meaning descending; NULLs come last.  The
    order should end with columns that make it total, or ties fall arbitrarily.  ``hot``
    may give the hot keys when they are known already, for instance from a base table.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        rows_per_task: int | None = None,
        hot: HotKeys | None = None,
    ):
        if not keys:
            df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
        self.df, self.keys = df, list(keys)
        self.order = [(o.lstrip("-"), o.startswith("-")) for o in order]
        self.hot = HotKeys.of(df, self.keys, rows_per_task=rows_per_task) if hot is None else hot
        # every operator reads the chunks twice: they are written once
        self.rows = materialise(self._cut_into_chunks()) if self.hot else df

    # -- windows -----------------------------------------------------------------

    def _sorted_by(self) -> list[Column]:
        return [as_col(c).desc_nulls_last() if down else as_col(c).asc_nulls_last() for c, down in self.order]

    @property
    def _group(self) -> list[Column]:
        return [as_col(k) for k in self.keys] + ([F.col("__chunk")] if self.hot else [])

    @property
    def window(self):
        return W.partitionBy(*self._group).orderBy(*self._sorted_by())

    # -- chunks of hot keys ------------------------------------------------------

    def _cuts(self) -> DataFrame:
        """Cut rows of every hot key, sampled along its order: (keys, __blocks)."""
        names = [c for c, _ in self.order]
        keys = [as_col(k) for k in self.keys]
        chunks = F.least(F.greatest(F.lit(2), F.ceil(F.col("__rows") * 2 / F.lit(self.hot.limit))), F.lit(MOST_CHUNKS)).cast("int")
        plan = self.hot.table.select(*keys, chunks.alias("__n"), F.least(F.lit(1.0), F.lit(SAMPLES_PER_CHUNK) * chunks / F.col("__rows")).alias("__share"))
        sample = self.hot.join(self.df, plan).where(F.col("__n").isNotNull() & (F.rand(17) < F.col("__share")))
        group = W.partitionBy(*keys)
        rank = F.row_number().over(group.orderBy(*self._sorted_by())) - 1
        tile = F.floor(rank * F.col("__n") / F.count(F.lit(1)).over(group)).cast("int")
        in_tile = W.partitionBy(*keys, F.col("__tile")).orderBy(*self._sorted_by())
        cuts = (
            sample.withColumn("__tile", tile)
            .withColumn("__at", F.row_number().over(in_tile))
            .where("__at = 1 and __tile > 0")
            .groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("__tile"), *map(as_col, names)))).alias("__cuts"))
        )
        starts = F.sequence(F.lit(1), F.size("__cuts"), F.lit(CUTS_PER_BLOCK))
        blocks = F.transform(starts, lambda i: F.slice("__cuts", i, F.lit(CUTS_PER_BLOCK)))
        # The sample is random, so its cuts are written here, once, for every later use.
        return materialise(cuts.select(*keys, blocks.alias("__blocks")))

    def _not_before(self, cut: Column) -> Column:
        """Is the row at or after the cut in the order?"""
        same, out = F.lit(True), F.lit(False)
        for c, down in self.order:
            mine, other = as_col(c), cut.getField(c)
            after = F.coalesce(mine < other if down else mine > other, F.lit(False)) | (mine.isNull() & other.isNotNull())
            out = out | (same & after)
            same = same & mine.eqNullSafe(other)
        return out | same

    def _cut_into_chunks(self) -> DataFrame:
        marked = self.hot.join(self.df, self._cuts())
        block = F.size(F.filter(F.col("__blocks"), lambda b: self._not_before(b[0])))
        inside = F.size(F.filter(F.get(F.col("__blocks"), F.col("__block") - 1), self._not_before))
        chunk = F.when(F.col("__block") > 0, (F.col("__block") - 1) * CUTS_PER_BLOCK + inside).otherwise(F.lit(0))
        marked = marked.withColumn("__block", F.when(F.col("__blocks").isNull(), F.lit(0)).otherwise(block))
        # a hot key without cuts is one chunk, and nothing is carried into it
        return marked.withColumns({"__chunk": chunk, "__hot": F.col("__blocks").isNotNull()}).drop("__blocks", "__block")

    def _carry(self, aggregates: list[Column], carried: list[Column]) -> DataFrame:
        """One row per chunk of the hot keys with values brought over from earlier chunks."""
        per_chunk = self.rows.where("__hot").groupBy(*self._group).agg(*aggregates)
        before = W.partitionBy(*map(as_col, self.keys)).orderBy("__chunk")
        return per_chunk.select(*self._group, *[c(before) for c in carried])

    def _with_carry(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        """Chunks are of bounded size, so they may meet their carried row by a shuffle."""
        names = self.keys + ["__chunk"]
        renamed = carry.withColumnsRenamed({k: f"__key_{k}" for k in names})
        on = [as_col(k).eqNullSafe(as_col(f"__key_{k}")) for k in names]
        return df.join(renamed, on, "left").drop(*[f"__key_{k}" for k in names])

    # -- operators ---------------------------------------------------------------

    def running_sum(self, sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
        """Running totals along the order; ``sums`` maps output name -> summed expression."""
        frame = self.window.rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
        local = {n: F.coalesce(F.sum(e).over(frame), F.lit(0)) for n, e in sums.items()}
        out = self.rows.withColumns(local)
        if not self.hot:
            return out.drop("__all")

        def earlier(name):
            return lambda w: F.coalesce(F.sum(f"__sum_{name}").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"__before_{name}")

        carry = self._carry([F.sum(e).alias(f"__sum_{n}") for n, e in sums.items()], [earlier(n) for n in sums])
        out = self._with_carry(out, carry)
        total = {n: as_col(n) + F.coalesce(as_col(f"__before_{n}"), F.lit(0)) for n in sums}
        return out.withColumns(total).drop("__all", "__chunk", "__hot", *[f"__before_{n}" for n in sums])

    def position(self, name: str = "position") -> DataFrame:
        """0-based position of each row in its group."""
        out = self.rows.withColumn(name, (F.row_number().over(self.window) - 1).cast("long"))
        if not self.hot:
            return out.drop("__all")
        carry = self._carry(
            [F.count(F.lit(1)).alias("__n")],
            [lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before")],
        )
        out = self._with_carry(out, carry)
        return out.withColumn(name, as_col(name) + F.coalesce(F.col("__before"), F.lit(0))).drop("__all", "__chunk", "__hot", "__before")

    def previous(self, columns: dict[str, str]) -> DataFrame:
        """The previous row's values; ``columns`` maps output name -> source column."""
        local = {n: F.lag(as_col(c), 1).over(self.window) for n, c in columns.items()}
        if not self.hot:
            return self.rows.withColumns(local).drop("__all")
        out = self.rows.withColumns({**local, "__at": F.row_number().over(self.window)})
        last = self.rows.where("__hot")
        down = W.partitionBy(*self._group).orderBy(*[as_col(c).asc_nulls_first() if d else as_col(c).desc_nulls_first() for c, d in self.order])
        last = last.withColumn("__rn", F.row_number().over(down)).where("__rn = 1")
        before = W.partitionBy(*map(as_col, self.keys)).orderBy("__chunk")
        carry = last.select(*self._group, *[F.lag(as_col(c), 1).over(before).alias(f"__last_{n}") for n, c in columns.items()])
        out = self._with_carry(out, carry)
        first = F.col("__at") == 1
        fixed = {n: F.when(first, as_col(f"__last_{n}")).otherwise(as_col(n)) for n in columns}
        return out.withColumns(fixed).drop("__all", "__chunk", "__hot", "__at", *[f"__last_{n}" for n in columns])

    def gaps(self, columns: dict[str, str], sign: int = 1, truncate: bool = True) -> DataFrame:
        """Difference to the previous row, 0 where there is none, cut to whole numbers."""
        out = self.previous({f"__prev_{n}": c for n, c in columns.items()})

        def gap(n, c):
            diff = (as_col(c) - as_col(f"__prev_{n}")) * F.lit(sign)
            diff = F.coalesce(diff, F.lit(0))
            return diff.cast("long") if truncate else diff

        return out.withColumns({n: gap(n, c) for n, c in columns.items()}).drop(*[f"__prev_{n}" for n in columns])

    def trend(self, columns: dict[str, str]) -> DataFrame:
        """Least-squares slope over positions 0..n-1 per key, one row per key.

        A NULL anywhere makes the slope NULL; a single row has slope 0.  Each chunk gives
        its sums, and a chunk's positions are shifted by the rows before it.
        """
        local = self.rows.withColumn("__x", (F.row_number().over(self.window) - 1).cast("double"))
        sums = [F.count(F.lit(1)).cast("double").alias("__n")]
        for n, c in columns.items():
            y = as_col(c).cast("double")
            sums += [F.count(y).alias(f"__c_{n}"), F.sum(y).alias(f"__y_{n}"), F.sum(y * F.col("__x")).alias(f"__xy_{n}")]
        parts = local.groupBy(*self._group).agg(*sums)
        if self.hot:
            before = W.partitionBy(*map(as_col, self.keys)).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
            parts = parts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0.0)))
            shifted = [F.sum("__n").alias("__n")]
            for n in columns:
                shifted += [
                    F.sum(f"__c_{n}").alias(f"__c_{n}"),
                    F.sum(f"__y_{n}").alias(f"__y_{n}"),
                    F.sum(as_col(f"__xy_{n}") + F.col("__off") * as_col(f"__y_{n}")).alias(f"__xy_{n}"),
                ]
            parts = parts.groupBy(*map(as_col, self.keys)).agg(*shifted)
        n_rows = F.col("__n")
        mean_x = (n_rows - 1) / 2
        spread = n_rows * (n_rows * n_rows - 1) / 12

        def slope(n):
            value = F.try_divide(as_col(f"__xy_{n}") - mean_x * as_col(f"__y_{n}"), spread)
            return F.when(as_col(f"__c_{n}") < n_rows, F.lit(None)).when(n_rows == 1, F.lit(0.0)).otherwise(value)

        return parts.select(*[as_col(k) for k in self.keys if k != "__all"], *[slope(n).alias(n) for n in columns])


def slope_over(position: Column | str, y: Column | str) -> Column:
    """The slope of ``OrderedGroups.trend`` as an aggregate, from positions already on the rows."""
    x, y = as_col(position).cast("double"), as_col(y).cast("double")
    n = F.count(F.lit(1)).cast("double")
    value = F.try_divide(F.sum(x * y) - (n - 1) / 2 * F.sum(y), n * (n * n - 1) / 12)
    return F.when(F.count(y) < n, F.lit(None)).when(n == 1, F.lit(0.0)).otherwise(value)


def slope_folds(position: str, y: str, name: str) -> tuple[dict[str, tuple[str, Column]], Column]:
    """(folds of ``bulk_stats``, what ``slope_over`` makes of them); the folds' names begin with __."""
    x, y = as_col(position).cast("double"), as_col(y).cast("double")
    folds = {f"__n_{name}": ("count", F.lit(1)), f"__c_{name}": ("count", y), f"__y_{name}": ("sum", y), f"__xy_{name}": ("sum", x * y)}
    n, c, sy, sxy = (as_col(f) for f in folds)
    n = n.cast("double")
    value = F.try_divide(sxy - (n - 1) / 2 * sy, n * (n * n - 1) / 12)
    return folds, F.when(c < n, F.lit(None)).when(n == 1, F.lit(0.0)).otherwise(value)


def colocated(df: DataFrame, key: str, hot: HotKeys) -> DataFrame:
    """Rows brought together by key once, for all windows and aggregates that follow.

    With a hot key the rows stay where they are, and each operator splits the key itself.
    """
    return df if hot else df.repartition(as_col(key))


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int, rank: str = "__rank") -> DataFrame:
    """The first n rows of each key in the given order, ranked from 1.

    The rank filter is applied inside every map task before the shuffle, so a hot key
    sends at most n rows per task.
    """
    by = [as_col(o[1:]).desc_nulls_last() if o.startswith("-") else as_col(o).asc_nulls_last() for o in order]
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*map(as_col, keys)).orderBy(*by)))
    return ranked.where(as_col(rank) <= n)


def last_n_counts(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sizes: list[int],
    conditions: dict[str, Column],
    last: dict[str, Column] | None = None,
) -> DataFrame:
    """Condition counts over the last rows of each key, all sizes in one pass.

    ``conditions`` maps a name pattern holding ``{n}`` to a condition, ``last`` maps a
    name to a condition tested on the very last row alone.
    """
    top = last_rows(df, keys, order, max(sizes + [1]))
    rank = F.col("__rank")
    aggregates = [F.max(F.when(rank == 1, F.coalesce(c, F.lit(False)).cast("int"))).alias(name) for name, c in (last or {}).items()]
    for n in sizes:
        for pattern, c in conditions.items():
            aggregates.append(F.count(F.when((rank <= n) & c, 1)).alias(pattern.format(n=n)))
    return top.groupBy(*map(as_col, keys)).agg(*aggregates)


def cumulative_levels(df: DataFrame, column: str, rows_per_task: int | None = None) -> DataFrame:
    """Levels of a column, most frequent first, with running and total row counts."""
    counts = df.where(as_col(column).isNotNull()).groupBy(as_col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    run = OrderedGroups(counts, [], ["-n", "level"], rows_per_task).running_sum({"running": F.col("n")})
    total = df.agg(F.count(as_col(column))).first()[0]
    return run.withColumn("total", F.lit(total).cast("long"))


def hash_ordered_position(df: DataFrame, groups: list[str], hash_col: str, name: str) -> DataFrame:
    """0-based position within each group in the order of an md5 column.

    md5 prefixes cut every group into even chunks, 4096 or as many more as keep a chunk
    below ROWS_PER_TASK rows, so no task holds a whole group however few groups there are.
    """
    rows, digits = df.count(), 3
    while rows // 16**digits > ROWS_PER_TASK:
        digits += 1
    cut = df.withColumn("__chunk", F.conv(F.substring(as_col(hash_col), 1, digits), 16, 10).cast("long"))
    keys = list(groups) + ["__chunk"]
    w = W.partitionBy(*map(as_col, keys)).orderBy(as_col(hash_col))
    local = cut.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    counts = cut.groupBy(*map(as_col, keys)).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*map(as_col, groups)).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[as_col(k).alias(f"__key_{k}") for k in keys], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One row per group and chunk: a few thousand rows per class, size-checked all the same.
    table = SizedTable.of(offsets)
    names = [f"__key_{k}" for k in keys]
    out = table.lookup(local, dict(zip(keys, names)), {"__before": "__before"})
    return out.withColumn(name, as_col(name) + F.coalesce(F.col("__before"), F.lit(0))).drop("__chunk", "__before")
