"""Statistics of many columns per key from rows that lie sorted by it.

Each task reads its sorted rows in Arrow batches, cuts them where the key changes and takes every statistic of a column for
all groups of some batches at once (numpy).  Rows of a group still open are carried to the next batches, so the
groups must be small; batches need not end with a group.  Distinct values are counted exactly, by sorting (group, value) pairs;
NaN is one value, as are both zeros.  NULL, NaN and overflow are treated as Spark's aggregates treat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import as_col

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = INTEGERS + (T.FloatType, T.DoubleType)
#: Values (rows x columns) worked on at once.
BLOCK_VALUES = 4_000_000


def _sum_type(data_type: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(data_type, INTEGERS) else T.DoubleType()


#: Statistics and their types.
KINDS = {
    "mean": lambda t: T.DoubleType(),
    "std": lambda t: T.DoubleType(),
    "min": lambda t: t,
    "max": lambda t: t,
    "sum": _sum_type,
    "count": lambda t: T.LongType(),
    "nunique": lambda t: T.LongType(),
}


def can_run(df: DataFrame, keys: list[str], wanted: list[tuple[str, str]]) -> bool:
    """Whether all keys are whole numbers, and all columns numbers or texts of which values are only counted or the last is sought."""
    text = ("count", "nunique", "max", "min")
    return all(isinstance(df.schema[k].dataType, INTEGERS) for k in keys) and all(
        isinstance(df.schema[c].dataType, NUMBERS) or (isinstance(df.schema[c].dataType, T.StringType) and kind in text) for c, kind in wanted
    )


def column_class():
    """The class of a column's statistics, made in a function so that it travels to the workers as it is."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    class Column:
        """One column of a block of whole groups: ``starts`` are their first rows, ``group`` the number of each row's."""

        def __init__(self, array, starts, group):
            self.starts, self.group, self.words = starts, group, None
            if pa.types.is_string(array.type) or pa.types.is_large_string(array.type):
                coded = array.dictionary_encode()
                words = coded.dictionary.cast(pa.binary() if pa.types.is_string(array.type) else pa.large_binary()).to_pylist()
                order = sorted(range(len(words)), key=words.__getitem__)  # byte order, as in Spark
                self.words = coded.dictionary.take(pa.array(order, pa.int64()))
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                array = pc.take(pa.array(rank), coded.indices)
            self.here = None if array.null_count == 0 else array.is_valid().to_numpy(zero_copy_only=False)
            self.values = (array if self.here is None else array.fill_null(0)).to_numpy(zero_copy_only=False)
            self.whole = self.values.dtype.kind == "i"
            self.wide = self.values.dtype.itemsize > 4
            rows = np.diff(np.append(starts, len(self.values)))
            self.count = rows if self.here is None else np.add.reduceat(self.here.astype(np.int64), starts)
            self._kept = {}

        def _filled(self, other):
            return self.values if self.here is None else np.where(self.here, self.values, self.values.dtype.type(other))

        def get(self, kind: str):
            """(value of each group, where it is NULL)."""
            if kind not in self._kept:
                self._kept[kind] = getattr(self, f"_{kind}")()
            return self._kept[kind]

        def _count(self):
            return self.count, None

        def _doubles(self):
            return np.add.reduceat(self._filled(0).astype(np.float64), self.starts)

        def _sum(self):
            if not self.whole:
                return self._doubles(), None
            out = np.add.reduceat(self._filled(0).astype(np.int64), self.starts)
            if self.wide and (np.add.reduceat(np.abs(self._filled(0).astype(np.float64)), self.starts) > 2.0**62).any():
                ends = [*self.starts[1:].tolist(), len(self.values)]
                for i, j, v in zip(self.starts.tolist(), ends, out.tolist(), strict=True):
                    if sum(self._filled(0)[i:j].tolist()) != v:
                        raise OverflowError("a sum of whole numbers passes 64 bits")
            return out, None

        def _mean(self):
            return self._doubles() / np.maximum(self.count, 1), self.count == 0

        def _std(self):
            mean, _ = self.get("mean")
            apart = self._filled(0).astype(np.float64) - mean[self.group]
            apart = apart if self.here is None else np.where(self.here, apart, 0.0)
            out = np.sqrt(np.add.reduceat(apart * apart, self.starts) / np.maximum(self.count - 1, 1))
            same = (self.get("min")[0] == self.get("max")[0]) & np.isfinite(self.get("max")[0])
            return np.where(same, 0.0, out), self.count <= 1

        def _min(self):
            if self.whole:
                return np.minimum.reduceat(self._filled(np.iinfo(self.values.dtype).max), self.starts), self.count == 0
            return np.fmin.reduceat(self._filled(np.nan), self.starts), self.count == 0

        def _max(self):
            low = np.iinfo(self.values.dtype).min if self.whole else -np.inf
            return np.maximum.reduceat(self._filled(low), self.starts), self.count == 0

        def _nunique(self):
            values, group = self.values, self.group
            if self.here is not None:
                values, group = values[self.here], group[self.here]
            n = len(self.starts)
            if not len(values):
                return np.zeros(n, np.int64), None
            if self.whole and int(values.max()) - int(values.min()) <= 1:
                return np.where(self.count > 0, 1 + (self.get("min")[0] != self.get("max")[0]).astype(np.int64), 0), None
            if self.whole and (int(values.max()) - int(values.min()) + 1) * n < 1 << 62:
                span = int(values.max()) - int(values.min()) + 1
                codes = values.astype(np.int64) - int(values.min())
            else:
                order = np.argsort(values)
                lying = values[order]
                new = lying[1:] != lying[:-1]
                if not self.whole:
                    new &= ~(np.isnan(lying[1:]) & np.isnan(lying[:-1]))
                codes = np.empty(len(values), np.int64)
                codes[order] = np.cumsum(np.concatenate([[0], new.astype(np.int64)]))
                span = int(codes[order[-1]]) + 1
            pairs = np.sort(group * span + codes)
            first = np.concatenate([[True], pairs[1:] != pairs[:-1]])
            return np.bincount(pairs[first] // span, minlength=n), None

    return Column


def run_statistics(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per key with ``wanted``: output name -> (column, kind of KINDS).

    Rows of a key must lie in one partition; they are sorted there unless they already are.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    source = rows.sortWithinPartitions(*map(as_col, keys)).select(
        *[as_col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[as_col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    at = {c: len(keys) + i for i, c in enumerate(columns)}
    tasks = [(at[c], kind) for c, kind in wanted.values()]
    types = [KINDS[kind](rows.schema[c].dataType) for c, kind in wanted.values()]
    schema = T.StructType([T.StructField(f"k{i}", rows.schema[k].dataType) for i, k in enumerate(keys)])
    for i, t in enumerate(types):
        schema.add(f"v{i}", t)
    Column = column_class()
    n_keys, most = len(keys), max(1, BLOCK_VALUES // max(1, len(columns)))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def finished(table, starts):
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            made = {}
            out = [table.column(i).take(pa.array(starts)).combine_chunks() for i in range(n_keys)]
            with np.errstate(all="ignore"):
                for i, kind in tasks:
                    if i not in made:
                        made[i] = Column(table.column(i).combine_chunks(), starts, group)
                    value, null = made[i].get(kind)
                    words = made[i].words if kind in ("min", "max") else None
                    if words is not None:
                        out.append(words.take(pa.array(np.where(null, 0, value), mask=null)))
                    else:
                        out.append(pa.array(value, mask=null))
            return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, target, strict=True)], schema=target)

        def edges(table):
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for i in range(n_keys):
                key = table.column(i).to_numpy()
                new[1:] |= key[1:] != key[:-1]
            return np.flatnonzero(new)

        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= most:
                table = pa.Table.from_batches(waiting)
                starts = edges(table)
                if len(starts) > 1:
                    yield finished(table.slice(0, starts[-1]), starts[:-1])
                # the open group is copied, so that it does not keep the block
                rest = table.slice(starts[-1]).take(pa.array(range(table.num_rows - starts[-1]), pa.int64()))
                waiting = rest.to_batches()
                size = rest.num_rows
        if size:
            table = pa.Table.from_batches(waiting)
            yield finished(table, edges(table))

    return source.mapInArrow(run, schema).toDF(*keys, *wanted)


def folded(df: DataFrame, folds: dict) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """Rows with the folds' expressions as columns, and what is wanted of them."""
    names = {n: f"__fold{i}" for i, n in enumerate(folds)}
    return df.withColumns({names[n]: e for n, (_, e) in folds.items()}), {n: (names[n], kind) for n, (kind, _) in folds.items()}


#: The same as Spark's aggregates, for groups of any size.
NATIVE = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
}
