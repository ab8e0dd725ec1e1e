"""Materialising, size checks and joins that survive a hot key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import as_col
from ..functions.sqltext import lookup, name

# Largest table, in rows, that is broadcast or kept on the driver.
BROADCAST_ROWS = 100_000
# ... and the most bytes its texts may hold.
BROADCAST_BYTES = 16 << 20
# Largest table that becomes a map inside the expression, without a join.
MAP_ROWS = 64
# A key with more rows than this is split over tasks.
ROWS_PER_TASK = 4_000_000
# Hot keys, the largest ones, whose values are broadcast; further ones are joined by salted keys.
TOP_KEYS = 10_000
SPREAD = 1_024
# Columns from which on a joined table travels as one struct.
PACKED_COLUMNS = 32


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="starloom-")


class OwnedTables:
    """The tables written while a job runs; they go when it ends, but for those kept."""

    def __init__(self, outer: OwnedTables | None):
        self.outer, self.paths = outer, []

    def keep(self, *tables: DataFrame) -> None:
        """Hand tables over to the job around this one, or to the caller where there is none."""
        for df in tables:
            path = getattr(df, "_written", None)
            if path in self.paths:
                self.paths.remove(path)
                if self.outer is not None:
                    self.outer.paths.append(path)


_OWNER: ContextVar[OwnedTables | None] = ContextVar("owner", default=None)


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[OwnedTables]:
    """Every ``materialise`` inside belongs to this job, and is deleted at its end, also after an error.

    Nothing goes before the end, so tasks repeated after the loss of an executor find what they read.  Whatever is
    returned must not read a table that was not kept.  Threads take part if they run in a copy of the context.
    """
    owner = OwnedTables(_OWNER.get())
    token = _OWNER.set(owner)
    try:
        yield owner
    finally:
        _OWNER.reset(token)
        for path in owner.paths:
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read any more."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path is not None:
            delete_folder(df.sparkSession, path)


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows once, as Parquet in the shared folder, and go on from there.

    The table belongs to the job it is written in (``owned_tables``), or to the caller.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))  # one folder for the session
    path = f"{checkpoint_folder(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    # column names of Parquet may not clash or hold some signs that names of features do
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    owner = _OWNER.get()
    if owner is not None:
        owner.paths.append(path)
    plain.write.parquet(path)
    out = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    out._written = path
    return out


def rows_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, *, most_bytes: int = BROADCAST_BYTES) -> list | None:
    """The rows when there are at most ``limit`` of them and their texts hold at most ``most_bytes``, else None."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if texts:
        size = sum((F.coalesce(F.octet_length(as_col(c)), F.lit(0)) for c in texts), F.lit(0))
        rows, found = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        if rows > limit or found > most_bytes:
            return None
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


class SizedTable:
    """A lookup table whose size was checked.

    Up to BROADCAST_ROWS rows it lives on the driver and is broadcast; beyond that it is a
    table in the shared folder and lookups shuffle.
    """

    def __init__(self, df: DataFrame, rows: list | None):
        self.df = df
        self.small = rows is not None
        self.rows = rows

    @classmethod
    def of(cls, df: DataFrame, limit: int = BROADCAST_ROWS) -> SizedTable:
        rows = rows_if_small(df, limit)
        if rows is None:
            return cls(materialise(df), None)
        return cls.from_rows(df.sparkSession, rows, df.schema)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: list, schema) -> SizedTable:
        df = spark.createDataFrame([tuple(r) for r in rows], schema)
        make = Row(*df.columns)
        return cls(df, [make(*r) for r in rows])

    def lookup(self, df: DataFrame, keys: dict[str, str], values: dict[str, str]) -> DataFrame:
        """Left join: ``keys`` maps df column -> table column, ``values`` table column -> new name.

        Table keys are unique.
        """
        if self.small and len(keys) == 1 and len(self.rows) <= MAP_ROWS:
            (c, k), = keys.items()
            if isinstance(self.df.schema[k].dataType, T.StringType):
                types = {v: self.df.schema[t].dataType.simpleString() for t, v in values.items()}
                maps = {v: lookup(name(c), [(r[k], r[t]) for r in self.rows if r[k] is not None]) for t, v in values.items()}
                return df.withColumns({v: F.expr(f"CAST({e} AS {types[v]})") for v, e in maps.items()})
        right = self.df.select(
            *[F.col(t).alias(f"__k{i}") for i, t in enumerate(keys.values())],
            *[as_col(t).alias(v) for t, v in values.items()],
        )
        on = [as_col(c) == F.col(f"__k{i}") for i, c in enumerate(keys)]
        if self.small:
            return df.join(F.broadcast(right), on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
        hot = HotKeys.of(df, list(keys))
        return spread_join(df, right.withColumnsRenamed({f"__k{i}": c for i, c in enumerate(keys)}), list(keys), list(values.values()), hot)


class HotKeys:
    """Keys with more rows than one task should hold, as a written table (keys, __rows), and the largest group.

    The limit does not depend on the input.  Only the number of hot keys and the largest size come to the driver.
    """

    def __init__(self, keys: list[str], table: DataFrame | None, count: int, limit: int, largest: int):
        self.keys, self.table, self.count, self.limit, self.largest = keys, table, count, limit, largest

    def __bool__(self) -> bool:
        return self.count > 0

    @classmethod
    def find(cls, sized: DataFrame, keys: list[str], size: str, rows_per_task: int | None = None) -> HotKeys:
        """``sized`` has one row per key with its row count in column ``size``."""
        limit = rows_per_task or ROWS_PER_TASK
        largest, count = sized.agg(F.coalesce(F.max(size), F.lit(0)), F.count_if(F.col(size) > limit)).first()
        hot = sized.where(F.col(size) > limit).select(*map(as_col, keys), F.col(size).alias("__rows"))
        return cls(keys, materialise(hot) if count else None, count, limit, largest)

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], within: HotKeys | None = None, rows_per_task: int | None = None) -> HotKeys:
        """Hot keys of a table; none can be hot when none of the coarser keys ``within`` is."""
        if within is not None and not within:
            return cls(keys, None, 0, within.limit, within.largest)
        return cls.find(group_sizes(df, keys), keys, "__rows", rows_per_task)

    def join(self, df: DataFrame, values: DataFrame) -> DataFrame:
        """Left join (null keys are equal) of a table with one row for each hot key, or some of them.

        The values of the TOP_KEYS largest keys are broadcast.  Any other hot key has at most 1/TOP_KEYS of the rows; its
        rows are dealt out by key and salt, with as many salts as keep them below the limit, and its values copied to each.
        """
        names = [c for c in values.columns if c not in self.keys]
        near = values.withColumnsRenamed({k: f"__key_{k}" for k in self.keys})
        on = [as_col(k).eqNullSafe(as_col(f"__key_{k}")) for k in self.keys]
        keys = [f"__key_{k}" for k in self.keys]
        if self.count <= TOP_KEYS:
            return df.join(F.broadcast(near), on, "left").drop(*keys)
        ranked = self.table.orderBy(F.desc("__rows"), *map(as_col, self.keys))
        top = materialise(ranked.limit(TOP_KEYS))
        least = top.agg(F.min("__rows")).first()[0]
        salts = max(2, -(-least // self.limit))
        top_keys = top.select(*[as_col(k).alias(f"__top_{k}") for k in self.keys], F.lit(True).alias("__top"))
        same = [as_col(f"__key_{k}").eqNullSafe(as_col(f"__top_{k}")) for k in self.keys]
        marked = near.join(F.broadcast(top_keys), same, "left").drop(*[f"__top_{k}" for k in self.keys])
        # matched by broadcast, rows of the largest keys take salts no other value has, and stay spread
        first = marked.where("__top").withColumnsRenamed({n: f"__first_{n}" for n in names})
        out = df.join(F.broadcast(first), on, "left").drop(*keys)
        task = F.spark_partition_id() % SPREAD
        out = out.withColumn("__salt", F.when(F.col("__top"), task + salts).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")))
        rest = marked.where("__top IS NULL").drop("__top").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = out.join(rest, [*on, F.col("__salt") == F.col("__copy")], "left")
        merged = [F.when(F.col("__top"), as_col(f"__first_{n}")).otherwise(as_col(n)).alias(n) for n in names]
        return out.select(*[as_col(c) for c in df.columns], *merged)


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*[as_col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__rows"))


def spread_join(df: DataFrame, table: DataFrame, keys: list[str], values: list[str], hot: HotKeys) -> DataFrame:
    """Left join to a table with one row per key, with the hot keys of df kept off one task.

    Rows of hot keys meet their table rows as ``HotKeys.join`` has it and are then spread by map task instead of
    by key; all other rows are joined by shuffle.  NULL keys meet nothing.
    """
    if not hot:
        return df.join(table.select(*[as_col(c) for c in keys + values]), keys, "left")
    hot_table = table.join(hot.table.select(*map(as_col, keys)), keys, "left_semi").select(
        *[as_col(c) for c in keys], *[as_col(c).alias(f"__h_{c}") for c in values], F.lit(True).alias("__hot")
    )
    cold = table.select(*[as_col(c) for c in keys + values], F.lit(0).alias("__spread"))
    left = hot.join(df, hot_table)
    apart = F.coalesce(F.col("__hot"), F.lit(False))
    for k in keys:
        apart = apart | as_col(k).isNull()
    salt = F.when(apart, F.lit(1) + F.spark_partition_id() % SPREAD).otherwise(F.lit(0))
    out = left.withColumn("__spread", salt).join(cold, keys + ["__spread"], "left")
    merged = [F.when(F.col("__hot"), as_col(f"__h_{c}")).otherwise(as_col(c)).alias(c) for c in values]
    return out.select(*[as_col(c) for c in df.columns], *merged)


def attach_group_values(df: DataFrame, keys: list[str], stats: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Values of a one-row-per-key table written on every row of the key (NULL keys get NULL)."""
    values = [c for c in stats.columns if c not in keys]
    hot = HotKeys.of(df, keys, rows_per_task=rows_per_task)
    return spread_join(df, stats, keys, values, hot)


def star_join(parent: DataFrame, children: list[DataFrame], key: str, how: str = "left") -> DataFrame:
    """Children already reduced to one row per key, joined onto the parent one by one.

    A wide child goes through the joins as one struct: each join copies it whole instead of column by column.
    """
    out, order = parent, [as_col(c) for c in parent.columns]
    for i, child in enumerate(children):
        columns, packed = [c for c in child.columns if c != key], f"__child{i}"
        if len(columns) < PACKED_COLUMNS:
            order += [as_col(c) for c in columns]
        else:
            child = child.select(as_col(key), F.struct(*map(as_col, columns)).alias(packed))
            order += [F.col(packed).getField(c).alias(c) for c in columns]
        out = out.join(child, key, how)
    return out.select(*order)


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Every column but the kept ones renamed to prefix + name."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})
