"""Shared pieces: written intermediate tables, Arrow batches of bounded size, and words as flat arrays.

Rules that hold for every operator of this subpackage unless its docstring says otherwise:

* null text counts as empty text; an empty table gives an empty result with the full schema;
* repeated rows are rows of their own and get the same decision;
* an input column bearing the name of a result column is left out of the result, all others are
  carried only where the docstring says so.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set here only where it is unset (as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="starloom-llm-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table; cuts the lineage."""
    path = fresh_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._starloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later table reads."""
    for df in tables:
        path = getattr(df, "_starloom_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Let the Python workers of a session import this package by the driver's path."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = f"{ROOT}{os.pathsep}{env['PYTHONPATH']}" if env.get("PYTHONPATH") else ROOT


def carried(df: DataFrame, keep: list[str] | None, results: Iterable[str]) -> list[str]:
    """The columns to carry: ``keep`` (all, if None) without those that bear a result's name in any case."""
    taken = {r.lower() for r in results}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]


def give_back() -> None:
    """Return freed memory to the system: a worker waiting for its next task holds nothing of the last one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside of glibc
    if trim:
        trim(0)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers give memory back after each task."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def group_arrow(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    """``applyInArrow`` on the groups of ``key`` whose workers give memory back after each group."""
    ship(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            give_back()

    return df.groupBy(key).applyInArrow(run, schema)


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts; sizes shards and blocks, never decides a result."""
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def cut(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches whose ``column`` holds at most ``most`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        size = values.nbytes
        if size <= most:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        ends, start, total = np.cumsum(lengths), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, total + most, "right")))
            yield batch.slice(start, stop - start)
            start, total = stop, int(ends[min(stop, batch.num_rows) - 1])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(U64) + U64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse, modulo 2**64."""
    inverse = pow(base, -1, 2**64)
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


#: Separators of words: space and the ASCII controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, where each text starts and the end); null is empty."""
    values = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    values = pc.fill_null(values, b"")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    if not len(values) or raw is None or not len(raw):
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of the runs of solid bytes; no run goes on from one text to the next."""
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(solid))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def coded(data: np.ndarray, solid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.DictionaryArray:
    """The runs as numbers of distinct byte strings; equal numbers are equal bytes."""
    edges = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(data[solid].tobytes())]).dictionary_encode()


class Words:
    """The words of many texts as flat arrays.

    ``start``/``stop`` are byte ranges in ``data``, ``first[d]:first[d+1]`` are the words of text d,
    ``number`` says which of the distinct ``names`` each word is.  ``lower`` lower-cases A-Z.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, self.offsets = flat(texts)
        self.data = LOWER[data] if lower else data
        self.solid = ~SPACE[self.data]
        self.start, self.stop = spans(self.solid, self.offsets)
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def coded(self) -> pa.DictionaryArray:
        return coded(self.data, self.solid, self.start, self.stop)

    @cached_property
    def names(self) -> list[bytes]:
        return self.coded.dictionary.to_pylist()

    @cached_property
    def number(self) -> np.ndarray:
        return self.coded.indices.to_numpy().astype(np.int64)

    def name_hashes(self) -> np.ndarray:
        """XXH64 of each distinct word."""
        return np.fromiter(map(xxhash.xxh64_intdigest, self.names), U64, len(self.names))

    def hashes(self) -> np.ndarray:
        """XXH64 of each word's bytes."""
        return self.name_hashes()[self.number]

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        return [self.names[i] for i in self.number[which].tolist()]

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(all words joined by one space, where each word starts and ends in there)."""
        size = self.stop - self.start
        end = np.cumsum(size + 1) - 1
        out = np.full(end[-1] + 1 if len(end) else 0, 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[end] = False
        out[inside] = self.data[self.solid]
        return out.tobytes(), end - size, end


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial of every ``width`` consecutive values modulo 2**64: equal runs have equal values, but some unequal ones do, too."""
    n = len(values)
    if n < width:
        return np.zeros(0, U64)
    power, inverse = odd_powers(base, n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * power[:-1], out=sums[1:])
    return (sums[width:] - sums[:-width]) * inverse[: n - width + 1]


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` consecutive values, by doubling."""
    pick = np.minimum if least else np.maximum
    if len(values) < width:
        return values[:0]
    have, done = values, 1
    while done * 2 <= width:
        have = pick(have[:-done], have[done:])
        done *= 2
    return pick(have[: len(values) - width + 1], have[width - done :]) if done < width else have
