"""Which hashed keys occur often: compact messages of sorted keys, exchanged in levels.

Every task sorts the keys of what it read, adds equal ones and sends each shard of the key space one message: the
gaps between keys and their counts, byte plane by byte plane, compressed to a few bytes a key.  One level deals out to at most
2**FAN shards, whatever the input; where more are needed, groups of up to GROUP messages of one shard are merged and
dealt out by the next bits of the key.  So the messages grow in proportion to the input, and no task gets more than
a group's or a last shard's.  Keys of KEY_BITS bits may collide, which makes counts too large, never too small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, group_arrow, map_arrow

KEY_BITS = 48
#: Bits of one level's shards, messages merged in one group, keys of a last shard, and keys a task holds before it sends them.
FAN, GROUP, SHARD_KEYS, HELD = 9, 256, 4 << 20, 4 << 20


def _planes(values: np.ndarray, width: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.ravel()


def _from_planes(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.view("<u8").ravel()


def to_message(keys: np.ndarray, counts: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=U64(0))
    raw = np.concatenate([np.array([len(keys)], "<u8").view(np.uint8), _planes(gaps, KEY_BITS // 8), _planes(counts, 4)])
    return np.array([len(raw)], "<u8").tobytes() + pa.compress(raw.tobytes(), "zstd", asbytes=True)


def from_message(body: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(body, np.uint8)
    raw = np.frombuffer(pa.decompress(raw[8:].tobytes(), int(raw[:8].view("<u8")[0]), "zstd"), np.uint8)
    n, at = int(raw[:8].view("<u8")[0]), 8 + int(raw[:8].view("<u8")[0]) * (KEY_BITS // 8)
    return np.cumsum(_from_planes(raw[8:at], KEY_BITS // 8)).astype(U64), _from_planes(raw[at : at + 4 * n], 4).astype(np.int64)


def added(parts: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts, at most ``least`` of each (all that is asked)."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.minimum(np.add.reduceat(counts[order], new), least) if len(new) else counts[:0]


def _split(keys: np.ndarray, counts: np.ndarray, bits: int, sender: int) -> pa.RecordBatch:
    """One message for each value of the keys' first ``bits`` bits."""
    shard = (keys >> U64(KEY_BITS - bits)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else np.zeros(0, np.int64)
    stop = np.append(edge[1:], len(keys))
    bodies = [to_message(keys[a:b], counts[a:b]) for a, b in zip(edge.tolist(), stop.tolist(), strict=True)] if len(edge) else []
    columns = {"shard": pa.array(shard[edge], pa.int64()), "sender": pa.array([sender] * len(edge), pa.int64()), "body": pa.array(bodies, pa.binary())}
    return pa.RecordBatch.from_pydict(columns)


MESSAGE = "shard long, sender long, body binary"


def frequent_keys(source: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], total: int, least: int) -> DataFrame:
    """(h long): the keys that ``keys_of`` gives ``least`` times or more over all batches; ``total``: about how many keys it gives."""
    bits = max(3, (max(1, total // SHARD_KEYS) - 1).bit_length())

    def first(batches):
        sender, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for keys in keys_of(batches):
            values, counts = np.unique(keys, return_counts=True)
            held.append((values, counts))
            size += len(values)
            if size >= HELD:
                yield _split(*added(held, least), min(bits, FAN), (sender << 20) + number)
                number, held, size = number + 1, [], 0
        if held:
            yield _split(*added(held, least), min(bits, FAN), (sender << 20) + number)

    sent, done = map_arrow(source, first, MESSAGE), min(bits, FAN)
    while done < bits:
        more = min(bits, done + FAN)

        def merge(table: pa.Table, more=more) -> pa.Table:
            parts = added([from_message(b.as_buffer()) for b in table.column("body")], least)
            return pa.Table.from_batches([_split(*parts, more, table.column("sender")[0].as_py())])

        groups = max(1, -(-total // (HELD * GROUP)))
        grouped = sent.withColumn("_group", F.col("shard") * groups + F.pmod(F.xxhash64("sender"), F.lit(groups)))
        sent, done = group_arrow(grouped, "_group", merge, MESSAGE), more

    def last(table: pa.Table) -> pa.Table:
        keys, counts = added([from_message(b.as_buffer()) for b in table.column("body")], least)
        return pa.table({"h": pa.array(keys[counts >= least].view(np.int64))})

    return group_arrow(sent, "shard", last, "h long")
