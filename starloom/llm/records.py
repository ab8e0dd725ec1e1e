"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard file holds records one after the other: length (8 bytes), masked CRC-32C of the length bytes
(4), payload, masked CRC-32C of the payload (4), all little-endian: the framing of TFRecord files.  A
payload is: 1 if the id is known else 0 (1 byte), the document's id (8), the width of a token id in
bytes (1: two or four), the ids.  Beside each shard lies its index: for each record its offset and its
number of ids, both 8 bytes.  Any record can be read alone by its offset, in any order.

Documents are dealt out by ranges of their id, so shards ascend and ids ascend in each; rows with the
same id follow by the hash of their text, and then as they come, so that no id is too large for a task.
Null ids come first.  A task writes under a name of its own attempt and renames when it is done: a
repeated task gives the same files again.  Null texts are empty and have the end id only.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, cut, fresh_folder, map_arrow, stage, text_bytes
from .tokens import TEXT_BYTES, Encoder, with_end

#: Text bytes of a shard.
SHARD_TEXT = 24 << 20
#: The reversed CRC-32C polynomial and the constant of the mask.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


BYTE = _byte_table()
#: Remainder of two bytes at once.
PAIR = (BYTE[np.arange(65536) & 255] >> 8) ^ BYTE[(BYTE[np.arange(65536) & 255] ^ (np.arange(65536) >> 8)) & 255]
#: Bytes that are run through side by side.
LANE = 256


def _shift_tables(n: int) -> np.ndarray:
    """Tables (4, 256) that carry a remainder over ``n`` zero bytes."""
    states = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(n):
        states = (states >> 8) ^ BYTE[states & 255]
    return states.reshape(4, 256)


SHIFT = _shift_tables(LANE)


def crc32c(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """CRC-32C of many byte ranges of ``data`` at once.

    Each range is cut into lanes of LANE bytes from its end; all lanes run side by side from a zero
    state, and then each range joins its lanes in order.
    """
    length = stop - start
    lanes = -(-length // LANE)
    owner = np.repeat(np.arange(len(start)), lanes)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    end = stop[owner] - (lanes[owner] - 1 - number) * LANE
    begin = np.maximum(end - LANE, start[owner])
    state = np.zeros(len(owner), np.uint32)
    state[number == 0] = 0xFFFFFFFF
    ragged = np.flatnonzero(end - begin < LANE)  # first lanes only
    whole = np.flatnonzero(end - begin == LANE)
    at = begin[whole]
    s = state[whole]
    for i in range(0, LANE, 2):
        pair = data[at + i].astype(np.uint32) | (data[at + i + 1].astype(np.uint32) << 8)
        s = (s >> 16) ^ PAIR[(s ^ pair) & 0xFFFF]
    state[whole] = s
    for i in range(LANE):
        live = ragged[end[ragged] - begin[ragged] > i]
        if not len(live):
            break
        s = state[live]
        state[live] = (s >> 8) ^ BYTE[(s ^ data[begin[live] + i]) & 255]
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    at = np.cumsum(lanes) - lanes
    has = np.flatnonzero(lanes > 0)
    out[has] = state[at[has]]
    for step in range(1, int(lanes.max()) if len(lanes) else 0):
        live = np.flatnonzero(lanes > step)
        s = out[live]
        out[live] = SHIFT[0][s & 255] ^ SHIFT[1][(s >> 8) & 255] ^ SHIFT[2][(s >> 16) & 255] ^ SHIFT[3][s >> 24] ^ state[at[live] + step]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frame(ids: np.ndarray, counts: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the records, offset of each)."""
    size = 10 + counts * width
    offset = np.cumsum(size + 16) - (size + 16)
    out = np.zeros(int((size + 16).sum()), np.uint8)
    n = len(counts)
    head = np.zeros((n, 22), np.uint8)
    head[:, :8] = size.astype("<u8").view(np.uint8).reshape(n, 8)
    head[:, 12] = known
    head[:, 13:21] = doc_ids.astype("<i8").view(np.uint8).reshape(n, 8)
    head[:, 21] = width
    flat = np.ascontiguousarray(head[:, :8]).ravel()
    head[:, 8:12] = masked(crc32c(flat, np.arange(n) * 8, np.arange(n) * 8 + 8)).astype("<u4").view(np.uint8).reshape(n, 4)
    place = np.zeros(len(out), bool)  # where ids go
    edge = np.zeros(len(out) + 1, np.int8)
    np.add.at(edge, offset + 22, 1)
    np.add.at(edge, offset + 22 + counts * width, -1)
    place = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out[place] = ids.astype(f"<u{width}").view(np.uint8)
    out[(offset[:, None] + np.arange(22)).ravel()] = head.ravel()
    tail = masked(crc32c(out, offset + 12, offset + 12 + size)).astype("<u4").view(np.uint8).reshape(n, 4)
    out[((offset + 12 + size)[:, None] + np.arange(4)).ravel()] = tail.ravel()
    return out, offset


def unframe(data: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(doc ids, whether known, counts, ids of each) of the records at the offsets; raises if a checksum is wrong."""
    n = len(offset)
    head = data[offset[:, None] + np.arange(22)]
    size = np.ascontiguousarray(head[:, :8]).view("<u8").ravel().astype(np.int64)
    flat = np.ascontiguousarray(head[:, :8]).ravel()
    stored = np.ascontiguousarray(head[:, 8:12]).view("<u4").ravel()
    if (masked(crc32c(flat, np.arange(n) * 8, np.arange(n) * 8 + 8)) != stored).any() or (offset + 16 + size > len(data)).any():
        raise ValueError("a record's length is damaged")
    tail = np.ascontiguousarray(data[(offset + 12 + size)[:, None] + np.arange(4)]).view("<u4").ravel()
    if (masked(crc32c(data, offset + 12, offset + 12 + size)) != tail).any():
        raise ValueError("a record's payload is damaged")
    width = head[:, 21].astype(np.int64)
    ids = [data[o + 22 : o + 12 + s].view(f"<u{w}").astype("<u4") for o, s, w in zip(offset.tolist(), size.tolist(), width.tolist(), strict=True)]
    return np.ascontiguousarray(head[:, 13:21]).view("<i8").ravel(), head[:, 12].astype(bool), (size - 10) // width, ids


def write_records(df: DataFrame, folder: str, tokenizer: str, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all texts' ids to ``folder``; returns the index (shard, file, offset, start, n_tokens), written beside the files.

    ``start`` is the number of ids before the record in the whole order.
    """
    shards = max(1, -(-text_bytes(df, text) // SHARD_TEXT))
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = [F.xxhash64("text"), F.monotonically_increasing_id()]
    source = source.repartitionByRange(shards, "doc_id", *tie).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches):
        context = TaskContext.get()
        shard, encoder = context.partitionId(), Encoder.of(tokenizer)
        width = 2 if encoder.size <= 1 << 16 and end < 1 << 16 else 4
        name = f"part-{shard:06d}"
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = f"{root}/_{name}-{context.attemptNumber()}-{uuid.uuid4().hex}"
        at, before, offsets, sizes = 0, 0, [], []
        with store.open_output_stream(attempt) as out:
            for batch in cut(batches, "text", TEXT_BYTES):
                ids, counts = with_end(*encoder.encode(batch.column("text")), end)
                column = batch.column("doc_id")
                data, offset = frame(ids, counts, column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False), width)
                out.write(memoryview(data))
                offsets.append(offset + at), sizes.append(counts)
                n = len(counts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array(np.full(n, shard, np.int32)),
                        "file": pa.array([f"{name}.rec"] * n),
                        "offset": pa.array(offset + at),
                        "start": pa.array(before + np.cumsum(counts) - counts),
                        "n_tokens": pa.array(counts),
                    }
                )
                at, before = at + len(data), before + int(counts.sum())
        if offsets:
            with store.open_output_stream(f"{attempt}.idx") as out:
                out.write(memoryview(np.stack([np.concatenate(offsets), np.concatenate(sizes)], axis=1).astype("<u8").ravel().view(np.uint8)))
            store.move(attempt, f"{root}/{name}.rec")
            store.move(f"{attempt}.idx", f"{root}/{name}.idx")
        else:
            store.delete_file(attempt)

    index = stage(map_arrow(source, write, "shard int, file string, offset long, start long, n_tokens long"), "record-index")
    return with_starts(df.sparkSession, index)


def with_starts(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Add to each record's start what all shards before its own hold: one row for each shard is summed on the driver."""
    totals = sorted((r["shard"], r["n"]) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    bases, total = [], 0
    for shard, n in totals:
        bases.append((shard, total))
        total += n
    base = spark.createDataFrame(bases, T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())]))
    return index.join(F.broadcast(base), "shard").select("shard", "file", "offset", (F.col("start") + F.col("base")).alias("start"), "n_tokens")


def read_records(index: DataFrame, folder: str, keep: list[str] | None = None) -> DataFrame:
    """The records of an index in any order: doc_id, ids (little-endian unsigned 32-bit) and the index's columns."""
    keep = carried(index, keep, ("doc_id", "ids"))
    schema = T.StructType([*index.select(*keep).schema.fields, T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])

    def read(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            files, offsets = batch.column("file"), batch.column("offset").to_numpy()
            counts = batch.column("n_tokens").to_numpy()
            codes = files.dictionary_encode()
            for k, name in enumerate(codes.dictionary.to_pylist()):
                rows = np.flatnonzero(codes.indices.to_numpy() == k)
                rows = rows[np.argsort(offsets[rows], kind="stable")]
                with store.open_input_file(f"{root}/{name}") as source:
                    at = 0
                    while at < len(rows):  # neighbours in one read, a few megabytes at a time
                        reach = offsets[rows[at:]] + 26 + counts[rows[at:]] * 4 - offsets[rows[at]]
                        near = max(1, int(np.searchsorted(reach, 4 << 20, "right")))
                        part = rows[at : at + near]
                        low = int(offsets[part[0]])
                        data = np.frombuffer(source.read_at(int(reach[near - 1]), low), np.uint8)
                        ids, known, _, tokens = unframe(data, offsets[part] - low)
                        out = {c: batch.column(c).take(pa.array(part)) for c in keep}
                        out |= {"doc_id": pa.array(ids, mask=~known), "ids": pa.array([x.tobytes() for x in tokens], pa.binary())}
                        yield pa.RecordBatch.from_pydict(out)
                        at += near

    return map_arrow(index.select(*dict.fromkeys([*keep, "file", "offset", "n_tokens"])), read, schema)


def new_folder(spark: SparkSession) -> str:
    return fresh_folder(spark, "records")
