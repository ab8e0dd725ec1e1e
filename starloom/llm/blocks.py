"""Documents packed into blocks, and an exchange that answers each block.

A block is one row holding some megabytes of documents as compressed Arrow data, written once to the
shared folder.  An operator that must compare something of every document with all others sends, for
each block and each shard of the hash space, one small message; the task that gets a shard sees the
messages of all blocks, and answers every message.  Whatever is frequent is counted inside its block
before it is sent, so a passage in a third of all documents costs one entry for each block, as any
other, and no task ever gets the rows of a frequent key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, group_arrow, map_arrow, stage

#: Text bytes of a block, and what one shard of the hash space is made for.
BLOCK_BYTES = 6 << 20
SHARD_BYTES = 16 << 20

Message = tuple[int, bytes]


def pack(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (block long, body binary) of all columns of ``df``, written to the shared folder."""
    source = df.withColumn(text, F.col(text).cast("string"))

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal number, held, size
            body = to_body(pa.Table.from_batches(held))
            out = pa.RecordBatch.from_pydict({"block": pa.array([(task << 32) + number], pa.int64()), "body": pa.array([body], pa.binary())})
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            for piece in cut([batch], text, block_bytes):
                held.append(piece)
                size += pc.sum(pc.binary_length(piece.column(text))).as_py() or 0
                if size >= block_bytes or sum(x.num_rows for x in held) >= 20_000:
                    yield flush()
        if held:
            yield flush()

    return stage(map_arrow(source, blocks, "block long, body binary"), "blocks", "uncompressed")


def to_body(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_body(body: pa.Buffer | bytes) -> pa.Table:
    with pa.ipc.open_stream(body) as reader:
        return reader.read_all().combine_chunks()


def send(blocks: DataFrame, messages: Callable[[pa.Table, dict[int, bytes]], Iterable[Message]]) -> DataFrame:
    """(shard, block, body): what each block sends to each shard.  ``messages`` gets the block's documents and the answers it has."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                table, block = from_body(batch.column("body")[i].as_buffer()), batch.column("block")[i].as_py()
                out = list(messages(table, answers_of(batch, i)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([s for s, _ in out], pa.int32()),
                        "block": pa.array([block] * len(out), pa.int64()),
                        "body": pa.array([b for _, b in out], pa.binary()),
                    }
                )

    return map_arrow(blocks, run, "shard int, block long, body binary")


def answers_of(batch: pa.RecordBatch, row: int) -> dict[int, bytes]:
    if "answers" not in batch.schema.names:
        return {}
    got = batch.column("answers")[row].as_py() or []
    return {x["shard"]: x["body"] for x in got}


def answer(sent: DataFrame, reduce: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(block, answers): each shard's messages, from all blocks, turned into one answer for each message."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bodies = [b.as_buffer() for b in table.column("body")]
        return pa.table(
            {"shard": table.column("shard"), "block": table.column("block"), "body": pa.array(reduce(bodies), pa.binary())}
        )

    replies = group_arrow(sent, "shard", run, "shard int, block long, body binary")
    return replies.groupBy("block").agg(F.collect_list(F.struct("shard", "body")).alias("answers"))


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    return blocks.join(answers, "block", "left")


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def unbits(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n, bitorder="little").astype(bool)


def read_blocks(blocks: DataFrame, rows: Callable[[pa.Table, dict[int, bytes]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows made from each block's documents and its answers."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from rows(from_body(batch.column("body")[i].as_buffer()), answers_of(batch, i))

    return map_arrow(blocks, run, schema)
