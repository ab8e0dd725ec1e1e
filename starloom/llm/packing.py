"""Packing along a space-filling curve: similar documents share sequences, and almost nothing is padded.

Each document's token ids are hashed into features, the features projected to DIMENSIONS numbers by
fixed random signs and scaled to a grid; the Hilbert key of the grid cell orders documents so that
neighbours on the curve are neighbours in space.  The documents, range-sorted by key, form one run of
tokens that is cut every ``length`` tokens; only the very last sequence is shorter (and padded).

Token ids are written once with their key; range bounds come from the keys alone, and then each
document's ids are shuffled once, to the range that holds its key.  Equal keys (copies, or one very
common text) are told apart by the place of their row in the written table, so a third of all rows
with one key are spread over many ranges.

Every row is a document of its own.  Null texts are empty: only the end id.  Null ids are kept.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, cut, map_arrow, mix, stage
from .tokens import TEXT_BYTES, Encoder, with_end

DIMENSIONS = 4
#: Bits of a grid coordinate; DIMENSIONS * GRID_BITS is at most 62.
GRID_BITS = 12
#: Hashed features of a token id.
FEATURES = 1 << 16
#: Ids below this have their weights in a table.
TABLE = 1 << 20
#: Tokens of one range of the curve, and the most ranges: beyond 3 * 10^11 tokens ranges grow (their sort spills), so that
#: the bounds and offsets of all ranges, 24 bytes each, stay a small table at any input.
RANGE_TOKENS, MAX_RANGES = 6_000_000, 50_000


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (n, dimensions), by transposing its Gray code."""
    x = points.astype(np.int64).T.copy()
    dimensions = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the highest bit down
        p = q - 1
        for i in range(dimensions):
            swap = (x[i] & q) == 0
            t = np.where(swap, (x[0] ^ x[i]) & p, 0)
            x[0] = np.where(swap, x[0] ^ t, x[0] ^ p)
            x[i] ^= t
        q >>= 1
    for i in range(1, dimensions):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dimensions):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _signs() -> np.ndarray:
    drawn = mix(np.arange(FEATURES, dtype=U64), 99)
    signs = np.stack([((drawn >> U64(i)) & U64(1)).astype(np.float32) * 2 - 1 for i in range(DIMENSIONS)], axis=1)
    return signs


SIGNS = _signs()


def weights(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared weight, signed weight in each dimension) of ids, which count by the log of their rank: common pieces have low ids."""
    weight = np.log1p(ids).astype(np.float32)
    feature = (mix(ids, 98) % U64(FEATURES)).astype(np.int64)
    return weight * weight, SIGNS[feature].T * weight


@cache
def weight_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    return weights(np.arange(size, dtype=np.uint32))


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's hashed token vector; weights of usual vocabularies come from a table."""
    first = np.cumsum(counts) - counts
    size = 1 << int(ids.max(initial=0)).bit_length()
    squares, signed = weight_table(size) if size <= TABLE else weights(ids)
    at = ids if size <= TABLE else slice(None)
    norm = np.sqrt(np.add.reduceat(squares[at], first))
    places = []
    for d in range(DIMENSIONS):
        total = np.add.reduceat(signed[d][at], first) / np.maximum(norm, 1e-6)
        # spread over the grid: the projection of n tokens is of the size of sqrt(n)
        places.append((np.tanh(total / 16) + 1) / 2)
    top = (1 << GRID_BITS) - 1
    return hilbert(np.rint(np.stack(places, axis=1) * top).astype(np.int64), GRID_BITS)


def tokenised(df: DataFrame, tokenizer: str, end: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, row, n, ids) written to the shared folder; row tells every row of the table from all others."""
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        encoder, row = Encoder.of(tokenizer), TaskContext.get().partitionId() << 33
        width = "<u2" if encoder.size <= 1 << 16 and end < 1 << 16 else "<u4"
        for batch in cut(batches, "text", TEXT_BYTES):
            ids, counts = with_end(*encoder.encode(batch.column("text")), end)
            keys = curve_keys(ids, counts)
            raw, size = ids.astype(width).tobytes(), int(width[2])
            stop = np.cumsum(counts) * size
            bodies = [raw[a:b] for a, b in zip((stop - counts * size).tolist(), stop.tolist(), strict=True)]
            n = batch.num_rows
            columns = [batch.column("doc_id"), pa.array(keys), pa.array(row + np.arange(n)), pa.array(counts), pa.array(bodies, pa.binary())]
            row += n
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "row", "n", "ids"])

    fields = [T.StructField("doc_id", source.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("key", "row", "n")), T.StructField("ids", T.BinaryType())]
    return stage(map_arrow(source, run, T.StructType(fields)), "packing-tokens")


def _sortable(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(key, row) as byte strings that sort like the pair."""
    return np.stack([key, row], axis=1).astype(">u8").view("S16").ravel()


def pack_documents(df: DataFrame, tokenizer: str, length: int = 2048, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset), sorted along the curve inside each partition.

    ``start`` is the number of the document's ids before the piece, ``offset`` the piece's place in its
    sequence, ``ids`` little-endian unsigned 32-bit integers.
    """
    tokens = tokenised(df, tokenizer, end, doc_id, text)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    ranges = min(MAX_RANGES, max(1, -(-total // RANGE_TOKENS)))
    placed = tokens.select("key", "row").repartitionByRange(ranges, "key", "row")
    # one row for each range, MAX_RANGES at most, comes to the driver
    bounds = sorted((r["b"]["key"], r["b"]["row"]) for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", "row")).alias("b")).collect())
    edges = _sortable(np.array([k for k, _ in bounds[1:]], np.int64), np.array([r for _, r in bounds[1:]], np.int64)) if len(bounds) > 1 else np.zeros(0, "S16")

    def to_range(batches):
        for batch in batches:
            at = np.searchsorted(edges, _sortable(batch.column("key").to_numpy(), batch.column("row").to_numpy()), "right")
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], ["range", *batch.schema.names])

    def ranged(source: DataFrame) -> DataFrame:
        return map_arrow(source, to_range, T.StructType([T.StructField("range", T.IntegerType()), *source.schema.fields]))

    sums = dict(ranged(tokens.select("key", "row", "n")).groupBy("range").agg(F.sum("n")).collect())
    base, before = {}, 0
    for r in sorted(sums):
        base[r], before = before, before + sums[r]

    def pieces(batches):
        current, at = None, 0
        for batch in batches:
            width = None
            bodies, counts = batch.column("ids"), batch.column("n").to_numpy()
            keep, start, size, sequence, offset, out = [], [], [], [], [], []
            for i, r in enumerate(batch.column("range").to_pylist()):
                if r != current:
                    current, at = r, base[r]
                n = int(counts[i])
                raw = bodies[i].as_buffer()
                width = len(raw) // n
                ids, done = np.frombuffer(raw, f"<u{width}").astype("<u4"), 0
                while done < n:
                    take = min(n - done, length - at % length)
                    keep.append(i), start.append(done), size.append(take), sequence.append(at // length), offset.append(at % length)
                    out.append(ids[done : done + take].tobytes())
                    done, at = done + take, at + take
                if sum(map(len, out[-64:])) > 1 << 20 or len(out) > 4_000:
                    yield _pieces(batch, keep, start, size, sequence, offset, out)
                    keep, start, size, sequence, offset, out = [], [], [], [], [], []
            if out:
                yield _pieces(batch, keep, start, size, sequence, offset, out)

    sorted_ = ranged(tokens).repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", "row")
    schema = T.StructType(
        [tokens.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset"))]
    )
    return map_arrow(sorted_, pieces, schema)


def _pieces(batch, keep, start, size, sequence, offset, out) -> pa.RecordBatch:
    at = pa.array(keep)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": batch.column("doc_id").take(at),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(size, pa.int64()),
            "ids": pa.array(out, pa.binary()),
            "doc_tokens": batch.column("n").take(at),
            "sequence_id": pa.array(sequence, pa.int64()),
            "offset": pa.array(offset, pa.int64()),
        }
    )
