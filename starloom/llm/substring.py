"""Substring dedup with a count-min prefilter.

Pass 1 builds one sketch per block of documents and merges them by shards of the hash space; pass 2
groups exactly, by a cryptographic 128-bit digest (BLAKE2b) of its words, only the windows whose merged estimate is two
or more.  The estimate never falls below a window's true count, so no repeated window is lost.

What a sketch counts for a window is its anchor: the smallest hash among its runs of ANCHOR words.
Equal windows have equal anchors at equal places, and different starts of one window have different
anchor places, so the count of the anchor is at least that of the window; and neighbouring windows
share anchors, which makes a sketch about 14 times smaller than one of all windows.  The sketch has
two rows of counters and grows with the input: its shards are as many as the text needs.

Words are runs of bytes other than space and ASCII controls 9 to 13, unchanged.  Windows are judged on
the input, not on what is left.  Null and empty texts have no words; a text shorter than a window
keeps all; repeated rows are texts of their own, so both lose the windows they share.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import SHARD_BYTES, answer, bits, pack, read_blocks, send, unbits, with_answers
from .common import U64, Words, carried, mix, rolling, sliding, stage, text_bytes

#: Words of an anchor (less if windows are shorter).
ANCHOR = 8
#: Counters in one row of one shard's sketch, as a power of two; a shard is made for about 200,000 anchors.
CELL_BITS = 22
BASE = 0xD6E8FEB86659FD93


class Windows:
    """The windows of a block: where they start, their anchors and their hashes."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = Words(texts)
        self.window = window
        n = len(self.words)
        self.hashes = self.words.hashes()
        left = np.zeros(n, np.int64)  # words from here to the end of the text
        counts = self.words.counts
        left[:] = np.repeat(self.words.first[1:], counts) - np.arange(n)
        self.whole = left[: max(0, n - window + 1)] >= window  # a window starts here
        self.left = left

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchor of each window start, anchors at every place where one stands)."""
        width = min(ANCHOR, self.window)
        runs = mix(rolling(self.hashes, width, BASE), 1) | U64(1)
        runs[self.left[: len(runs)] < width] = U64(2**64 - 1)
        span = self.window - width + 1
        least = sliding(runs, span, least=True)
        own = np.where(self.whole, least[: len(self.whole)], U64(0))
        padded = np.concatenate([np.zeros(span - 1, U64), own, np.zeros(span - 1, U64)])
        stands = sliding(padded, span, least=False)[: len(runs)] == runs
        return own, runs[stands]

    def keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit BLAKE2b digests, in two halves, of the windows that start at the given places: their words joined by one space."""
        raw, start, end = self.words.joined()
        view = memoryview(raw)
        begin, stop = start[which].tolist(), end[which + self.window - 1].tolist()
        digests = b"".join(blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin, stop, strict=True))
        halves = np.frombuffer(digests, U64).reshape(-1, 2)
        return halves[:, 0].copy(), halves[:, 1].copy()


def _shard(values: np.ndarray, shards: int) -> np.ndarray:
    return ((values >> U64(32)) % U64(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray, shards: int):
    """(shard, places of its values in order) for shards that have any."""
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if edges[s] < edges[s + 1]:
            yield s, order[edges[s] : edges[s + 1]]


def _cells(values: np.ndarray, row: int) -> np.ndarray:
    return (mix(values, 10 + row) >> U64(64 - CELL_BITS)).astype(np.uint32)


def block_sketch(windows: Windows, shards: int):
    """The block's own sketch, as the counters it touches: cells of both rows and whether it counts two or more."""
    _, anchors = windows.anchors()
    values, counts = np.unique(anchors, return_counts=True)
    for s, at in _by_shard(_shard(values, shards), shards):
        v = values[at]
        yield s, np.concatenate([_cells(v, 0), _cells(v, 1)]).tobytes() + bits(counts[at] > 1)


def merge_sketches(bodies: list) -> list[bytes]:
    """Add all blocks' counters; answer each block which of its anchors are estimated at two or more."""
    parsed, rows = [], np.zeros((2, 1 << CELL_BITS), np.uint8)
    for body in bodies:
        raw = np.frombuffer(body, np.uint8)
        n = _entries(len(raw), 8)
        cells = raw[: 8 * n].view(np.uint32).reshape(2, n)
        more = unbits(raw[8 * n :].tobytes(), n)
        parsed.append(cells)
        for r in (0, 1):
            cell, number = np.unique(cells[r], return_inverse=True)
            gain = np.minimum(np.bincount(number, weights=more + 1.0), 2).astype(np.uint8)  # two is all that is asked
            rows[r][cell] = np.minimum(rows[r][cell] + gain, 2)
    return [bits(np.minimum(rows[0][c[0]], rows[1][c[1]]) >= 2) for c in parsed]


def _entries(size: int, width: int) -> int:
    """n for which n entries of ``width`` bytes and n bits, rounded up to bytes, make ``size`` bytes."""
    n = size * 8 // (8 * width + 1)
    while width * n + (n + 7) // 8 < size:
        n += 1
    return n


def estimated(windows: Windows, answers: dict[int, bytes], shards: int) -> np.ndarray:
    """Starts of the windows estimated repeated."""
    own, anchors = windows.anchors()
    values = np.unique(anchors)
    repeated = np.zeros(len(values), bool)
    for s, at in _by_shard(_shard(values, shards), shards):
        repeated[at] = unbits(answers[s], len(at))
    starts = np.flatnonzero(windows.whole)
    return starts[repeated[np.searchsorted(values, own[starts])]] if len(starts) else starts


def _distinct(a: np.ndarray, b: np.ndarray):
    """(first place, group of each, size of each group) of equal pairs, groups ordered by pair."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group, np.bincount(group, minlength=int(new.sum()))


def send_windows(windows: Windows, starts: np.ndarray, shards: int):
    a, b = windows.keys(starts)
    first, _, size = _distinct(a, b)
    for s, at in _by_shard(_shard(a[first], shards), shards):
        yield s, a[first][at].tobytes() + b[first][at].tobytes() + bits(size[at] > 1)


def group_windows(bodies: list) -> list[bytes]:
    """Exact counts over all blocks; answer which of a block's windows start anywhere else."""
    a, b, more, ends = [], [], [], []
    for body in bodies:
        raw = np.frombuffer(body, np.uint8)
        n = _entries(len(raw), 16)
        a.append(raw[: 8 * n].view(U64)), b.append(raw[8 * n : 16 * n].view(U64)), more.append(unbits(raw[16 * n :].tobytes(), n))
        ends.append(n)
    _, group, _ = _distinct(np.concatenate(a), np.concatenate(b))
    total = np.bincount(group, weights=1.0 + np.concatenate(more))
    repeated, at = total[group] >= 2, np.cumsum([0, *ends])
    return [bits(repeated[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def covered(windows: Windows, starts: np.ndarray, answers: dict[int, bytes], shards: int) -> np.ndarray:
    """The words that lie in a repeated window."""
    a, b = windows.keys(starts)
    first, group, _ = _distinct(a, b)
    repeated = np.zeros(len(first), bool)
    for s, at in _by_shard(_shard(a[first], shards), shards):
        repeated[at] = unbits(answers[s], len(at))
    change = np.zeros(len(windows.words) + 1, np.int32)
    hit = starts[repeated[group]] if len(starts) else starts
    change[hit] += 1
    np.subtract.at(change, hit + windows.window, 1)
    return np.cumsum(change[:-1]) > 0


def dedup_substrings(df: DataFrame, text: str = "text", window: int = 35, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``df`` (all, if None) with n_words, n_removed and kept: the words left, joined by one space.

    Every word covered by a window whose word sequence also starts anywhere else is removed.
    """
    keep = carried(df, keep, ("n_words", "n_removed", "kept"))
    columns = list(dict.fromkeys([*keep, text]))
    shards = max(4, -(-text_bytes(df, text) // SHARD_BYTES))
    blocks = pack(df.select(*columns), text)

    sketches = answer(send(blocks, lambda t, _: block_sketch(Windows(t.column(text), window), shards)), merge_sketches)

    def candidates(table, answers):
        windows = Windows(table.column(text), window)
        return send_windows(windows, estimated(windows, answers, shards), shards)

    sketches = stage(sketches, "sketch-answers")  # two later steps read them
    exact = answer(send(with_answers(blocks, sketches), candidates), group_windows)

    def rows(table, answers):
        first = {s: b for s, b in answers.items() if s >= 0}
        second = {-1 - s: b for s, b in answers.items() if s < 0}
        windows = Windows(table.column(text), window)
        starts = estimated(windows, first, shards)
        gone = covered(windows, starts, second, shards)
        yield _result(table, keep, windows.words, gone)

    fields = [f for f in df.schema.fields if f.name in keep]
    fields = [T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in fields]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())))])
    return read_blocks(with_answers(blocks, both(sketches, exact)), rows, schema)


def both(sketches: DataFrame, exact: DataFrame) -> DataFrame:
    """One list of answers: the sketch's by shard, the exact ones by -1 - shard."""
    turned = exact.select("block", F.expr("transform(answers, x -> named_struct('shard', -1 - x.shard, 'body', x.body))").alias("more"))
    joined = sketches.join(turned, "block", "left")
    empty = F.array().cast("array<struct<shard:int,body:binary>>")
    return joined.select("block", F.concat("answers", F.coalesce("more", empty)).alias("answers"))


def _result(table: pa.Table, keep: list[str], words: Words, gone: np.ndarray) -> pa.RecordBatch:
    raw, first = words.data.tobytes(), words.first
    sums = np.concatenate([[0], np.cumsum(gone)])
    removed = sums[first[1:]] - sums[first[:-1]]
    kept = []
    for d in range(table.num_rows):
        own = raw[words.offsets[d] : words.offsets[d + 1]].split()
        if removed[d]:
            own = compress(own, (~gone[first[d] : first[d + 1]]).tolist())
        kept.append(b" ".join(own))
    columns = {c: table.column(c).combine_chunks() for c in keep}
    columns |= {
        "n_words": pa.array(words.counts, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "kept": pa.array(kept, pa.binary()).cast(pa.string()),
    }
    return pa.RecordBatch.from_pydict(columns)
