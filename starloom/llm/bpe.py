"""Byte-level BPE encoding and decoding as streaming transducers.

**Encoding.**  A merge list decides a token once enough of the text behind it is known.  How much is
enough follows from the list: let two texts share their first n bytes.  While the merges are applied in
rank order, the part in which both agree shrinks only when a merge (u, v) crosses its end in one of
them, by u; what then stands behind the end begins with u, so the next merge that crosses must have a
right side beginning with u, and a higher rank.  The longest such chain of left sides, found by one
pass over the list, is the sufficient lookahead: tokens that end that many bytes before the end of what
has been read can't change any more.  The transducer therefore holds WINDOW bytes and the lookahead,
merges them, emits the stable tokens and goes on behind the last of them, in constant memory for a
run of letters of any length.  This needs a list in which each side of a merge is a byte or the result of an
earlier merge and no two merges have the same result; other lists raise ValueError.

**Pre-tokens.**  Texts are first cut as byte-level tokenizers do: contractions, letters, numbers and other
characters with one space before them, and white space, found by Unicode classes in whole batches.
Strings of special tokens in a text are tokens of their own.  Each distinct pre-token of a batch is
encoded once, and the short ones are remembered in the worker up to REMEMBERED bytes.

**Decoding.**  Tokens' bytes go through a byte-to-text machine that holds at most three bytes of an
unfinished character and puts U+FFFD for what is no UTF-8.

Nothing is shuffled.  Null text is empty, and empty text has no ids; null ids decode to null; repeated rows
are encoded each.  Ids are binary, little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, cut, map_arrow

#: Bytes merged at once, besides the lookahead.
WINDOW = 4096
#: Bytes of distinct pre-tokens a worker remembers, and the longest of them.
REMEMBERED, SHORT = 2 << 20, 64
#: Text bytes encoded or ids' bytes decoded at once.
TEXT_BYTES = 4 << 20
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Fixed value: characters that are white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Fixed value: endings that stand alone after an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

_CODECS: dict[str, Codec] = {}
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    global _CLASSES
    if _CLASSES is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _CLASSES = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        _CLASSES[WHITE] = SPACE
    return _CLASSES


def byte_names() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself if visible, else the next one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256))
    return [chr(b) if b in visible else chr(256 + next(hidden)) for b in range(256)]


class Merges:
    """The merge list by ids, its sufficient lookahead, and the transducer."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [ids[u + v] for u, v in merges]
        self.longest = max([1, *(len(u) + len(v) for u, v in merges)])
        made = {bytes([b]) for b in range(256)}
        chain: dict[bytes, int] = {}  # by left side: the longest chain that ends with it
        self.lookahead = 0
        for rank, (u, v) in enumerate(merges):
            if u not in made or v not in made or u + v in made:
                raise ValueError(f"merge {rank} is not made of earlier ones, or repeats one")
            made.add(u + v)
            self.rank[ids[u], ids[v]] = rank
            length = len(u) + max(chain.get(v[:k], 0) for k in range(1, len(v) + 1))
            chain[u] = max(chain.get(u, 0), length)
            self.lookahead = max(self.lookahead, length)

    def whole(self, piece: bytes) -> list[int]:
        """The tokens of ``piece``: the merge of least rank first, the leftmost of equal ones."""
        ids, rank = [self.of_byte[b] for b in piece], self.rank
        if len(ids) > SHORT:
            return self._by_heap(ids)
        never = len(self.made)
        ranks = [rank.get(pair, never) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), never)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i) for i in range(n - 1) if (found := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank.get((ids[i], ids[j])) != least:
                continue  # merged otherwise in the meantime
            ids[i], ids[j] = self.made[least], -1
            after[i] = after[j]
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n:
                    before[right] = left
                    if (found := rank.get((ids[left], ids[right]))) is not None:
                        heapq.heappush(heap, (found, left))
        return [t for t in ids if t >= 0]

    def stream(self, chunks: Iterator[bytes], sizes: list[int], window: int = WINDOW) -> Iterator[list[int]]:
        """The tokens of what the chunks make together, as soon as they are stable; ``sizes``: bytes of each token."""
        most = window + self.lookahead + self.longest
        held = b""
        for chunk in chunks:
            for at in range(0, len(chunk), window):
                held += chunk[at : at + window]
                while len(held) >= most:
                    held, out = self._stable(held, sizes)
                    yield out
        if held:
            yield self.whole(held)

    def _stable(self, held: bytes, sizes: list[int]) -> tuple[bytes, list[int]]:
        tokens, end, n = self.whole(held), 0, 0
        for t in tokens:
            if end + sizes[t] > len(held) - self.lookahead:
                break
            end, n = end + sizes[t], n + 1
        return held[end:], tokens[:n]


class Text:
    """Bytes to text, piece by piece: holds the bytes of an unfinished character."""

    def __init__(self):
        self.held = b""

    def feed(self, piece: bytes) -> str:
        data = self.held + piece
        end = len(data) - self._unfinished(data)
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that a longer text may complete to a character: a first byte and those that may follow it, fewer than it asks for."""
        for back in range(1, min(3, len(data)) + 1):
            first = data[-back]
            if first & 0xC0 == 0x80:
                continue
            asked = 2 if 0xC2 <= first <= 0xDF else 3 if 0xE0 <= first <= 0xEF else 4 if 0xF0 <= first <= 0xF4 else 1
            if asked <= back:
                return 0
            if back > 1:  # the second byte of some characters is bound more tightly
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(first, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(first, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0


def starts_of(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens start; ``bounds`` are the first bytes of the texts (or parts of texts) and the end of the last."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[code]
    n = len(kind)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, bounds)] = True
    edge[n] = True
    change = edge.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)  # runs of one class within one text, and the end
    first, stop = run[:-1], run[1:]
    start = np.zeros(n + 1, bool)
    start[first] = True
    # the last white space before a character stands apart, and a plain space goes with what follows it
    last = stop - 1
    apart = last[(kind[first] == SPACE) & ~edge[stop]]
    start[apart] = True
    start[apart[code[apart] == 0x20] + 1] = False
    # an apostrophe on its own, not after a plain space, and one of the endings
    lone = first[(stop - first == 1) & (code[first] == 0x27) & ~edge[stop]]
    lone = lone[edge[lone] | (code[lone - 1] != 0x20)]
    room = np.searchsorted(run, lone, "right")
    left = run[np.minimum(room + 1, len(run) - 1)] - lone - 1  # characters of the run behind it
    for ending in CONTRACTIONS:
        fits = left >= len(ending)
        for i, c in enumerate(ending):
            fits &= code[np.minimum(lone + 1 + i, n - 1)] == ord(c)
        start[lone[fits] + 1] = False
        start[lone[fits] + 1 + len(ending)] = True
    return at[np.flatnonzero(start[:n])]


class Codec:
    """Encodes and decodes with a tokenizer file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, steps = described["model"], described["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or described["normalizer"] or steps.get("type") != "ByteLevel" or steps["add_prefix_space"] or not steps["use_regex"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in described["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take their surroundings")
        byte_of = {ord(c): b for b, c in enumerate(byte_names())}
        to_bytes = lambda s: bytes(s.translate(byte_of).encode("latin-1"))
        ids = {to_bytes(s): i for s, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = Merges([(to_bytes(u), to_bytes(v)) for u, v in pairs], ids)
        self.special = {t["content"].encode(): t["id"] for t in described["added_tokens"]}
        names = ids | self.special
        self.token = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.token[i] = name
        self.sizes = [len(t) for t in self.token]
        lengths = np.array(self.sizes, np.int64)
        self.pool, self.first, self.length = np.frombuffer(b"".join(self.token), np.uint8), np.cumsum(lengths) - lengths, lengths
        self.known: dict[bytes, list[int]] = {}
        self.remembered = 0

    @staticmethod
    def of(path: str) -> Codec:
        if path not in _CODECS:
            _CODECS[path] = Codec(path)
        return _CODECS[path]

    def piece(self, piece: bytes) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        if len(piece) > WINDOW:
            return [t for part in self.merges.stream(iter([piece]), self.sizes) for t in part]
        return self.merges.whole(piece)

    def _ids(self, piece: bytes) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            found = self.piece(piece)
            if len(piece) <= SHORT and self.remembered < REMEMBERED:
                self.known[piece] = found
                self.remembered += len(piece)
        return found

    def _special_spans(self, raw: bytes) -> list[tuple[int, int]]:
        spans = []
        for name in self.special:
            at = raw.find(name)
            while at >= 0:
                spans.append((at, at + len(name)))
                at = raw.find(name, at + len(name))
        spans.sort(key=lambda s: (s[0], s[0] - s[1]))
        out = []
        for a, b in spans:  # the leftmost, of those the longest
            if not out or a >= out[-1][1]:
                out.append((a, b))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each text has)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if len(offsets) and raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        whole = data.tobytes()
        spans = [(a, b) for a, b in self._special_spans(whole) if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b, "left")]
        bounds = np.unique(np.concatenate([offsets, *([np.array(spans, np.int64).ravel()] if spans else [])]))
        starts = starts_of(data, bounds)
        if spans:  # nothing starts within a special token
            a = np.array(spans, np.int64)
            i = np.searchsorted(a[:, 0], starts, "right") - 1
            starts = starts[(i < 0) | (starts == a[i, 0]) | (starts >= a[i, 1])]
        edges = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(whole)])
        coded = pieces.dictionary_encode()
        made = [self._ids(p) for p in coded.dictionary.to_pylist()]
        count = np.fromiter(map(len, made), np.int64, len(made))
        pool = np.fromiter((t for m in made for t in m), np.uint32, int(count.sum()))
        which = coded.indices.to_numpy()
        ids = gather(pool, np.cumsum(count) - count, count, which)
        total = np.concatenate([[0], np.cumsum(count[which])])
        of_text = total[np.searchsorted(starts, offsets)]
        return ids, np.diff(of_text)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, ``TEXT_BYTES`` ids at a time through the byte-to-text machine."""
        text, out = Text(), []
        for at in range(0, len(ids), TEXT_BYTES):
            out.append(text.feed(gather(self.pool, self.first, self.length, ids[at : at + TEXT_BYTES]).tobytes()))
        return "".join([*out, text.close()])


def gather(pool: np.ndarray, first: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces ``which`` of ``pool`` one after the other."""
    size = length[which]
    stop = np.cumsum(size)
    return pool[np.repeat(first[which] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


def encode_texts(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with ids (binary) and n_tokens.  Columns named like these are left out."""
    keep = carried(df, keep, ("ids", "n_tokens", "__text"))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        codec = Codec.of(tokenizer)
        for batch in cut(batches, "__text", TEXT_BYTES):
            ids, counts = codec.encode(batch.column("__text"))
            edges = np.concatenate([[0], np.cumsum(counts)]) * 4
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), body.cast(pa.binary()), pa.array(counts)], [*keep, "ids", "n_tokens"])

    return map_arrow(df.select(*keep, F.col(text).cast("string").alias("__text")), run, schema)


def decode_ids(df: DataFrame, tokenizer: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with decoded, the text of the ids."""
    keep = carried(df, keep, ("decoded", "__ids"))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        codec = Codec.of(tokenizer)
        for batch in cut(batches, "__ids", TEXT_BYTES):
            texts = [None if b is None else codec.decode(np.frombuffer(b, "<u4")) for b in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return map_arrow(df.select(*keep, F.col(ids).alias("__ids")), run, schema)
