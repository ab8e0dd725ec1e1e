"""Language identification by n-gram filters whose slots are bit masks of languages.

Learning counts the byte 4-grams of all labelled texts, each language apart.  A language contains an
n-gram that makes up at least MIN_RATE of its n-grams and is at least CLOSE times as frequent as in the
language that has it most.  All languages share one Bloom filter cut by bits: a slot is a mask with a
bit for each language, so one look-up (the AND of HASHES slots) tells all languages that contain an
n-gram.  A text's hits per language are the counts of its bits over the text's n-grams; hits that a
language would get from its filter's false positives alone are taken off, and the language with most
hits left is predicted (ties: the first name).

Size: a language contains at most 1 / MIN_RATE n-grams whatever the corpus, so filter and broadcast are
bounded by the number of languages.  N-grams are counted in their task, then by shards of their space.

A-Z is lower-cased; texts are taken whole, with a space before and after.  Texts that are null or have
no letter are `und`, score 0, as are all texts where nothing was learned.  The score is the winner's
share of the hits of the two best languages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, carried, cut, discard, group_arrow, map_arrow, stage

MIN_RATE = 1e-5
CLOSE = 0.5
HASHES = 3
#: Slots for each n-gram of the fullest language.
SLOTS = 16
SHARDS = 32
TEXT_BYTES = 2 << 20
UNKNOWN = "und"
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
LETTER = re.compile(r"[^\W\d_]")


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte 4-grams as 32-bit numbers, how many each text has); a text of n bytes has n + 1."""
    space, none = pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string())
    padded = pc.binary_join_element_wise(space, pc.fill_null(texts.cast(pa.large_string()), ""), space, none)
    offsets = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    data = LOWER[np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]].astype(np.uint32)
    every = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    counts = np.diff(offsets) - 3
    inside = np.ones(len(every), bool)
    for k in (1, 2, 3):  # n-grams that reach into the next text
        inside[offsets[1:-1] - offsets[0] - k] = False
    return every[inside], counts


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, shard, total, body): n-grams and counts of each task, by language and shard."""

    def run(batches):
        held: dict[str, list] = {}

        def flush(languages):
            out = {"lang": [], "shard": [], "total": [], "body": []}
            for name in languages:
                keys, counts = _merge(held.pop(name))
                shard = (keys * np.uint32(MULTIPLIERS[0])) >> np.uint32(27)
                for s in range(SHARDS):
                    at = shard == s
                    if at.any():
                        out["lang"].append(name), out["shard"].append(s), out["total"].append(int(counts[at].sum()))
                        out["body"].append(keys[at].tobytes() + counts[at].astype(np.int64).tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(out["lang"], pa.string()), pa.array(out["shard"], pa.int32()), pa.array(out["total"], pa.int64()), pa.array(out["body"], pa.binary())],
                ["lang", "shard", "total", "body"],
            )

        for batch in cut(batches, "text", TEXT_BYTES):
            keys, counts = grams(batch.column("text"))
            coded = batch.column("lang").dictionary_encode()
            of = np.repeat(coded.indices.to_numpy(), counts)
            for k, name in enumerate(coded.dictionary.to_pylist()):
                parts = held.setdefault(name, [])
                parts.append(np.unique(keys[of == k], return_counts=True))
                if len(parts) >= 8:
                    held[name] = [_merge(parts)]
            large = [n for n, parts in held.items() if sum(len(k) for k, _ in parts) > 1_000_000]
            if large:
                yield flush(large)
        if held:
            yield flush(list(held))

    return map_arrow(df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")), run, "lang string, shard int, total long, body binary")


class Filters:
    """The bit-sliced Bloom filter: ``slots[plane][slot]`` has a bit for each of up to 64 languages."""

    def __init__(self, languages: list[str], bits: int):
        self.languages, self.bits = languages, bits
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), kind)

    def _places(self, keys: np.ndarray):
        for m in MULTIPLIERS[:HASHES]:
            yield ((keys ^ (keys >> np.uint32(15))) * np.uint32(m)) >> np.uint32(32 - self.bits)

    def add(self, language: int, keys: np.ndarray) -> None:
        plane = self.slots[language // 64]
        for at in self._places(keys):
            plane[at] |= plane.dtype.type(1 << (language % 64))

    def rates(self) -> np.ndarray:
        """Each language's rate of false positives: its share of set slots, for each hash."""
        share = [np.count_nonzero(self.slots[i // 64] & self.slots.dtype.type(1 << (i % 64))) / (1 << self.bits) for i in range(len(self.languages))]
        return np.array(share) ** HASHES

    def hits(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(texts, languages): n-grams of each text that each language's filter holds."""
        first, places = np.cumsum(counts) - counts, list(self._places(keys))
        out = np.zeros((len(counts), len(self.languages)), np.int64)
        for p, plane in enumerate(self.slots):
            mask = plane[places[0]]
            for at in places[1:]:
                mask &= plane[at]
            for i in range(64 * p, min(64 * p + 64, len(self.languages))):
                bit = (mask >> plane.dtype.type(i % 64)) & plane.dtype.type(1)
                out[:, i] = np.add.reduceat(bit, first, dtype=np.int64)
        return out


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters of all languages of the rows with a language and a text."""
    counted = stage(gram_counts(df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang), "language-grams")
    totals = dict(counted.groupBy("lang").agg(F.sum("total")).collect())  # one row for each language
    languages = sorted(totals)

    def choose(table: pa.Table) -> pa.Table:
        per = {}
        for name, body in zip(table.column("lang").to_pylist(), table.column("body"), strict=True):
            raw = np.frombuffer(body.as_buffer(), np.uint8)
            n = len(raw) // 12
            per.setdefault(name, []).append((raw[: 4 * n].view(np.uint32), raw[4 * n :].view(np.int64) if 4 * n % 8 == 0 else raw[4 * n :].copy().view(np.int64)))
        per = {name: _merge(parts) for name, parts in per.items()}
        keys = np.unique(np.concatenate([k for k, _ in per.values()]))
        most, rate = np.zeros(len(keys)), {}
        for name, (k, c) in per.items():
            rate[name] = np.zeros(len(keys))
            rate[name][np.searchsorted(keys, k)] = c / totals[name]
            most = np.maximum(most, rate[name])
        chosen = {name: keys[(r >= MIN_RATE) & (r >= CLOSE * most)] for name, r in rate.items()}
        return pa.table({"lang": list(chosen), "keys": pa.array([k.tobytes() for k in chosen.values()], pa.binary())})

    chosen = group_arrow(counted, "shard", choose, "lang string, keys binary").collect()  # at most 1 / MIN_RATE n-grams for each language
    discard(counted)
    sizes = {name: 0 for name in languages}
    for r in chosen:
        sizes[r["lang"]] += len(r["keys"]) // 4
    bits = max(10, int(np.ceil(np.log2(SLOTS * max([1, *sizes.values()])))))
    filters = Filters(languages, bits)
    for r in chosen:
        filters.add(languages.index(r["lang"]), np.frombuffer(r["keys"], np.uint32))
    return filters


def predict(texts: pa.Array, filters: Filters) -> tuple[list[str], np.ndarray]:
    lettered = np.fromiter(map(has_letter, texts.to_pylist()), bool, len(texts))
    if not filters.languages or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    keys, counts = grams(texts)
    false = filters.rates()
    left = np.maximum(0, (filters.hits(keys, counts) - counts[:, None] * false) / (1 - np.minimum(false, 0.999)))
    best = left.argmax(axis=1)
    top = left.max(axis=1)
    second = np.partition(left, -2, axis=1)[:, -2] if left.shape[1] > 1 else np.zeros(len(top))
    score = np.where(lettered & (top > 0), top / np.maximum(top + second, 1e-300), 0.0)
    return [filters.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def identify(df: DataFrame, filters: Filters, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with lang_pred and score."""
    keep = carried(df, keep, ("lang_pred", "score", "__text"))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(filters)
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches):
        for batch in cut(batches, "__text", TEXT_BYTES):
            names, score = predict(batch.column("__text"), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return map_arrow(source, run, schema)


def held_out(doc_id: Column, parts: int, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
