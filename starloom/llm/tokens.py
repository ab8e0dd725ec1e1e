"""Whole texts to token ids with the tokenizers library, each distinct word piece encoded once.

Texts are cut at ASCII white space, which the tokenizer drops, and each distinct word is encoded
once for a batch; its ids are then laid out for all its occurrences.  Before that A-Z is lower-cased
(as the tokenizer does) and closing punctuation after a letter or digit is cut off (as its pattern
does), which makes fewer distinct words.  This holds for tokenizers that say so in their file; for
any other, texts are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces a worker remembers between batches; later ones are encoded again in each batch.
REMEMBERED = 250_000
#: Text bytes encoded at once.
TEXT_BYTES = 3 << 20
CLOSING = "(?s)^(?P<core>.*[a-z0-9à-öø-ÿ])(?P<tail>[.,;:!?]+)$"
#: Fixed value: the pattern of tokenizers whose words may be cut as described above.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.by_word = _pattern(described) == WORD_PATTERN
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.at: dict[str, int] = {}
        self.pool, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each text has)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            made = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            counts = np.fromiter((len(x) for x in made), np.int64, len(made))
            return np.concatenate([np.asarray(x.ids, np.uint32) for x in made] or [np.zeros(0, np.uint32)]), counts
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        parts, of_word = self._parts(coded.dictionary)
        pool, first, count = self._ids(parts)
        pieces = of_word[coded.indices.to_numpy()].ravel()
        length = count[pieces]
        stop = np.cumsum(length)
        ids = pool[np.repeat(first[pieces] - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)]
        total = np.concatenate([[0], stop])
        ends = (ends - ends[0]) * 2
        return ids, total[ends[1:]] - total[ends[:-1]]

    @staticmethod
    def _parts(words: pa.Array) -> tuple[list[str], np.ndarray]:
        """Distinct pieces, and the two pieces (word, closing punctuation) of each word."""
        low = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))  # special tokens keep their case
        found = pc.extract_regex(low, CLOSING)
        core = pc.if_else(found.is_valid(), found.field("core"), low)
        tail = pc.if_else(found.is_valid(), found.field("tail"), pa.scalar("", low.type))
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        return both.dictionary.to_pylist(), both.indices.to_numpy().reshape(2, -1).T

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = self.at
        at = np.fromiter((known.get(p, -1) for p in parts), np.int64, len(parts))
        new = np.flatnonzero(at < 0)
        made = [np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([parts[i] for i in new], add_special_tokens=False)]
        count = np.concatenate([self.count, np.fromiter(map(len, made), np.int64, len(made))])
        pool = np.concatenate([self.pool, *made])
        first = np.cumsum(count) - count
        at[new] = len(self.count) + np.arange(len(new))
        if len(known) < REMEMBERED:
            known.update((parts[i], int(at[i])) for i in new)
            self.pool, self.first, self.count = pool, first, count
        return pool, first[at], count[at]


def _pattern(described: dict) -> str:
    steps = described.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    return (first.get("pattern") or {}).get("Regex", "")


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by the end id."""
    out = np.empty(len(ids) + len(counts), np.uint32)
    stop = np.cumsum(counts + 1)
    last = np.zeros(len(out), bool)
    last[stop - 1] = True
    out[last], out[~last] = end, ids
    return out, counts + 1
