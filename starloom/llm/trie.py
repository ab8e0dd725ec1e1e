"""Token counts of a unigram tokenizer by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a run of bytes other than space and ASCII controls 9 to 13, with a mark for the word's
start in front.  Its best cut into vocabulary pieces is found by forward scores: the best score of a
prefix is the best over the pieces that end it.  That depends on the prefix alone, so words are put
into a trie and each node's score is computed once for all words below it; a word's count is read off
its last node.  A character may always be spelled as its UTF-8 bytes, each a token of BYTE_SCORE.
Scores are whole numbers (millionths of a natural logarithm), so equal cuts are equal everywhere; among
cuts of the same score the one with fewest tokens counts.

Each worker keeps its own trie and starts a new one beyond MAX_NODES; nothing is shuffled.  Null,
empty and wordless texts have no tokens.  Repeated rows are counted each.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, cut, map_arrow

#: Word-start mark of the pieces (fixed value).
START = "▁"
BYTE_SCORE = -14_000_000
MAX_NODES = 400_000
#: Text bytes counted at once.
TEXT_BYTES = 3 << 20

_TRIES: dict[str, Trie] = {}


def piece_scores(path: str) -> dict[str, int]:
    """Unigram scores of a sentencepiece vocabulary: Zipf's law over the order of its pieces, as its own scores are only ranks."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    whole = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / (r + 2) for r in range(len(whole))))
    return {p: round(-1e6 * (math.log(r + 2) + norm)) for r, p in enumerate(whole)}


class Trie:
    """Node 0 stands for the word-start mark; nodes hold the best score and token count of their prefix."""

    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        #: Ends of pieces with the piece's score, None where the end is no piece itself: no piece reaches beyond an end not in here.
        self.ends: dict[str, int | None] = {p[i:]: None for p in scores for i in range(len(p))} | scores
        self.clear()

    def clear(self) -> None:
        score = self.scores.get(START)
        spelled = len(START.encode())
        self.child: dict[int, int] = {}
        self.best = array("q", [spelled * BYTE_SCORE if score is None else max(score, spelled * BYTE_SCORE)])
        self.count = array("i", [spelled if score is None or score < spelled * BYTE_SCORE else 1])

    def insert(self, word: str) -> int:
        """The node of ``word``, made with its prefixes where they are new."""
        child, node, path = self.child, 0, [0]
        for depth, c in enumerate(word, 1):
            key = node << 21 | ord(c)
            node = child.get(key, -1)
            if node < 0:
                node = child[key] = self._node(START + word[:depth], path)
            path.append(node)
        return node

    def _node(self, prefix: str, path: list[int]) -> int:
        """``path`` has the nodes of all shorter prefixes."""
        ends, best, count, end = self.ends, self.best, self.count, len(prefix)
        spelled = len(prefix[-1].encode("utf-8", "surrogatepass"))
        top, fewest = best[path[-1]] + spelled * BYTE_SCORE, count[path[-1]] + spelled
        for start in range(end - 1, -1, -1):
            score = ends.get(prefix[start:], 0)
            if score is None:
                continue
            if score == 0:  # piece scores are below zero
                break
            tokens = 1
            if start:
                before = path[start - 1]
                score, tokens = score + best[before], 1 + count[before]
            if score > top or score == top and tokens < fewest:
                top, fewest = score, tokens
        best.append(top)
        count.append(fewest)
        return len(best) - 1

    def counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, score) of each word."""
        if len(self.best) > MAX_NODES:
            self.clear()
        nodes = [self.insert(w) for w in words]
        tokens = np.fromiter((self.count[n] for n in nodes), np.int64, len(nodes))
        return tokens, np.fromiter((self.best[n] for n in nodes), np.int64, len(nodes))

    @staticmethod
    def of(path: str) -> Trie:
        if path not in _TRIES:
            _TRIES[path] = Trie(piece_scores(path))
        return _TRIES[path]


def count_texts(texts: pa.Array, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, tokens, score) of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    tokens, score = trie.counts(distinct)
    real = np.fromiter((w != "" for w in distinct), bool, len(distinct))  # white space at an end leaves an empty word
    at, ends = coded.indices.to_numpy(), ends - ends[0]
    out = []
    for values in (real, np.where(real, tokens, 0), np.where(real, score, 0)):
        total = np.concatenate([[0], np.cumsum(values[at], dtype=np.int64)])
        out.append(total[ends[1:]] - total[ends[:-1]])
    return out[0], out[1], out[2]


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with n_words, n_tokens and score (millionths of the log probability).

    ``vocabulary`` is the path of a sentencepiece model.
    """
    results = ("n_words", "n_tokens", "score")
    keep = carried(df, keep, (*results, "__text"))
    schema = T.StructType([*df.select(*keep).schema.fields, *(T.StructField(r, T.LongType()) for r in results)])
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches):
        trie = Trie.of(vocabulary)
        for batch in cut(batches, "__text", TEXT_BYTES):
            made = count_texts(batch.column("__text"), trie)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, made)], [*keep, *results])

    return map_arrow(source, run, schema)
