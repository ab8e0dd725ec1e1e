"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

**Words.**  Runs of ``[A-Za-z]`` and U+00C0 to U+00FF, A-Z lower-cased.  To plant misspellings, a run whose crc32
(of ``<doc_id>:<run>``) is a multiple of DROP loses one of its characters.  Words are the results of at least
``shortest`` characters with at least ``least`` occurrences.

**Trees.**  A word is the vector of its letter counts.  One inserted character adds one to one count, one
replaced character also takes one from another: an L1 distance of one or two.  So a word's near words are in
the trees of its own length and of the lengths beside it, in the boxes that it reaches by one more of one letter, one less of
another, or both; all other boxes are pruned.  The tops of the trees are fitted on a bounded sample of at most SAMPLE words
(by least hash), so that a leaf holds about LEAF words, and are at most MOST_LEAVES leaves; they only decide where words go.
Every word is dealt to its own leaf and, as a query, to each leaf it reaches.  There a task goes on with a tree of
the leaf's words down to BUCKET words and verifies the order of letters: equal but for one place, or for one character left out.

Each leaf sends at most one row for each query, with the number of its near words and the best, so no group of near words is ever
brought together.  A word has at most a few thousand near words (its length times the letters), whatever the input.

Null and empty texts have no words, a null id counts as empty; repeated rows count each.  Ties of occurrences go to the
smaller word in code-point order.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, coded, cut, flat, group_arrow, map_arrow, spans, stage

#: A run whose crc32 this divides is misspelt.
DROP = 199
#: Words of a top tree's leaf, of a leaf's own buckets, of the sample the tops are fitted on, leaves and trees of all tops.
LEAF, BUCKET, SAMPLE, MOST_LEAVES, MOST_TREES = 4_096, 16, 200_000, 32_768, 1_000
#: Pairs verified at once, and text bytes worked on at once.
PAIRS, TEXT_BYTES = 1 << 20, 8 << 20
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Place of each Latin-1 letter in a count vector: a-z, then U+00C0 to U+00FF.
PLACE = np.zeros(256, np.int64)
PLACE[97:123], PLACE[192:256] = np.arange(26), np.arange(26, 90)
DIMENSIONS = 90
UNUSED, BARRED = -1, -2


def crc_shifts(most: int) -> np.ndarray:
    """[n, byte place, byte]: what a crc32 becomes by n more bytes, to be combined with theirs by exclusive or."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    # crc32 of one byte is linear in it; as a register's step: table[low byte] ^ register >> 8
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most + 1):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


SHIFTS = crc_shifts(64)


def joined_crcs(before: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of texts with crc ``before`` followed by texts of at most 64 bytes with crc ``own``."""
    out = own.copy()
    for place in range(4):
        out ^= SHIFTS[sizes, place, (before >> np.uint32(8 * place)) & 255]
    return out


def batch_words(ids: list, texts: pa.Array, shortest: int) -> tuple[list[str], list[int]]:
    """Distinct words of at least ``shortest`` characters with their occurrences."""
    data, offsets = flat(texts)
    data = LOWER[data]
    solid = LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # the first of the two bytes of U+00C0 to U+00FF
    solid[lead], solid[lead + 1] = True, True
    start, stop = spans(solid, offsets)
    runs = coded(data, solid, start, stop)
    names, number = runs.dictionary.to_pylist(), runs.indices.to_numpy()
    text = np.searchsorted(offsets, start, "right") - 1
    before = np.fromiter((zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids), np.uint32, len(ids))
    own = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    sizes = np.fromiter(map(len, names), np.int64, len(names))
    crc = joined_crcs(before[text], own[number], np.minimum(sizes, 64)[number])
    for i in np.flatnonzero(sizes[number] > 64).tolist():
        crc[i] = zlib.crc32(names[number[i]], int(before[text[i]]))
    hit = np.flatnonzero(crc % DROP == 0)
    counts = np.bincount(number, minlength=len(names))
    np.subtract.at(counts, number[hit], 1)
    changed: Counter[str] = Counter()
    for i in hit.tolist():
        name = names[number[i]].decode()
        at = int(crc[i]) % len(name)
        changed[name[:at] + name[at + 1 :]] += 1
    for name, n in zip(names, counts.tolist(), strict=True):
        if n and len(name) >= shortest:  # bytes; characters below
            changed[name.decode()] += n
    kept = [(w, n) for w, n in changed.items() if len(w) >= shortest]
    return [w for w, _ in kept], [n for _, n in kept]


def count_vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts of Latin-1 words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat_places = PLACE[np.frombuffer(b"".join(words), np.uint8)]
    cells = np.repeat(np.arange(len(words)), sizes) * DIMENSIONS + flat_places
    return np.bincount(cells, minlength=len(words) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.int32)


class Tree:
    """A k-d tree as flat lists: inner nodes split a letter's count at a value, leaves have numbers."""

    def __init__(self, vectors: np.ndarray, size: int, rows_for_each: float = 1.0):
        self.letter, self.value, self.left, self.right, self.leaf = [], [], [], [], []
        self.rows: list[np.ndarray] = []
        self._grow(vectors, np.arange(len(vectors)), size, rows_for_each)

    def _grow(self, vectors: np.ndarray, rows: np.ndarray, size: int, each: float) -> int:
        node = len(self.letter)
        for x in (self.letter, self.value, self.left, self.right, self.leaf):
            x.append(-1)
        if len(rows) * each > size and len(rows) > 1:
            own = vectors[rows]
            letter = int(np.argmax(own.var(axis=0)))
            counts = own[:, letter]
            low, high = int(counts.min()), int(counts.max())
            if low < high:
                sizes = np.cumsum(np.bincount(counts - low)[:-1])
                value = low + int(np.argmin(np.abs(sizes - len(rows) / 2)))
                self.letter[node], self.value[node] = letter, value
                side = counts <= value
                self.left[node] = self._grow(vectors, rows[side], size, each)
                self.right[node] = self._grow(vectors, rows[~side], size, each)
                return node
        self.leaf[node] = len(self.rows)
        self.rows.append(rows)
        return node

    def reach(self, vectors: np.ndarray, more: bool, less: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for all leaves in which a vector can lie that has one more of a letter (if ``more``) and one less of another (if ``less``)."""
        n = len(vectors)
        todo = [(0, np.arange(n), np.full(n, UNUSED if more else BARRED), np.full(n, UNUSED if less else BARRED))]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while todo:
            node, who, up, down = todo.pop()
            if self.leaf[node] >= 0:
                found.append((who, np.full(len(who), self.leaf[node])))
                continue
            letter, value = self.letter[node], self.value[node]
            count = vectors[who, letter] + (up == letter) - (down == letter)
            free = (up != letter) & (down != letter)
            right = count > value
            rises = free & ~right & (up == UNUSED) & (count == value)
            falls = free & right & (down == UNUSED) & (count == value + 1)
            for child, stays, crosses, gains in ((self.left[node], ~right, falls, (up, np.full(len(who), letter))), (self.right[node], right, rises, (np.full(len(who), letter), down))):
                a, b = np.flatnonzero(stays), np.flatnonzero(crosses)
                if len(a) + len(b):
                    todo.append((child, np.concatenate([who[a], who[b]]), np.concatenate([up[a], gains[0][b]]), np.concatenate([down[a], gains[1][b]])))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([w for w, _ in found]), np.concatenate([x for _, x in found])


def letters(words: list[bytes], width: int) -> np.ndarray:
    """Words as rows of bytes, filled up with zeros."""
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width) if words else np.zeros((0, width), np.uint8)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_left_out(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the short word (one place less wide) is the long one without one character."""
    n = short.shape[1]
    ahead = np.logical_and.accumulate(short == long[:, :n], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= n


def near_in_leaf(points: list[bytes], queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) of all pairs one edit apart; points are of one length, queries of this length or one beside it."""
    if not points or not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = len(points[0])
    tree = Tree(count_vectors(points), BUCKET)
    most = max(map(len, tree.rows))
    sizes = np.fromiter(map(len, queries), np.int64, len(queries))
    matrix = letters(points, length)
    out = []
    for shift in (-1, 0, 1):
        own = np.flatnonzero(sizes == length + shift)
        for at in range(0, len(own), 4_096):
            some = own[at : at + 4_096]
            words = [queries[i] for i in some.tolist()]
            who, leaf = tree.reach(count_vectors(words), more=shift <= 0, less=shift >= 0)
            asked = letters(words, length + shift)
            step = max(1, min(PAIRS, (64 << 20) // (length + 1)) // most)
            for lo in range(0, len(who), step):  # some megabytes of letters at once
                w, parts = who[lo : lo + step], [tree.rows[x] for x in leaf[lo : lo + step].tolist()]
                q = np.repeat(w, [len(p) for p in parts])
                p = np.concatenate(parts)
                a, b = asked[q], matrix[p]
                near = one_replaced(a, b) if shift == 0 else one_left_out(a, b) if shift < 0 else one_left_out(b, a)
                out.append((some[q[near]], p[near]))
    return np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)]), np.concatenate([x for _, x in out] or [np.zeros(0, np.int64)])


def answer_leaf(table: pa.Table) -> pa.Table:
    """(word, near, best_n, best) of the queries of one leaf that have near words in it."""
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    n = table.column("n").to_numpy()
    points, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
    order = sorted(points.tolist(), key=lambda i: (-n[i], words[i]))  # best first
    q, p = near_in_leaf([words[i] for i in order], [words[i] for i in queries.tolist()])
    best = np.full(len(queries), len(order))
    np.minimum.at(best, q, p)
    near = np.bincount(q, minlength=len(queries))
    some = np.flatnonzero(near)
    top = [order[i] for i in best[some].tolist()]
    names = table.column("word").combine_chunks()
    return pa.table({"word": names.take(pa.array(queries[some])), "near": pa.array(near[some], pa.int64()), "best_n": pa.array(n[top] if top else [], pa.int64()), "best": names.take(pa.array(top, pa.int64()))})


def top_trees(words: DataFrame) -> dict[int, tuple[int, Tree]]:
    """By length: the number of its first leaf, and the tree fitted on its part of the sample.  Other lengths are one leaf each."""
    crowded = words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).where(F.col("n") > LEAF)
    sizes = {r["length"]: r["n"] for r in crowded.orderBy(F.desc("n"), "length").limit(MOST_TREES).collect()}
    total = sum(sizes.values())
    share = min(1.0, SAMPLE / max(1, total))
    chosen = words.where(F.length("word").isin(list(sizes)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))).limit(2 * SAMPLE)
    by_length: dict[int, list[bytes]] = {}
    for r in chosen.select("word").collect() if sizes else []:
        by_length.setdefault(len(r["word"]), []).append(r["word"].encode("latin-1"))
    size = max(LEAF, 2 * total // MOST_LEAVES)
    out, first = {}, 0
    for length, sample in sorted(by_length.items()):
        tree = Tree(count_vectors(sorted(sample)), size, sizes[length] / len(sample))
        out[length] = (first, tree)
        first += len(tree.rows)
        tree.rows = [r[:0] for r in tree.rows]
    return out


def dealt(words: DataFrame) -> DataFrame:
    """(leaf, asks, word, n): each word in its own leaf, and asking in all leaves it reaches."""
    tops = words.sparkSession.sparkContext.broadcast(top_trees(words))

    def run(batches):
        trees = tops.value
        for batch in cut(batches, "word", TEXT_BYTES):
            names = batch.column("word")
            latin = [w.encode("latin-1") for w in names.to_pylist()]
            sizes = np.fromiter(map(len, latin), np.int64, len(latin))
            rows, leaves, asks = [], [], []
            for length in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == length)
                vectors = None
                for to, kinds in ((length, ((False, False), (True, True))), (length + 1, ((True, False),)), (length - 1, ((False, True),))):
                    for more, less in kinds if to else ():
                        if to in trees:
                            vectors = count_vectors([latin[i] for i in own.tolist()]) if vectors is None else vectors
                            first, tree = trees[to]
                            who, leaf = tree.reach(vectors, more, less)
                            rows.append(own[who]), leaves.append(first + leaf)
                        else:  # below zero: the whole length is a leaf
                            rows.append(own), leaves.append(np.full(len(own), -to))
                        asks.append(np.full(len(rows[-1]), more or less))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaves), pa.int64()), pa.array(np.concatenate(asks)), names.take(at), batch.column("n").take(at)], ["leaf", "asks", "word", "n"])

    return map_arrow(words.select("word", "n"), run, "leaf long, asks boolean, word string, n long")


def word_counts(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): the words with their occurrences, written once."""
    source = df.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in cut(batches, "text", TEXT_BYTES):
            words, counts = batch_words(batch.column("id").to_pylist(), batch.column("text"), shortest)
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(counts, pa.int64())})

    counted = map_arrow(source, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return stage(counted, "spelling-words")


def spelling_variants(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = 6, least: int = 5, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    Near words differ by one inserted, deleted or replaced character.  ``form`` is the near word with most occurrences, if
    these are at least ``factor`` (two or more) times the word's own, else null; ``root`` is what following forms ends at.
    """
    words = word_counts(df, text, doc_id, shortest, least)
    found = group_arrow(dealt(words), "leaf", answer_leaf, "word string, near long, best_n long, best string")
    near = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best"))).alias("top"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("top.m")).alias("form_n"), F.col("top.best").alias("form"))
    fits = F.col("form_n") >= factor * F.col("n")
    formed = stage(joined.withColumns({"form": F.when(fits, F.col("form")), "form_n": F.when(fits, F.col("form_n"))}), "spelling-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # occurrences grow by the factor with each step, so paths are short; each round doubles what is followed
    steps = math.log(max(1.0, most / least), factor)
    for i in range(math.ceil(math.log2(max(1.0, steps)))):
        further = links.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        links = stage(links.join(further, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_root", "root").alias("root")), f"spelling-roots-{i}")
    roots = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
    out = formed.join(roots, F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
