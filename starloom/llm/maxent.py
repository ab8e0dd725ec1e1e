"""Language-model scoring: a hashed maximum-entropy model beside a unigram base.

Words are runs of bytes other than space and ASCII controls 9 to 13, A-Z lower-cased; each text ends
with one end token.  Counts, vocabulary and totals come from all training texts: every block of
documents sends its distinct words with their training counts to the shards of the word space, once
each, and is answered with their counts over all blocks.

The model predicts the class of a token and then the token in its class (class-factored softmax).  The
HEAD most frequent words, the end token and one token for all other words are dealt out, by frequency,
to CLASSES classes of as many members.  Another word's probability is that of the token for all others
times its own in the context: all other training words hang in a binary tree by LEAF_BITS bits of their
hashes, each node decides between its two sides, and the words of a leaf go by their smoothed
counts.  Nodes with words on one side only decide nothing.  A word not seen in training has the share of one count
among the others, so the probabilities of all texts sum to one.  Features are
the previous word, the two previous words (n-grams) and the word before the previous one (skip),
hashed into BUCKETS; class and member weights are two tables of fixed size, those of nodes, with the n-grams, hashed
into a third; all are broadcast to the tasks.

Training starts from the unigram distribution and goes once over all training documents, in UPDATES
batches of blocks.  In each update every task sums the gradient of its blocks, the sums are added by
slices of the tables, and the step is the gradient over its expected curvature, shrunk by SHRINK.

Null, empty and wordless texts have the end token only.  Repeated rows count and train each.  With no
training document all counts are zero, and every token's probability is that of an unseen word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import SHARD_BYTES, from_body, pack, read_blocks, send, to_body, with_answers
from .common import U64, Words, carried, group_arrow, map_arrow, mix, stage, text_bytes

CLASSES = 32
HEAD = CLASSES * CLASSES - 2
BUCKETS = 1 << 14
FEATURES = 3
UPDATES = 4
SHRINK, RATE, MOST = 10.0, 0.6, 1.5
#: The tree of the other words: bits of a path, weights, features, and what its steps are shrunk by.
LEAF_BITS, NODE_BUCKETS, NODE_FEATURES, NODE_SHRINK, NODE_SPREAD = 16, 1 << 18, 2, 2.0, U64(0x9E3779B97F4A7C15)
#: Tokens worked on at once, and slices of a table that are summed apart.
BATCH, SLICES = 1 << 15, 8
TRAIN, TEXT = "__train", "__text"


def _shards(hashes: np.ndarray, shards: int):
    shard = ((hashes >> U64(20)) % U64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if edges[s] < edges[s + 1]:
            yield s, order[edges[s] : edges[s + 1]]


def word_messages(table: pa.Table, shards: int):
    """Each shard's distinct words of the block with their counts in training documents."""
    words = Words(table.column(TEXT), lower=True)
    train = np.repeat(table.column(TRAIN).to_numpy(zero_copy_only=False), words.counts)
    counts = np.bincount(words.number, weights=train, minlength=len(words.names)).astype(np.int64)
    names = words.coded.dictionary
    for s, at in _shards(words.name_hashes(), shards):
        yield s, to_body(pa.table({"word": names.take(pa.array(at)).cast(pa.binary()), "n": counts[at]}))


def leaves(hashes: np.ndarray) -> np.ndarray:
    """The leaf of each word in the tree of the other words."""
    return (mix(hashes, 26) >> U64(64 - LEAF_BITS)).astype(np.int64)


def count_words(table: pa.Table) -> pa.Table:
    """One shard: answers to its blocks, the shard's totals, smoothed counts of its words by leaf, and its most frequent words."""
    table = table.combine_chunks()
    parts = [from_body(b.as_buffer()) for b in table.column("body")]
    coded = pa.concat_arrays([p.column("word").combine_chunks() for p in parts]).dictionary_encode()
    at = coded.indices.to_numpy()
    total = np.bincount(at, weights=np.concatenate([p.column("n").to_numpy() for p in parts]), minlength=len(coded.dictionary)).astype(np.int64)
    ends = np.cumsum([0, *(p.num_rows for p in parts)])
    bodies = [pa.compress(total[at[i:j]].tobytes(), "zstd", asbytes=True) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    names = np.array(coded.dictionary.to_pylist(), object)
    seen = np.flatnonzero(total)
    top = sorted(zip((-total[seen]).tolist(), names[seen].tolist(), strict=True))[:HEAD]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names[seen]), U64, len(seen))
    leaf, at = np.unique(leaves(hashes), return_inverse=True)
    mass = np.bincount(at, weights=total[seen] + 1, minlength=len(leaf)).astype(np.int64)
    kinds = ["answer"] * len(parts) + ["total"] + ["leaf"] * len(leaf) + ["head"] * len(top)
    n, rest = len(parts), len(kinds) - len(parts)
    return pa.table(
        {
            "kind": kinds,
            "block": pa.array([*table.column("block").to_pylist(), *[None] * rest], pa.int64()),
            "shard": pa.array([*table.column("shard").to_pylist(), *[None] * rest], pa.int32()),
            "body": pa.array([*bodies, None, *[None] * len(leaf), *(w for _, w in top)], pa.binary()),
            "tokens": pa.array([None] * n + [int(total.sum())] + leaf.tolist() + [-c for c, _ in top], pa.int64()),
            "words": pa.array([None] * n + [len(seen)] + mass.tolist() + [None] * len(top), pa.int64()),
        }
    )


class Model:
    """Counts, classes and weights; everything a task needs, of fixed size."""

    def __init__(self, tokens: int, words: int, documents: int, head: list[tuple[bytes, int]], mass: dict[int, int] | None = None):
        self.tokens, self.distinct = tokens + documents, words + (documents > 0)
        self.documents = documents
        ranked = sorted([(-n, w) for w, n in head] + [(-documents, None)], key=lambda x: (x[0], x[1] is not None, x[1] or b""))
        self.rest_tokens = tokens - sum(n for _, n in head)
        self.rest_words = words - len(head)
        counts = np.zeros(CLASSES * CLASSES)
        counts[0] = self.rest_tokens  # member 0 is the token for all other words
        counts[1 : len(ranked) + 1] = [-n for n, _ in ranked]
        self.end = 1 + next(i for i, (_, w) in enumerate(ranked) if w is None)
        known = [(w, i + 1) for i, (_, w) in enumerate(ranked) if w is not None]
        hashes = Words(pa.array([w for w, _ in known], pa.binary())).hashes() if known else np.zeros(0, U64)
        order = np.argsort(hashes)
        self.hashes, self.members = hashes[order], np.array([m for _, m in known], np.int64)[order]
        shares = (counts + 0.5).reshape(CLASSES, CLASSES)
        self.class_bias = np.log(shares.sum(axis=1) / shares.sum()).astype(np.float32)
        self.member_bias = np.log(shares / shares.sum(axis=1, keepdims=True)).astype(np.float32)
        self.weights = np.zeros((2, BUCKETS, CLASSES), np.float32)
        self._tree(mass or {}, hashes, [1 - n for n, w in ranked if w is not None])

    def _tree(self, mass: dict[int, int], head_hashes: np.ndarray, head_mass: list[int]) -> None:
        """Smoothed counts of the other words by leaf, and each node's log odds and whether both its sides have any."""
        leaf = np.zeros(1 << LEAF_BITS)
        leaf[list(mass)] = list(mass.values())
        if mass and len(head_hashes):
            np.subtract.at(leaf, leaves(head_hashes), np.array(head_mass, float))
        self.leaf_mass, below = leaf, [leaf]
        while len(below[0]) > 1:
            below.insert(0, below[0][0::2] + below[0][1::2])
        heap = np.concatenate([np.zeros(1), *below])
        left, right = heap[2::2], heap[3::2]
        self.split = np.concatenate([[False], (left > 0) & (right > 0)])
        self.odds = np.zeros(1 << LEAF_BITS, np.float32)
        self.odds[self.split] = np.log(right[self.split[1:]] / left[self.split[1:]])
        self.nodes, self.places = np.zeros(NODE_BUCKETS, np.float32), mix(np.arange(1 << LEAF_BITS).astype(U64), 28)

    def member_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.members[at], 0)


def contexts(words: Words, hashes: np.ndarray, distinct_member: np.ndarray, number: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member of every token, feature hashes (FEATURES, tokens), text of every token); each text's end is its last token."""
    counts = words.counts + 1
    last = np.cumsum(counts) - 1
    is_end = np.zeros(int(counts.sum()), bool)
    is_end[last] = True
    member = np.empty(len(is_end), np.int64)
    member[is_end], member[~is_end] = end, distinct_member[number]
    word = np.zeros(len(is_end), U64)
    word[~is_end] = hashes
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(is_end)) - np.repeat(last + 1 - counts, counts)
    one = np.where(place >= 1, np.roll(word, 1), U64(1))
    two = np.where(place >= 2, np.roll(word, 2), U64(1))
    return member, np.stack([mix(one, 21), mix(one * U64(3) + mix(two, 22), 23), mix(two, 24)]), owner


def _forward(model: Model, member: np.ndarray, features: np.ndarray):
    """(log probabilities, class probabilities, member probabilities, buckets of both tables) of a batch."""
    cls, inside, rows = member // CLASSES, member % CLASSES, np.arange(len(member))
    first = (features >> U64(50)).astype(np.int64)
    second = (mix(features + cls.astype(U64)[None, :], 25) >> U64(50)).astype(np.int64)
    out, ones = [], np.ones(CLASSES, np.float32)
    for table, bias, buckets, target in ((0, model.class_bias[None, :], first, cls), (1, model.member_bias[cls], second, inside)):
        p = np.take(model.weights[table], buckets[0], axis=0)
        p += bias
        for b in buckets[1:]:
            p += np.take(model.weights[table], b, axis=0)
        own = p[rows, target]
        np.exp(p, out=p)  # weights are at most MOST times UPDATES each, so nothing overflows
        total = p @ ones
        p /= total[:, None]
        out.append((own - np.log(total), p, buckets, target))
    return out


def descend(model: Model, leaf: np.ndarray, features: np.ndarray, learn: bool = True):
    """Words' ways from the root to their leaves: the log probability of each; and the buckets, errors and curvatures of all decisions."""
    way, buckets, errors, curvatures = np.zeros(len(leaf)), [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], [np.zeros(0, np.float32)]
    for level in range(LEAF_BITS):
        node = (1 << level) + (leaf >> (LEAF_BITS - level))
        at = np.flatnonzero(model.split[node])
        at = slice(None) if len(at) == len(leaf) else at
        node = node[at]
        toward = (2 * ((leaf[at] >> (LEAF_BITS - 1 - level)) & 1) - 1).astype(np.float32)
        place, odds = model.places[node], model.odds[node]
        for f in features[:NODE_FEATURES]:
            bucket = ((f[at] ^ place) * NODE_SPREAD >> U64(65 - NODE_BUCKETS.bit_length())).astype(np.int64)
            odds += model.nodes[bucket]
            buckets.append(bucket)
        odds *= -toward
        p = np.reciprocal(1 + np.exp(odds))
        way[at] += np.log(p)
        if learn:
            missed = 1 - p
            errors += [toward * missed] * NODE_FEATURES
            curvatures += [p * missed] * NODE_FEATURES
    return (way, np.concatenate(buckets), np.concatenate(errors), np.concatenate(curvatures)) if learn else (way,)


def gradient(table: pa.Table, model: Model, sums: np.ndarray, seen: np.ndarray, nodes: np.ndarray) -> None:
    """Add the block's gradient to ``sums`` (2, CLASSES, BUCKETS), its feature counts to ``seen`` (2, BUCKETS), and gradient and
    curvature of the tree to ``nodes`` (2, NODE_BUCKETS)."""
    train = table.column(TRAIN).combine_chunks()
    words = Words(table.column(TEXT).filter(train), lower=True)
    hashes = words.name_hashes()
    member, features, _ = contexts(words, hashes[words.number], model.member_of(hashes), words.number, model.end)
    leaf = token_leaves(words, hashes, model.end, member)
    for at in range(0, len(member), BATCH):
        other = at + np.flatnonzero(member[at : at + BATCH] == 0)
        _, buckets, errors, curvatures = descend(model, leaf[other], features[:, other])
        nodes[0] += np.bincount(buckets, errors, NODE_BUCKETS)
        nodes[1] += np.bincount(buckets, curvatures, NODE_BUCKETS)
        for t, (_, p, buckets, target) in enumerate(_forward(model, member[at : at + BATCH], features[:, at : at + BATCH])):
            rows = np.arange(len(target))
            p = -p
            p[rows, target] += 1
            columns = np.ascontiguousarray(p.T)
            for b in buckets:
                seen[t] += np.bincount(b, minlength=BUCKETS)
                for k in range(CLASSES):
                    sums[t, k] += np.bincount(b, columns[k], BUCKETS)


def token_leaves(words: Words, hashes: np.ndarray, end: int, member: np.ndarray) -> np.ndarray:
    """The leaf of each token's word; ends have none, and get 0."""
    out, is_word = np.zeros(len(member), np.int64), np.ones(len(member), bool)
    is_word[np.cumsum(words.counts + 1) - 1] = False
    out[is_word] = leaves(hashes)[words.number]
    return out


def update(blocks: DataFrame, model: Model) -> None:
    """One distributed gradient step; what comes to the driver is as large as the tables."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        sums, seen, nodes, any_block = np.zeros((2, CLASSES, BUCKETS)), np.zeros((2, BUCKETS)), np.zeros((2, NODE_BUCKETS)), False
        for batch in batches:
            for body in batch.column("body"):
                any_block = True
                gradient(from_body(body.as_buffer()), shared.value, sums, seen, nodes)
        if any_block:
            both = np.concatenate([sums.transpose(0, 2, 1), seen[:, :, None]], axis=2).astype(np.float32)
            parts = np.split(both, SLICES, axis=1) + np.split(nodes.astype(np.float32), SLICES, axis=1)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(2 * SLICES), pa.int32()), "body": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = None
        for body in table.column("body"):
            part = np.frombuffer(body.as_buffer(), np.float32).astype(np.float64)
            total = part if total is None else total + part
        return pa.table({"slice": table.column("slice").slice(0, 1), "body": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    summed = group_arrow(map_arrow(blocks.select("body"), run, "slice int, body binary"), "slice", add, "slice int, body binary").collect()
    shared.unpersist()
    if not summed:
        return
    bodies = [np.frombuffer(r["body"], np.float32) for r in sorted(summed)]
    errors, curvatures = np.concatenate([b.reshape(2, NODE_BUCKETS // SLICES) for b in bodies[SLICES:]], axis=1)
    model.nodes += np.clip(RATE * errors / (NODE_FEATURES * curvatures + NODE_SHRINK), -MOST, MOST).astype(np.float32)
    both = np.concatenate([b.reshape(2, BUCKETS // SLICES, CLASSES + 1) for b in bodies[:SLICES]], axis=1)
    steps, seen = both[:, :, :CLASSES], both[:, :, CLASSES:]
    share = np.exp(model.class_bias)
    spread = np.stack([share * (1 - share), np.full(CLASSES, (CLASSES - 1) / CLASSES**2, np.float32)])[:, None, :]
    model.weights += np.clip(RATE * steps / (seen * spread + SHRINK), -MOST, MOST).astype(np.float32)


def scores(table: pa.Table, answers: dict[int, bytes], model: Model, shards: int):
    """(tokens, known tokens, base score, model score) of each text."""
    words = Words(table.column(TEXT), lower=True)
    hashes, number = words.name_hashes(), words.number
    counts = np.zeros(len(hashes), np.int64)
    for s, at in _shards(hashes, shards):
        counts[at] = np.frombuffer(pa.decompress(answers[s], len(at) * 8, "zstd"), np.int64)
    member, features, owner = contexts(words, hashes[number], model.member_of(hashes), number, model.end)
    count = np.empty(len(member), np.int64)
    last = np.cumsum(words.counts + 1) - 1
    is_end = np.zeros(len(member), bool)
    is_end[last] = True
    count[is_end], count[~is_end] = model.documents, counts[number]
    base = np.log10((count + 1) / (model.tokens + model.distinct + 1))
    score = np.empty(len(member))
    for at in range(0, len(member), BATCH):
        (a, *_), (b, *_) = _forward(model, member[at : at + BATCH], features[:, at : at + BATCH])
        score[at : at + BATCH] = (a.astype(np.float64) + b) / np.log(10)
    others = model.rest_tokens + model.rest_words
    unseen = (member == 0) & (count == 0)
    score[unseen] -= np.log10(others + 1)
    leaf = token_leaves(words, hashes, model.end, member)
    for at in range(0, len(member), BATCH):
        other = at + np.flatnonzero((member[at : at + BATCH] == 0) & (count[at : at + BATCH] > 0))
        way = descend(model, leaf[other], features[:, other], learn=False)[0]
        score[other] += way / np.log(10) + np.log10((count[other] + 1) / model.leaf_mass[leaf[other]] * (others / (others + 1)))
    n = table.num_rows
    return words.counts + 1, np.bincount(owner, count > 0, n).astype(np.int64), np.bincount(owner, base, n), np.bincount(owner, score, n)


def train_and_score(df: DataFrame, training: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with n_tokens, n_known, train_tokens, base_score and score (log10).

    ``training`` says which rows are learned from.
    """
    results = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    keep = carried(df, keep, (*results, TRAIN, TEXT))
    source = df.select(*keep, F.coalesce(training, F.lit(False)).alias(TRAIN), F.col(text).cast("string").alias(TEXT))
    shards = max(4, -(-text_bytes(df, text) // (2 * SHARD_BYTES)))
    blocks = pack(source, TEXT)
    sent = send(blocks, lambda t, _: word_messages(t, shards))
    made = stage(group_arrow(sent, "shard", count_words, "kind string, block long, shard int, body binary, tokens long, words long"), "word-counts")
    tokens, words = made.where("kind = 'total'").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    documents = df.where(training).count()
    head = made.where("kind = 'head'").orderBy(F.desc("tokens"), "body").limit(HEAD).select("body", "tokens").collect()
    mass = made.where("kind = 'leaf'").groupBy("tokens").agg(F.sum("words").alias("words")).collect()  # a row a leaf
    model = Model(tokens, words, documents, [(bytes(r["body"]), r["tokens"]) for r in head], {r["tokens"]: r["words"] for r in mass})
    turn = F.pmod((F.col("block") / (1 << 32)).cast("long") + F.col("block") % (1 << 32), F.lit(UPDATES))
    for i in range(UPDATES if documents else 0):
        update(blocks.where(turn == i), model)
    shared = df.sparkSession.sparkContext.broadcast(model)
    answers = made.where("kind = 'answer'").groupBy("block").agg(F.collect_list(F.struct("shard", "body")).alias("answers"))

    def rows(table, answers):
        found = scores(table, answers, shared.value, shards)
        total = pa.array(np.full(table.num_rows, shared.value.tokens))
        made = [pa.array(found[0]), pa.array(found[1]), total, pa.array(found[2]), pa.array(found[3])]
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in keep), *made], [*keep, *results])

    schema = T.StructType([*source.select(*keep).schema.fields, *(T.StructField(n, t) for n, t in results.items())])
    return read_blocks(with_answers(blocks, answers), rows, schema)
