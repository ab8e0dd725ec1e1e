"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (21, 21 and 22 bits).  Each segment is a word of the
binary Golay code's space: the code is perfect, so every 23-bit word lies within three bits of exactly
one codeword.  A segment's keys are the codewords decoded from it and from all words one bit away:
one key where the segment lies within two bits of its codeword, six where it lies three bits away.
Two segments at most two bits apart have a common neighbour and hence a common key.  Of three
segments holding at most four differing bits some two hold at most two each (they hold two together),
so for each pair of segments the pairs of their keys are the fingerprint's join keys: no link is lost.

Only distinct fingerprints are joined.  Key lists are cut by shards of the key space; in a shard, the
members of one key are verified by their bit distance and only a spanning forest of the links found
is given on, never all pairs.  A key with more than CROWD fingerprints is not compared pairwise:
its fingerprints go to an exact way of linear cost, keyed by every word at half the distance around
them (2,081 for four bits), which bounds the members of each such key by that number.  Components are
joined by star contraction in Spark, written out after every round.

A text's features are the XXH64 (seed 42) of its shingles of ``shingle`` words, repeats included, A-Z
lower-cased; texts with fewer words have one shingle of all words; null, empty and wordless texts have
fingerprint zero and link like any other.  Repeated rows share a fingerprint and a component.  A row
whose id is null is in the component of its fingerprint (smallest known id; null where it has none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, carried, cut, discard, group_arrow, map_arrow, stage

#: Segments as (shift, bits).
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of one key that are still compared pairwise: beyond it the words at half the distance are fewer.
CROWD = 2_000
PRINT, TEXT, ID = "__print", "__text", "__id"
#: Distinct fingerprints for which one shard of the key space is made.
SHARD_ROWS = 8_000
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator."""
    out = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        out ^= np.where((out >> bit) & 1, GENERATOR << (bit - 11), 0)
    return out


def _error_table() -> np.ndarray:
    """The error of at most three bits behind each of the 2,048 remainders."""
    one = 1 << np.arange(23)
    pairs = np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])])
    table = np.zeros(2048, np.int64)
    table[_syndrome(pairs)] = pairs
    return table


ERRORS = _error_table()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each 23-bit word: its upper twelve bits."""
    return (words ^ ERRORS[_syndrome(words)]) >> 11


def segment_keys(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the codewords of each segment and of its neighbours, each once."""
    around = np.stack([decode(segment), *(decode(segment ^ (1 << b)) for b in range(width))], axis=1)
    around.sort(axis=1)
    new = np.ones(around.shape, bool)
    new[:, 1:] = around[:, 1:] != around[:, :-1]
    row, column = np.nonzero(new)
    return row, around[row, column]


def join_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each pair of segments all pairs of their keys."""
    per = [segment_keys(((prints >> U64(shift)) & U64((1 << width) - 1)).astype(np.int64), width) for shift, width in SEGMENTS]
    rows, keys = [], []
    for p, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (row_i, key_i), (row_j, key_j) = per[i], per[j]
        count = np.bincount(row_j, minlength=len(prints))
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        times = count[row_i]
        at = np.repeat(first[row_i], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rows.append(np.repeat(row_i, times))
        keys.append((p << 24) | (np.repeat(key_i, times) << 12) | key_j[at])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(texts: pa.Array, shingle: int) -> np.ndarray:
    words = Words(texts, lower=True)
    raw, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(texts), U64)
    weights = U64(1) << np.arange(64, dtype=U64)
    for d in range(len(texts)):
        n = int(words.first[d + 1] - words.first[d])
        if not n:
            continue
        own = raw[words.offsets[d] : words.offsets[d + 1]].split()
        joined = b" ".join(own)
        if n <= shingle:
            hashes = [digest(joined, 42)]
        else:
            lengths = np.fromiter(map(len, own), np.int64, n)
            stops = np.cumsum(lengths + 1) - 1
            starts = stops - lengths
            hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: n - shingle + 1].tolist(), stops[shingle - 1 :].tolist(), strict=True)]
        set_bits = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 4096):
            part = np.array(hashes[at : at + 4096], U64)
            set_bits += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[d] = weights[set_bits * 2 > len(hashes)].sum(dtype=U64)
    return out


def fingerprints(df: DataFrame, text: str, shingle: int, keep: list[str]) -> DataFrame:
    """``keep`` columns with PRINT: the fingerprint as a signed 64-bit integer."""
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(PRINT, T.LongType())])
    source = df.select(*keep, F.col(text).cast("string").alias(TEXT))

    def run(batches):
        for batch in cut(batches, TEXT, 4 << 20):
            made = fingerprint(batch.column(TEXT), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made)], [*keep, PRINT])

    return map_arrow(source, run, schema)


class Forest:
    """Union-find over positions; ``join`` returns the links that connected something."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True


def _by_key(rows: np.ndarray, keys: np.ndarray):
    """(first, last) ranges of equal keys with two members or more, over the sorted order."""
    order = np.lexsort((rows, keys))
    k = keys[order]
    edges = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
    long = np.flatnonzero(np.diff(edges) > 1)
    return order, [(int(edges[i]), int(edges[i + 1])) for i in long]


def link_shard(prints: np.ndarray, keys: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) links of a spanning forest of one shard, and the fingerprints of crowded keys."""
    values, rows = np.unique(prints, return_inverse=True)
    order, ranges = _by_key(rows, keys)
    rows = rows[order]
    forest, links, crowded = Forest(len(values)), [], []
    small: dict[int, list] = {}
    for a, b in ranges:
        if b - a > CROWD:
            crowded.append(rows[a:b])
        else:
            small.setdefault(b - a, []).append(a)
    for size, starts in small.items():
        i, j = np.triu_indices(size, 1)
        step = max(1, 500_000 // len(i))
        for at in range(0, len(starts), step):
            members = rows[np.array(starts[at : at + step])[:, None] + np.arange(size)]
            x, y = members[:, i], members[:, j]
            near = np.bitwise_count(values[x] ^ values[y]) <= distance
            pairs = np.unique(x[near] * np.int64(len(values)) + y[near])
            for p in pairs.tolist():
                left, right = divmod(p, len(values))
                if forest.join(left, right):
                    links.append((left, right))
    got = np.array(links, np.int64).reshape(-1, 2)
    crowd = np.unique(np.concatenate(crowded)) if crowded else np.zeros(0, np.int64)
    return values[got[:, 0]], values[got[:, 1]], values[crowd]


def ball(radius: int) -> np.ndarray:
    """All words of at most ``radius`` set bits."""
    out = layer = np.zeros(1, U64)
    one = U64(1) << np.arange(64, dtype=U64)
    for _ in range(radius):
        layer = np.unique((layer[:, None] | one[None, :]).ravel())
        out = np.unique(np.concatenate([out, layer]))
    return out


def _packed(shard: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row (shard, body) for each shard: its values, column after column."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(shard) else np.zeros(0, np.int64)
    bodies = [b"".join(c[at].tobytes() for c in columns) for at in np.split(order, edges[1:])] if len(shard) else []
    return pa.RecordBatch.from_pydict({"shard": pa.array(shard[order][edges], pa.int32()), "body": pa.array(bodies, pa.binary())})


LINKS = "a long, b long, crowd boolean"


def _links(a, b, crowd) -> pa.Table:
    n = len(a)
    return pa.table({"a": np.concatenate([a, crowd]).view(np.int64), "b": np.concatenate([b, crowd]).view(np.int64), "crowd": np.arange(n + len(crowd)) >= n})


def links_between(distinct: DataFrame, distance: int, shards: int) -> DataFrame:
    """(a, b): links between distinct fingerprints (column print) that connect all components."""
    if distance > 4:
        raise ValueError("two of three segments are sure to hold two errors or fewer each only up to four bits")

    def key_rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                prints = batch.column("print").slice(at, 20_000).to_numpy().view(U64)
                row, key = join_keys(prints)
                yield _packed((key * 0x9E3779B1 >> 7) % shards, prints[row], key.astype(np.uint32))

    def link_rows(table: pa.Table) -> pa.Table:
        prints, keys = [], []
        for body in table.column("body"):
            raw = np.frombuffer(body.as_buffer(), np.uint8)
            n = len(raw) // 12
            prints.append(raw[: 8 * n].view(U64)), keys.append(raw[8 * n :].view(np.uint32))
        return _links(*link_shard(np.concatenate(prints), np.concatenate(keys), distance))

    found = group_arrow(map_arrow(distinct.select("print"), key_rows, "shard int, body binary"), "shard", link_rows, LINKS)
    found = stage(found.distinct(), "simhash-links")
    links = found.where("NOT crowd").select("a", "b")
    crowd = found.where("crowd").select(F.col("a").alias("print")).distinct()
    if crowd.isEmpty():
        return links
    around = ball(distance // 2)
    odd = distance % 2  # with an odd distance the two halves differ: link, then verify

    def middle_rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                prints = batch.column("print").slice(at, 200).to_numpy().view(U64)
                middles = (prints[:, None] ^ (ball(distance // 2 + odd) if odd else around)[None, :]).ravel()
                yield _packed(((middles * U64(0x9E3779B97F4A7C15)) >> U64(33)).astype(np.int64) % (shards * 8), np.repeat(prints, len(middles) // len(prints)), middles)

    def middle_links(table: pa.Table) -> pa.Table:
        prints, middles = [], []
        for body in table.column("body"):
            both = np.frombuffer(body.as_buffer(), U64)
            prints.append(both[: len(both) // 2]), middles.append(both[len(both) // 2 :])
        return _links(*link_shard_by_middle(np.concatenate(prints), np.concatenate(middles), distance), np.zeros(0, U64))

    more = group_arrow(map_arrow(crowd, middle_rows, "shard int, body binary"), "shard", middle_links, LINKS)
    return links.unionByName(more.select("a", "b")).distinct()


def link_shard_by_middle(prints: np.ndarray, middles: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the fingerprints that share a middle word; at an even distance all of them are near each other."""
    values, rows = np.unique(prints, return_inverse=True)
    order = np.lexsort((rows, middles))
    m, r = middles[order], rows[order]
    if distance % 2 == 0:
        at = np.flatnonzero(m[1:] == m[:-1])
        pairs = np.unique(r[at] * np.int64(len(values)) + r[at + 1])
    else:
        _, ranges = _by_key(rows, middles)
        pairs = []
        for a, b in ranges:
            x, y = np.triu_indices(b - a, 1)
            x, y = r[a:b][x], r[a:b][y]
            near = np.bitwise_count(values[x] ^ values[y]) <= distance
            pairs.append(np.unique(x[near] * np.int64(len(values)) + y[near]))
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    forest, links = Forest(len(values)), []
    for p in pairs.tolist():
        left, right = divmod(p, len(values))
        if forest.join(left, right):
            links.append((left, right))
    got = np.array(links, np.int64).reshape(-1, 2)
    return values[got[:, 0]], values[got[:, 1]]


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(print, root): every linked fingerprint with the smallest of its component, by alternating star contraction."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stage(edges, "stars")
    now = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node's smaller neighbours, and itself, to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        after = stage(small.where("u <> v").distinct(), "stars")
        discard(edges)
        edges, before, now = after, now, _digest(after)
        if now == before:
            return edges.select(F.col("u").alias("print"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, distance: int = 4, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with fingerprint (16 hex digits), component_id, the smallest id that links
    reach, and component_print, the smallest fingerprint (signed) that they reach."""
    keep = carried(df, keep, ("fingerprint", "component_id", "component_print", PRINT))
    source = df.withColumn(ID, F.col(doc_id))
    prints = stage(fingerprints(source, text, shingle, [*keep, ID]), "fingerprints")
    distinct = prints.groupBy(F.col(PRINT).alias("print")).agg(F.min(ID).alias("least"))
    distinct = stage(distinct, "distinct-fingerprints")
    shards = max(4, -(-distinct.count() // SHARD_ROWS))
    roots = components(links_between(distinct, distance, shards))
    rooted = distinct.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = rooted.join(smallest, "root").select(F.col("print").alias(PRINT), "component_id", F.col("root").alias("component_print"))
    out = prints.join(lookup, PRINT)
    return out.select(*keep, F.lower(F.lpad(F.hex(PRINT), 16, "0")).alias("fingerprint"), "component_id", "component_print")


def one_of_each(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row of each component of ``near_duplicates``: that with the smallest id, any one of equal ids."""
    least = found.where(F.col(doc_id).eqNullSafe(F.col("component_id")))
    return least.dropDuplicates(["component_print"]).drop("fingerprint", "component_id", "component_print")
