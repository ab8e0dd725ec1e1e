"""Phrase collocation mining by sorting suffix pointers.

Texts lose A-Z case, are cut into pieces at ``[.,;:!?]`` and the controls 10 to 13, and pieces into words
at spaces and tabs.  Everything is counted per language (null: ``und``).

A phrase is a prefix of the suffixes of pieces, so counts of phrases are sizes of groups of suffix
pointers.  ``partitions`` is a multikey three-way quicksort of pointers: all groups that are still
unsorted are cut at once, each into the pointers whose next word is less than, equal to or greater
than a pivot; the equal ones go on with the word after it, down to the maximum depth.  What is
equal at a depth is a partition, its size the count of that prefix.

1. Words are counted; a bitmap of the hashes of frequent ones tells every task what can't start a phrase.
2. The hashes of pairs of frequent words are counted (``keycounts``), and a bitmap of the frequent ones says where suffixes
   may start and how far they reach: as far as their pairs are frequent.
3. Suffixes of two words or more are sorted to depth five in each batch, where equal ones become one row with their
   number, added over all batches, and routed by their leading words: ROUTE words, or more where a lead has over
   CROWD distinct suffixes.  Each route is sorted once more; partitions below the least count are abandoned, the
   others are the counts.  Prefixes shorter than a route are partial counts, which are added at the end.

A bitmap has at most 2**MOST_BITS bits whatever the input; false positives only let more pointers pass.
So no count is lost, equal suffixes are added before they travel, and no task gets more than CROWD
suffixes of one lead.  Null and empty texts have no words; repeated rows count each.  Words and languages are
compared by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, U64, coded, cut, flat, map_arrow, mix, spans, stage
from .keycounts import KEY_BITS, frequent_keys

#: Words of the longest phrase.
DEPTH = 5
#: Leading words that route a suffix, and distinct suffixes of one lead beyond which one more word does.
ROUTE, CROWD = 2, 200_000
#: Distinct suffixes of one reducing task.
ROUTED = 400_000
#: Bits of a bitmap for each entry, and the most bits as a power of two.
BITS_EACH, MOST_BITS = 16, 28
#: Text bytes worked on at once.
TEXT_BYTES = 4 << 20
#: Groups among which a language's best phrases are found first.
HEADS = 64
#: Bytes that end a piece, and bytes between words.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"

KIND = np.zeros(256, np.uint8)
KIND[list(BREAKS)], KIND[list(BLANKS)] = 2, 1


class Pieces:
    """The words of a batch as numbers, with how many words are left in each piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = flat(texts)
        data = LOWER[data]
        kind = KIND[data]
        start, stop = spans(kind == 0, offsets)
        words = coded(data, kind == 0, start, stop)
        self.names = words.dictionary
        self.word = words.indices.to_numpy().astype(np.int64)
        text = np.searchsorted(offsets, start, "right") - 1
        langs = langs.dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy()[text].astype(np.int64)
        piece = np.cumsum(kind == 2)[start] if len(start) else start
        last = np.ones(len(start), bool)
        last[:-1] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        end = np.flatnonzero(last)
        self.left = end[np.searchsorted(end, np.arange(len(start)))] + 1 - np.arange(len(start))

    def __len__(self) -> int:
        return len(self.word)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, word, hash, count) of the distinct words of each language, and which of them each word is in ``self.which``."""
        both = self.lang * len(self.names) + self.word
        values, self.which, counts = np.unique(both, return_inverse=True, return_counts=True)
        lang, word = np.divmod(values, max(1, len(self.names)))
        seeds = [xxhash.xxh64_intdigest(x.encode()) for x in self.langs]
        names = self.names.to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(names[w], seeds[g]) for g, w in zip(lang.tolist(), word.tolist(), strict=True)), U64, len(values))
        return lang, word, hashes, counts

    def phrases(self, at: np.ndarray, depth: np.ndarray) -> pa.Array:
        """The phrases of ``depth`` words that start at the words ``at``, joined by one space."""
        ends = np.cumsum(depth)
        flat = np.repeat(at - (ends - depth), depth) + np.arange(ends[-1] if len(ends) else 0)
        words = self.names.take(pa.array(self.word[flat]))
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), words)
        return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())


def partitions(words: np.ndarray, pointers: np.ndarray, reach: np.ndarray, first: np.ndarray, depth: int, weight: np.ndarray | None = None, least: float = 0, exempt: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of suffix pointers, all groups at once.

    ``words[pointers + d]`` is a suffix's word at depth d < ``reach``, ``first`` what it is grouped by before
    its words.  Yields (depth, a pointer's place, size) of the partitions of equal prefixes at depths 1 to ``depth``.  Partitions
    smaller than ``least`` are abandoned, but for those at depths up to ``exempt``, whose suffixes all go on.
    """
    weight = np.ones(len(pointers), np.int64) if weight is None else weight
    # the first key is dealt out by its number
    order = np.lexsort((words[pointers], first)) if len(pointers) else np.zeros(0, np.int64)
    order = order[reach[order] > 0]
    pending: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(depth + 1)]
    if len(order):
        new = np.ones(len(order), bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (words[pointers[order]][1:] != words[pointers[order]][:-1])
        pending[1].append((order, np.cumsum(new) - 1))
    for d in range(1, depth + 1):
        if not pending[d]:
            return
        order = np.concatenate([o for o, _ in pending[d]])  # all of one group have equal prefixes of d words
        ahead = np.cumsum([0, *(g[-1] + 1 for _, g in pending[d])])
        group = np.concatenate([g + n for (_, g), n in zip(pending[d], ahead, strict=False)])
        size = np.bincount(group, weights=weight[order]).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        fine = (size >= least) | (d <= exempt)
        yield d, order[begin[fine]], size[fine]
        if d < depth:
            go = fine[group] & (reach[order] > d)
            pending[d + 1] += _equal_parts(words, pointers, order[go], group[go], d)


def _equal_parts(words: np.ndarray, pointers: np.ndarray, order: np.ndarray, group: np.ndarray, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cut each group by the word at depth ``d`` until only equal parts are left: (places, part number) round by round."""
    key = words[pointers[order] + d]
    while len(order):
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(begin, len(order)))
        # the pivot is the median of a group's first, middle and last key
        trio = np.sort(np.stack([key[begin], key[begin + size // 2], key[begin + size - 1]]), axis=0)
        number = np.repeat(np.arange(len(begin)), size)
        side = np.sign(key - trio[1][number]) + 1  # 0 less, 1 equal, 2 greater
        equal = side == 1
        yield order[equal], number[equal]
        rest = ~equal
        part = (number * 2 + (side == 2))[rest]
        again = np.argsort(part, kind="stable")
        order, key, group = order[rest][again], key[rest][again], part[again]


class Bitmap:
    """Which hashes are frequent, on a fixed number of bits."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & U64((1 << self.bits) - 1)
        return (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)

    @staticmethod
    def of(table: DataFrame, column: str, entries: int) -> Bitmap:
        """The bitmap of a column of hashes; at most 2**MOST_BITS / 64 words come to the driver."""
        bits = min(MOST_BITS, max(12, int(entries * BITS_EACH - 1).bit_length()))
        at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        set_bits = table.select(F.shiftright(at, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("b"))
        made = set_bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(1 << (bits - 6), U64)
        words[made.column("w").to_numpy()] = made.column("b").to_numpy().view(U64)
        return Bitmap(words, bits)


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one + mix(two, 31), 32) >> U64(64 - KEY_BITS)


def frequent_pairs(pieces: Pieces, words: Bitmap) -> tuple[np.ndarray, np.ndarray]:
    """(word places at which two frequent words of a piece start, the hashes of these pairs)."""
    _, _, hashes, _ = pieces.distinct()
    good = words.has(hashes)[pieces.which]
    at = np.flatnonzero((pieces.left[:-1] > 1) & good[:-1] & good[1:]) if len(pieces) else np.zeros(0, np.int64)
    one = hashes[pieces.which]
    return at, pair_hash(one[at], one[at + 1]) if len(at) else np.zeros(0, U64)


def _over_batches(source: DataFrame, rows, schema: str) -> DataFrame:
    def run(batches):
        for batch in cut(batches, "text", TEXT_BYTES):
            yield rows(Pieces(batch.column("text"), batch.column("lang")))

    return map_arrow(source, run, schema)


def word_rows(pieces: Pieces) -> pa.RecordBatch:
    lang, word, hashes, counts = pieces.distinct()
    langs = pa.array([pieces.langs[g] for g in lang.tolist()], pa.string())
    names = pieces.names.take(pa.array(word)).cast(pa.large_string()).cast(pa.string())
    return pa.RecordBatch.from_pydict({"lang": langs, "phrase": names, "n": pa.array(counts, pa.int64()), "h": pa.array(hashes.view(np.int64))})


def suffix_rows(pieces: Pieces, words: Bitmap, pairs: Bitmap, depth: int) -> pa.RecordBatch:
    """Distinct suffixes of two words or more, as far as their pairs are frequent, with their number in this batch."""
    at, hashes = frequent_pairs(pieces, words)
    good = np.zeros(len(pieces) + depth, bool)
    good[at[pairs.has(hashes)]] = True
    reach = np.ones(len(pieces), np.int64)
    going = np.ones(len(pieces), bool)
    for i in range(depth - 1):
        going &= good[i : i + len(pieces)]
        reach += going
    at = np.flatnonzero(reach > 1)
    reach = reach[at]
    place, counts = [], []
    for d in range(2, depth + 1):  # suffixes that reach just so far
        own = np.flatnonzero(reach == d)
        for e, p, n in partitions(pieces.word, at[own], reach[own], pieces.lang[at[own]], d):
            if e == d:
                place.append(own[p]), counts.append(n)
    place = np.concatenate(place) if place else np.zeros(0, np.int64)
    langs = pa.array(pieces.langs, pa.string()).take(pa.array(pieces.lang[at[place]]))
    counts = pa.array(np.concatenate(counts) if counts else place, pa.int64())
    return pa.RecordBatch.from_pydict({"lang": langs, "phrase": pieces.phrases(at[place], reach[place]), "n": counts})


def _routed_counts(table: pa.Table, depth: int, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of two words or more among routed suffixes; those shorter than the route are partial."""
    phrases = table.column("phrase").combine_chunks()
    split = pc.split_pattern(phrases, " ")
    numbers = split.flatten().dictionary_encode()
    words, edges = numbers.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    reach, weight = np.diff(edges), table.column("n").to_numpy()
    langs, route = table.column("lang").combine_chunks(), table.column("route").to_numpy().astype(np.int64)
    lang = langs.dictionary_encode().indices.to_numpy().astype(np.int64)
    for own_route in np.unique(route).tolist():
        own = np.flatnonzero(route == own_route)
        for d, p, n in partitions(words, edges[:-1][own], reach[own], lang[own], depth, weight[own], least, exempt=own_route - 1):
            if d == 1:
                continue
            p = pa.array(own[p])
            heads = pc.binary_join(pc.list_slice(split.take(p), 0, d), " ")
            yield pa.RecordBatch.from_arrays([langs.take(p), heads.cast(pa.string()), pa.array(n)], ["lang", "phrase", "n"])


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of up to ``depth`` words with ``least`` occurrences, and (lang, n) of all words."""
    spark = df.sparkSession
    source = df.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    summed = lambda t, *more: t.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), *more)
    kind = "lang string, phrase string, n long"
    first = stage(summed(_over_batches(source, word_rows, f"{kind}, h long"), F.first("h").alias("h")), "phrase-words")
    totals = first.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = first.where(F.col("n") >= least)
    words = spark.sparkContext.broadcast(Bitmap.of(frequent, "h", max(1, frequent.count())))
    tokens = totals.agg(F.sum("n")).first()[0] or 0

    def pair_keys(batches):
        for batch in cut(batches, "text", TEXT_BYTES):
            yield frequent_pairs(Pieces(batch.column("text"), batch.column("lang")), words.value)[1]

    often = stage(frequent_keys(source, pair_keys, tokens, least), "phrase-pairs")
    pairs = spark.sparkContext.broadcast(Bitmap.of(often, "h", max(1, often.count())))
    suffixes = stage(summed(_over_batches(source, lambda p: suffix_rows(p, words.value, pairs.value, depth), kind)), "phrase-suffixes")
    longer = _sorted_routes(suffixes, depth, least).withColumn("words", F.size(F.split("phrase", " ")))
    return stage(frequent.select("lang", "phrase", "n", F.lit(1).alias("words")).unionByName(longer), "phrase-counts"), totals


def _lead(n: int | Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.lit(n) if isinstance(n, int) else n), " ")


def _sorted_routes(suffixes: DataFrame, depth: int, least: int) -> DataFrame:
    """Counts by sorting routed suffixes; a crowded lead is routed by one more word until it is not."""
    out = suffixes.withColumn("route", F.lit(min(ROUTE, depth)))
    for n in range(ROUTE, depth):
        crowded = suffixes.groupBy("lang", _lead(n).alias("_lead")).agg(F.count("*").alias("_size")).where(F.col("_size") > CROWD)
        crowded = stage(crowded.select(F.col("lang").alias("_lang"), "_lead", F.lit(True).alias("_crowded")), "phrase-crowds")
        if crowded.isEmpty():  # then no longer lead is crowded
            break
        joined = out.join(crowded, (F.col("lang") == F.col("_lang")) & (_lead(n) == F.col("_lead")), "left")
        out = joined.select("lang", "phrase", "n", F.when(F.col("_crowded"), n + 1).otherwise(F.col("route")).alias("route"))
    parts = max(8, -(-suffixes.count() // ROUTED))
    routed = out.repartition(parts, "lang", _lead(F.col("route")))

    def run(batches):
        held = list(batches)
        if held:
            yield from _routed_counts(pa.Table.from_batches(held), depth, least)

    return map_arrow(routed, run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, best: int = 2_000, depth: int = DEPTH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of 2 to ``depth`` words.

    A phrase with a = ``least`` occurrences or more is cut where floor(1000 * a * n / (l * r)) is lowest (l and r: the
    occurrences of its parts; ties: the first such cut).  Phrases that lie in a longer one as frequent as they are drop.
    Ties of score go to the more frequent phrase, then to the lesser in byte order.
    """
    counts, totals = phrase_counts(df, text, lang, least, depth)
    known = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    candidates = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words")

    def looked_up(t: DataFrame, part: Column, name: str) -> DataFrame:
        return t.join(known, (F.col("lang") == F.col("_lang")) & (part == F.col("_part"))).drop("_lang", "_part").withColumnRenamed("_n", name)

    split = F.split("phrase", " ")
    inside = candidates.where("words > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(split, 1, F.col("words") - 1), " "), F.array_join(F.slice(split, 2, F.col("words") - 1), " "))).alias("part"))
    inside = inside.groupBy(F.col("lang").alias("_in"), "part").agg(F.max("a").alias("_most"))
    kept = candidates.join(inside, (F.col("lang") == F.col("_in")) & (F.col("phrase") == F.col("part")), "left").where("_most IS NULL OR _most < a").select("lang", "phrase", "a", "words")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = looked_up(cuts, F.array_join(F.slice(split, F.lit(1), F.col("k")), " "), "l")
    cuts = looked_up(cuts, F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " "), "r")
    cuts = cuts.join(F.broadcast(totals.select(F.col("lang").alias("_lang"), "n")) if totals.count() <= 10_000 else totals.select(F.col("lang").alias("_lang"), "n"), F.col("lang") == F.col("_lang"))
    cuts = cuts.withColumn("score", F.expr("cast((1000BD * cast(a AS decimal(18)) * cast(n AS decimal(18))) div (cast(l AS decimal(18)) * cast(r AS decimal(18))) AS bigint)"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    heads = scored.withColumn("_head", F.pmod(F.xxhash64("phrase"), F.lit(HEADS)))
    heads = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_head").orderBy(*order))).where(F.col("rank") <= best)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
