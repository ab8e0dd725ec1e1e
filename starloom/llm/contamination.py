"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all training windows.

Native DataFrame code only.  Texts lose A-Z case; words are runs of digits, lower-case letters and
non-ASCII characters.  An item's windows are its ``n`` consecutive words, or all its words where it has
fewer.  A window of a document is looked up by a 64-bit hash in the broadcast set and verified by its
words.  The set is broadcast while it has at most BROADCAST_GRAMS windows; beyond that the same join
shuffles by hash.

A document is known by its id and the hash of its text, so ids may be null or repeated; rows equal in
both get equal results.  Null, empty and wordless texts have no windows and are clean.  Items whose text is
null, empty or wordless, and repeated items, add nothing.  An item without an id hits like any other, but is not
among the named items.  With no items every document is clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried

#: Most windows of a benchmark that are broadcast (about 150 bytes each).
BROADCAST_GRAMS = 1_000_000
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = ("n_words", "n_hit", "spans", "items", "contaminated")


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWERED)


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def item_windows(items: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """(length, h, gram, items): the distinct windows of all items and who has them."""
    w = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    w = w.withColumn("length", F.least(F.size("w"), F.lit(n)))
    w = w.select("item", "w", "length", F.explode(F.expr("sequence(1, size(w) - length + 1)")).alias("i"))
    grams = w.select("item", "length", F.expr("array_join(slice(w, i, length), ' ')").alias("gram"))
    return grams.groupBy("length", "gram").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """(__id, __text, spans, items) of the documents with at least one hit."""
    found = None
    for length in lengths:
        w = docs.select("__id", "__text", F.explode_outer(F.expr(f"CASE WHEN size(__w) >= {length} THEN sequence(0, size(__w) - {length}) END")).alias("i"), "__w")
        run = [F.get("__w", F.col("i") + j) for j in range(length)]
        w = w.where("i IS NOT NULL").select("__id", "__text", "i", F.xxhash64(*run).alias("h"), F.concat_ws(" ", *run).alias("seen"))
        g = grams.where(F.col("length") == length).select(F.xxhash64(*[F.get(F.split("gram", " "), F.lit(j)) for j in range(length)]).alias("h"), "gram", "items")
        g = g.hint("broadcast") if grams._small else g
        one = w.join(g, "h").where("seen = gram").select("__id", "__text", (F.col("i") + 1).alias("first"), (F.col("i") + length).alias("last"), F.explode_outer("items").alias("item"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("__id", "__text").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    )


#: Words covered by sorted spans.
COVERED = """aggregate(spans, named_struct('n', 0L, 'end', 0),
    (a, s) -> named_struct('n', a.n + greatest(0, s.last - greatest(a.end, s.first - 1)), 'end', greatest(a.end, s.last)), a -> a.n)"""


def find_contamination(
    docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns of ``docs`` (all, if None) with n_words, n_hit, spans (first and last word, from 1), items and contaminated."""
    keep = carried(docs, keep, (*RESULT, "__id", "__text", "__w"))
    grams = item_windows(items, item_id, item_text, n).cache()
    sizes = {r["length"]: r["n"] for r in grams.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most n rows
    keyed = docs.select(*[F.col(c) for c in keep], F.col(doc_id).alias("__id"), F.xxhash64(F.col(text).cast("string")).alias("__text"), words(F.col(text)).alias("__w"))
    base = keyed.select(*keep, "__id", "__text", F.size("__w").cast("long").alias("n_words"))
    spans, named = "array<struct<first:int,last:int>>", "array<string>"
    if not sizes:
        out = base.withColumns({"spans": F.array().cast(spans), "items": F.array().cast(named)})
    else:
        grams._small = sum(sizes.values()) <= BROADCAST_GRAMS
        found = hits(keyed, grams, sorted(sizes)).select(F.col("__id").alias("__fid"), F.col("__text").alias("__ftext"), "spans", "items")
        out = base.join(found, F.col("__id").eqNullSafe(F.col("__fid")) & (F.col("__text") == F.col("__ftext")), "left")
        out = out.withColumns({"spans": F.coalesce("spans", F.array().cast(spans)), "items": F.coalesce("items", F.array().cast(named))})
    n_hit = F.expr(COVERED)
    return out.select(*keep, "n_words", n_hit.alias("n_hit"), "spans", "items", (n_hit > 0).alias("contaminated"))


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their hit words cut out of ``text``; what lies between words stays."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    pieces = F.expr(f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWERED}'), '{word}|{BETWEEN}', 0)".replace("\\", "\\\\"))
    out = found.withColumn("_pieces", pieces)
    # piece i of the lowered text has the same place and length in the text itself
    out = out.withColumn("_odd", F.expr(f"CASE WHEN get(_pieces, 0) RLIKE '^{word}' THEN 0 ELSE 1 END".replace("\\", "\\\\")))
    out = out.withColumn("_ends", F.expr("aggregate(_pieces, cast(array() as array<int>), (a, p) -> a || array(coalesce(get(a, size(a) - 1), 0) + length(p)))"))
    gone = "(i + _odd) % 2 = 0 AND exists(spans, s -> (i + _odd) DIV 2 + 1 - _odd BETWEEN s.first AND s.last)"
    kept = F.expr(f"array_join(transform(filter(sequence(0, size(_pieces) - 1), i -> NOT ({gone})), i -> substring({text}, _ends[i] - length(_pieces[i]) + 1, length(_pieces[i]))), '')")
    return out.withColumn(text, F.when(F.col("n_hit") > 0, kept).otherwise(F.col(text))).drop("_pieces", "_odd", "_ends")
