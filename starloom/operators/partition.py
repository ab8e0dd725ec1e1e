"""Columns that map one-to-one onto each other, found by signatures of the row partitions they make.

A column splits the rows into classes of equal values (missing ones are a class).  A class is known by its rows'
hashes: the least one stands for it, with the largest, their sum and their number.  A column's
signature adds up its classes without order, so two columns that split the rows alike have equal signatures, whatever
their values are.  Only columns with equal signatures are verified, each against the first of its set.

Columns that miss values in different rows are compared where both are present, which no signature of one column
shows.  A bounded sample of rows refutes such pairs exactly: two rows in which one value of a column meets two of the other.  Pairs
that no sampled row refutes are verified.  Every step is one scan, however many columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import name
from .aggregate import _storage, long_values

# Rows that refute pairs.
SAMPLE = 2_000


def row_hash(df: DataFrame, columns: list[str]) -> str:
    """SQL of a hash of a row's content; rows equal in all columns are in the same classes anyway."""
    return f"xxhash64({', '.join(f'CAST({name(c)} AS {_storage(df.schema[c].dataType)[1]})' for c in columns)})"


# The sum of hashes, which equal rows don't cancel out of.
SUMMED = "sum(CAST(__h AS DECIMAL(20)))"


def signatures(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """By column: (levels, number of NULLs, sum of their rows' hashes, exclusive or of the classes' hashes)."""
    keyed = df.selectExpr(f"{row_hash(df, columns)} AS __h", *map(name, columns))
    rows = long_values(keyed, columns, ["__h"])
    fields = [c for c in rows.columns if c not in ("__h", "__f")]
    per_class = rows.groupBy("__f", *fields).agg(F.min("__h").alias("a"), F.max("__h").alias("b"), F.expr(SUMMED).alias("x"), F.count("*").alias("n"))
    found = per_class.groupBy("__f").agg(F.count("*").alias("levels"), F.bit_xor(F.xxhash64("a", "b", "x", "n")).alias("classes")).collect()
    absent = ", ".join(f"struct({i} AS f, {name(c)} IS NULL AS p)" for i, c in enumerate(columns))
    masks = keyed.selectExpr("__h", f"inline(array({absent}))").where("p").groupBy("f").agg(F.count("*").alias("n"), F.expr(SUMMED).alias("m")).collect()
    missing = {r["f"]: (r["n"], r["m"]) for r in masks}
    return {columns[r["__f"]]: (r["levels"], *missing.get(r["__f"], (0, 0)), r["classes"]) for r in found}


def _text(df: DataFrame, c: str) -> str:
    kind = _storage(df.schema[c].dataType)[1]
    return f"CAST(CAST({name(c)} AS {kind}){' + 0.0D' if kind == 'double' else ''} AS STRING)"


def verified(df: DataFrame, pairs: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """Those pairs in which no value of either column meets two of the other, in one scan; value pairs are deduplicated as narrow rows."""
    if not pairs:
        return set()
    entries = ", ".join(f"struct({i} AS p, {_text(df, a)} AS a, {_text(df, b)} AS b)" for i, (a, b) in enumerate(pairs))
    rows = df.selectExpr(f"inline(array({entries}))").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    sides = rows.selectExpr("p", "inline(array(struct(0 AS side, a AS v), struct(1 AS side, b AS v)))")
    twice = sides.groupBy("p", "side", "v").agg(F.count("*").alias("n")).where("n > 1").select("p").distinct()
    met = rows.select("p").distinct().join(twice, "p", "left_anti")
    return {pairs[r["p"]] for r in met.collect()}


def unrefuted(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Pairs that no two rows of a bounded sample (those of least hash) refute."""
    columns = sorted({c for p in pairs for c in p})
    if not columns:
        return []
    rows = df.selectExpr(f"{row_hash(df, columns)} AS __h", *[f"{_text(df, c)} AS {name(c)}" for c in columns]).orderBy("__h").limit(SAMPLE).collect()
    values = {c: [r[c] for r in rows] for c in columns}
    out = []
    for a, b in pairs:
        there, back = {}, {}
        if all(x is None or y is None or (there.setdefault(x, y) == y and back.setdefault(y, x) == x) for x, y in zip(values[a], values[b], strict=True)):
            out.append((a, b))
    return out


def one_to_one_pairs(df: DataFrame, columns: list[str]) -> list[tuple[str, str]]:
    """Pairs of columns, with equally many values and more than one, whose values determine each other wherever both are present."""
    found = {c: s for c, s in signatures(df, columns).items() if s[0] > 1}
    order = [c for c in columns if c in found]
    place = {c: i for i, c in enumerate(order)}
    alike: dict[tuple, list[str]] = {}
    for c in order:
        alike.setdefault(found[c], []).append(c)
    sets, todo = [], [members for members in alike.values() if len(members) > 1]
    while todo:  # again only where different partitions share a signature
        true = verified(df, [(m[0], c) for m in todo for c in m[1:]])
        following = []
        for m in todo:
            sets.append([m[0], *(c for c in m[1:] if (m[0], c) in true)])
            rest = [c for c in m[1:] if (m[0], c) not in true]
            following += [rest] if len(rest) > 1 else []
        todo = following
    pairs = {(a, b) for s in sets for i, a in enumerate(s) for b in s[i + 1 :]}
    mixed = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if found[a][0] == found[b][0] and found[a][1:3] != found[b][1:3]]
    pairs |= verified(df, unrefuted(df, mixed))
    return sorted(pairs, key=lambda p: (place[p[0]], place[p[1]]))
