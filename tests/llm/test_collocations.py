"""Sorted suffix pointers, bitmaps and phrase scores against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import collocations as module
from starloom.llm import keycounts
from starloom.llm.collocations import Pieces, collocations, partitions, phrase_counts


def pieces_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", lowered)]


def counted(rows, depth=5):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for p in pieces_of(text):
            totals[lang or "und"] += len(p)
            counts[lang or "und"].update(tuple(p[i : i + k]) for i in range(len(p)) for k in range(1, min(depth, len(p) - i) + 1))
    return counts, totals


def brute(rows, least, best):
    counts, totals = counted(rows)
    out = []
    for lang, f in counts.items():
        n, found = totals[lang], []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            inside = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * candidates[q] >= 100 * a for q in inside):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def made_rows(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "of", "É", "a'b", "x\xa0y", *(f"w{i}" for i in range(12))]
    common = ["new york city hall", "of the", "the the the the the the", "a b c d e f g"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(0, 30))]
        text = "".join(rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n"]) + (p.upper() if rng.random() < 0.2 else p) for p in parts)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return [*rows, ("en", None), ("en", ""), ("xx", " .,"), rows[0], rows[0]]


@pytest.mark.parametrize("least", [3, 12])
def test_matches_brute_force(spark, least):
    rows = made_rows(least)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in collocations(docs, least=least, best=20).collect())
    assert got == brute(rows, least, 20)


def test_crowded_routes_and_full_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(module, "CROWD", 2)
    monkeypatch.setattr(module, "ROUTED", 10)
    rows = made_rows(7)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(keycounts, "SHARD_KEYS", 8)
    monkeypatch.setattr(keycounts, "HELD", 40)
    monkeypatch.setattr(keycounts, "GROUP", 2)
    monkeypatch.setattr(keycounts, "FAN", 3)  # several levels
    for bits in (28, 6):  # with 64 bits all pairs pass
        monkeypatch.setattr(module, "MOST_BITS", bits)
        counts, totals = phrase_counts(docs, least=4)
        expected, words = counted(rows)
        assert {(r.lang, r.phrase): r.n for r in counts.collect()} == {(g, " ".join(p)): n for g, f in expected.items() for p, n in f.items() if n >= 4}
        assert {r.lang: r.n for r in totals.collect()} == {g: n for g, n in words.items() if n}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 5), st.integers(0, 6))
def test_partitions(words, depth, least):
    words = np.array(words, np.int64)
    n = len(words)
    reach = np.minimum(n - np.arange(n), depth)
    got = {}
    for d, places, sizes in partitions(words, np.arange(n), reach, np.zeros(n, np.int64), depth, least=least):
        for p, s in zip(places.tolist(), sizes.tolist(), strict=True):
            key = tuple(words[p : p + d].tolist())
            assert key not in got and len(key) == d
            got[key] = s
    counts = Counter(tuple(words[i : i + k].tolist()) for i in range(n) for k in range(1, min(depth, n - i) + 1))
    assert got == {k: c for k, c in counts.items() if c >= least}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB .,\t\né\xa0", max_size=12), max_size=6))
def test_pieces(texts):
    made = Pieces(pa.array(texts, pa.string()), pa.array(["x"] * len(texts), pa.string()))
    names = [n.decode() for n in made.names.to_pylist()]
    got, at = [], 0
    while at < len(made):
        got.append([names[w] for w in made.word[at : at + made.left[at]]])
        at += made.left[at]
    assert got == [p for t in texts for p in pieces_of(t) if p]


def test_odd_and_empty_tables(spark, odd_documents, no_documents):
    docs = odd_documents.withColumnRenamed("n_words", "phrase").withColumnRenamed("doc_id", "n")
    got = sorted(tuple(r) for r in collocations(docs, least=2, best=50).collect())
    assert got == brute([(r.lang, r.text) for r in odd_documents.collect()], 2, 50) and got
    assert collocations(no_documents).count() == 0
    assert collocations(no_documents).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 2**48 - 1), st.integers(1, 2**31), max_size=50))
def test_messages(counts):
    keys = np.array(sorted(counts), np.uint64)
    values = np.array([counts[k] for k in sorted(counts)], np.int64)
    got = keycounts.from_message(keycounts.to_message(keys, values))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == values.tolist()


def test_messages_grow_with_the_input(spark, monkeypatch):
    """Tasks times shards would be four times as many messages a key for four times the keys; a further level makes fewer."""
    for name, value in (("SHARD_KEYS", 64), ("HELD", 256), ("FAN", 3), ("GROUP", 4)):
        monkeypatch.setattr(keycounts, name, value)
    sent = []
    for name in ("map_arrow", "group_arrow"):
        real = getattr(keycounts, name)
        monkeypatch.setattr(keycounts, name, lambda *a, real=real: sent.append(real(*a)) or sent[-1])
    keys = lambda batches: (np.repeat((b.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16), 2) for b in batches)
    each = []
    for n in (512, 2_048):
        sent.clear()
        assert keycounts.frequent_keys(spark.range(n).repartition(n // 256), keys, 2 * n, 2).count() == n
        each.append(sum(df.count() for df in sent if "shard" in df.columns) / n)
    assert 0 < each[1] < 3 * each[0]  # measured: 2.5 times, by one level more
