"""Letter-count trees and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import spelling
from starloom.llm.spelling import Tree, count_vectors, joined_crcs, near_in_leaf, spelling_variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, shortest=6, least=5, factor=5):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    n = {w: c for w, c in count.items() if len(w) >= shortest and c >= least}
    form, out = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
        out[w] = len(others)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def made_rows(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀ÷") for _ in range(rng.randrange(5, 12))) for _ in range(12)]
    words = list(base)
    for w in base:
        for _ in range(8):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]]))
    weights = [4 ** rng.randrange(0, 6) for _ in words]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([" ", "-", "1", "¿", "ā"]) + (w.upper() if rng.random() < 0.2 else w) for w in rng.choices(words, weights, k=60))
        rows.append((rng.choice([i, None]), text))
    return [*rows, (1, None), (2, ""), (3, "ÿ"), rows[0], rows[0], (4, "abcdef" * 20_000 + " tail")]


def run(df, **more):
    return sorted(tuple(r) for r in spelling_variants(df, **more).collect())


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many trees, leaves and buckets
        for name, value in (("LEAF", 6), ("BUCKET", 2), ("SAMPLE", 40), ("PAIRS", 50)):
            monkeypatch.setattr(spelling, name, value)
    rows = made_rows(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(docs) == brute(rows)
    assert run(docs, shortest=1, least=1, factor=2) == brute(rows, 1, 1, 2)


def test_one_word_in_a_third_of_all_rows_and_long_runs(spark):
    word = "abcdefgh" * 30
    rows = [(i, f"common {word} {word[:-1]}") for i in range(400)] + [(i, "commom") for i in range(6)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcé", min_size=3, max_size=5), unique=True, min_size=1, max_size=40), st.integers(3, 5))
def test_leaves_find_all_near_words(words, length):
    latin = [w.encode("latin-1") for w in words]
    points = [w for w in latin if len(w) == length]
    q, p = near_in_leaf(points, latin)
    assert sorted(zip(q.tolist(), p.tolist(), strict=True)) == sorted((i, j) for i, a in enumerate(latin) for j, b in enumerate(points) if near(a, b))


def test_boxes_are_pruned():
    rng = random.Random(1)
    words = list({"".join(rng.choice("abcdefghij") for _ in range(8)).encode() for _ in range(4_000)})
    vectors = count_vectors(words)
    tree = Tree(vectors, 16)
    who, leaf = tree.reach(vectors, True, True)
    assert len(np.unique(who * len(tree.rows) + leaf)) == len(who) < len(words) * len(tree.rows) / 4
    own, home = tree.reach(vectors, False, False)
    assert sorted(own.tolist()) == list(range(len(words))) and all(i in tree.rows[x] for i, x in zip(own.tolist(), home.tolist(), strict=True))


@given(st.binary(max_size=20), st.binary(max_size=64))
def test_joined_crcs(a, b):
    got = joined_crcs(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert int(got[0]) == zlib.crc32(a + b)


def test_odd_and_empty_tables(spark, odd_documents, no_documents):
    docs = odd_documents.withColumnRenamed("lang", "word").withColumnRenamed("n_words", "n")
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert run(docs, shortest=2, least=2) == brute(rows, 2, 2)
    assert run(no_documents) == [] and spelling_variants(no_documents).columns == ["word", "form", "root", "n", "n_near", "form_n"]
