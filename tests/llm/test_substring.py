"""Windows, sketches and removal against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import substring
from starloom.llm.common import Words
from starloom.llm.substring import Windows, dedup_substrings


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def made_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(5, 30))] for _ in range(4)]
    texts = []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = rng.choice(passages)
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    return [*texts, texts[0], None, "", " \t", "é\xa0b c"]


def test_matches_brute_force(spark):
    texts = made_texts(1, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    for window in (1, 8, 12):
        got = {r.id: (r.n_words, r.n_removed, r.kept) for r in dedup_substrings(docs, window=window, keep=["id"]).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, window)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=12), max_size=6))
def test_words_are_bytes_between_white_space(texts):
    words = Words(pa.array(texts, pa.string()))
    expected = [t.encode().split() for t in texts]
    assert words.counts.tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    assert words.bytes_of(np.arange(len(words))) == flat
    hashes = words.hashes().tolist()
    assert len(set(hashes)) == len(set(flat)) and all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_sketch_never_underestimates(monkeypatch):
    monkeypatch.setattr(substring, "CELL_BITS", 6)  # so few counters that most collide
    texts = made_texts(2, 80)
    blocks = [Windows(pa.array(texts[i::4], pa.string()), 10) for i in range(4)]
    messages = [dict(substring.block_sketch(b, 2)) for b in blocks]
    answers = [{} for _ in blocks]
    for s in (0, 1):
        senders = [i for i, m in enumerate(messages) if s in m]
        for i, body in zip(senders, substring.merge_sketches([messages[i][s] for i in senders]), strict=True):
            answers[i][s] = body
    count = Counter(tuple(w[i : i + 10]) for t in texts for w in [(t or "").encode().split()] for i in range(len(w) - 9))
    for b, a in zip(blocks, answers, strict=True):
        estimated = set(substring.estimated(b, a, 2).tolist())
        flat = b.words.bytes_of(np.arange(len(b.words)))
        assert all(i in estimated for i in np.flatnonzero(b.whole).tolist() if count[tuple(flat[i : i + 10])] > 1)


def test_odd_and_empty_tables(odd_documents, no_documents):
    got = dedup_substrings(odd_documents)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_removed", "kept"]
    rows = got.collect()
    assert len(rows) == 10 and all(r.n_removed == r.n_words == 30_000 for r in rows if r.doc_id == 5)
    assert all(r.n_removed == 0 for r in rows if r.doc_id != 5) and all(r.kept == "" for r in rows if r.text is None)
    assert dedup_substrings(no_documents).count() == 0
    assert dedup_substrings(odd_documents.withColumnRenamed("lang", "block"), window=3).count() == 10


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_whose_polynomials_are_equal_differ(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    words = Words(pa.array([f"{one} {other}"]))
    assert len(set(words.hashes().tolist())) == 2
    rest = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}")], "id long, text string")
    assert [r.n_removed for r in dedup_substrings(docs, window=35, keep=["id"]).collect()] == [0, 0]
    rows = [" ".join(x for x in (one, other)[i % 2 : i % 2 + 1] for _ in range(35)) for i in range(2)]
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    assert [r.n_removed for r in dedup_substrings(docs, window=35, keep=["id"]).collect()] == [0, 0]


def test_sketch_counts_many_anchors_of_one_cell(monkeypatch):
    monkeypatch.setattr(substring, "CELL_BITS", 1)
    block = Windows(pa.array([" ".join(f"w{i}" for i in range(3_000))]), 10)
    body = dict(substring.block_sketch(block, 1))[0]
    answer = substring.merge_sketches([body])[0]
    assert len(substring.estimated(block, {0: answer}, 1)) == 2_991  # some hundreds of anchors share each cell
