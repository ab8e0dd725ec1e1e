import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starloom.llm import maxent
from starloom.llm.language import held_out
from starloom.llm.maxent import train_and_score


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute_base(rows):
    """{row: (tokens, known, N, base)} for (text, whether trained on) rows."""
    count = Counter()
    for text, train in rows:
        if train:
            count.update([*lowered(text), None])
    total, distinct = sum(count.values()), len(count)
    out = []
    for text, _ in rows:
        words = [*lowered(text), None]
        out.append((len(words), sum(count[w] > 0 for w in words), total, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words)))
    return out


def test_base_against_brute_force_and_model_beats_it(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(6)
    out = held_out(F.col("doc_id"), 7)
    rows = train_and_score(docs.withColumn("held", out), ~out, keep=["text", "held"]).collect()
    for r, (n, known, total, base) in zip(rows, brute_base([(r.text, not r.held) for r in rows]), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base)
    held = [r for r in rows if r.held]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 2)  # the other words share the token for all others
    docs = spark.createDataFrame([("a b a c d", True), ("b a e e", True)] + [(w, False) for w in ("", "a", "b", "c", "d", "e", "unseen")], "text string, train boolean")
    got = {r.text: r.score for r in train_and_score(docs, F.col("train"), keep=["text"]).collect()}
    # of the first token: its own probability and an end after it; with all ends alike only the order of sizes is left to check
    assert got[""] < 0 and all(got[w] < 0 for w in "abcde") and got["unseen"] < got["c"] <= got["a"]


def test_a_model_is_a_distribution():
    import numpy as np

    model = maxent.Model(100, 12, 10, [(b"x", 30), (b"y", 20)])
    model.weights[:] = np.random.default_rng(0).normal(size=model.weights.shape)
    members = np.arange(maxent.CLASSES**2)
    features = np.broadcast_to(np.array([[5], [2**60], [7]], np.uint64), (3, len(members)))
    (a, *_), (b, *_) = maxent._forward(model, members, features)
    assert np.exp(a.astype(float) + b).sum() == pytest.approx(1, abs=1e-4)


def test_odd_and_empty_tables(odd_documents, no_documents):
    got = train_and_score(odd_documents, F.col("lang") == "en")
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    expected = brute_base([(r.text, r.lang == "en") for r in rows])
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [e[:3] for e in expected]
    assert [r.base_score for r in rows] == pytest.approx([e[3] for e in expected])
    assert train_and_score(no_documents, F.col("lang") == "en").count() == 0
    untrained = train_and_score(odd_documents, F.lit(None).cast("boolean")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and r.base_score == 0 for r in untrained)
