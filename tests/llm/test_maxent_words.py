"""Words outside the head have probabilities of their own in each context, and those of a context sum to one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import maxent
from starloom.llm.maxent import train_and_score


def test_other_words_follow_their_contexts(spark, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 2)  # x and y
    pairs = [("red", "apple"), ("blue", "river"), ("green", "stone"), ("pale", "cloud")]
    docs = [(f"x y {a} {b}", True) for a, b in pairs for _ in range(200)]
    asked = [f"{a} {b}" for a, _ in pairs for _, b in pairs]
    df = spark.createDataFrame(docs + [(t, False) for t in asked], "text string, train boolean").repartition(6)
    got = {r.text: r.score for r in train_and_score(df, F.col("train"), keep=["text"]).collect()}
    for a, b in pairs:  # all other words have the same count, so that only contexts tell them apart
        others = [got[f"{a} {c}"] for _, c in pairs if c != b]
        assert got[f"{a} {b}"] > max(others) + 0.3


def model_with_tree(words: list[bytes], counts: list[int], head: int):
    import pyarrow as pa

    ranked = sorted(zip(words, counts, strict=True), key=lambda x: -x[1])
    mass: dict[int, int] = {}
    for leaf, n in zip(maxent.leaves(maxent.Words(pa.array(words, pa.binary())).hashes()).tolist(), counts, strict=True):
        mass[leaf] = mass.get(leaf, 0) + n + 1
    return maxent.Model(sum(counts), len(words), 10, ranked[:head], mass), ranked[head:]


def test_the_tree_is_a_distribution():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, 3000).tolist()
    model, others = model_with_tree([f"w{i}".encode() for i in range(3000)], counts, 40)
    assert model.leaf_mass.sum() == sum(n + 1 for _, n in others) == model.rest_tokens + model.rest_words
    leaf = maxent.leaves(maxent.Words(pa.array([w for w, _ in others], pa.binary())).hashes())
    shares = np.array([n + 1 for _, n in others]) / model.leaf_mass[leaf]
    for weights in (np.zeros(maxent.NODE_BUCKETS), rng.normal(size=maxent.NODE_BUCKETS)):
        model.nodes[:] = weights
        features = np.broadcast_to(np.array([[5], [2**60], [7]], np.uint64), (3, len(leaf)))
        way = np.exp(maxent.descend(model, leaf, features)[0]) * shares
        assert way.sum() == pytest.approx(1, abs=1e-4)
        if not weights.any():  # without training, a word's share of all counts
            assert way == pytest.approx(np.array([n + 1 for _, n in others]) / model.leaf_mass.sum(), rel=1e-3)
