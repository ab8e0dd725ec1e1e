"""Fingerprints, keys and components against brute force."""

import numpy as np
import pyarrow as pa
import xxhash

from starloom.llm import simhash
from starloom.llm.simhash import decode, fingerprint, join_keys, link_shard, link_shard_by_middle, near_duplicates, one_of_each


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest position reachable, for each position."""
    root = list(range(len(prints)))
    for _ in prints:
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if (p ^ q).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def near_words(rng, n, seeds, most):
    base = rng.integers(0, 2**63, seeds, dtype=np.uint64)
    out = base[rng.integers(0, seeds, n)]
    for i in range(n):
        for b in rng.integers(0, 64, rng.integers(0, most + 1)):
            out[i] ^= np.uint64(1) << np.uint64(b)
    return out


def test_every_word_is_within_three_bits_of_its_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 5_000)
    codewords = np.array([w for w in range(0, 1 << 23, 1 << 11)], np.int64)
    codewords |= simhash._syndrome(codewords)
    assert len(set(codewords.tolist())) == 4096 and not simhash._syndrome(codewords).any()
    assert (np.bitwise_count(words ^ codewords[decode(words)]) <= 3).all()


def test_near_fingerprints_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 3_000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b), dtype=np.uint64)
    keys = []
    for prints in (a, b):
        own = [set() for _ in prints]
        for row, key in zip(*join_keys(prints), strict=True):
            own[row].add(key)
        keys.append(own)
    assert all(x & y for x, y in zip(*keys, strict=True))


def roots(prints, links):
    forest = simhash.Forest(len(prints))
    at = {int(p): i for i, p in enumerate(prints)}
    for a, b in links:
        forest.join(at[int(a)], at[int(b)])
    return [forest.find(i) for i in range(len(prints))]


def test_links_connect_what_brute_force_connects(monkeypatch):
    prints = np.unique(near_words(np.random.default_rng(3), 200, 12, 5))
    row, key = join_keys(prints)
    a, b, crowd = link_shard(prints[row], key, 4)
    expected = brute_components([int(p) for p in prints])
    assert not len(crowd) and roots(prints, zip(a, b, strict=True)) == expected
    monkeypatch.setattr(simhash, "CROWD", 3)  # the exact way for crowded keys
    a, b, crowd = link_shard(prints[row], key, 4)
    assert len(crowd)
    middles = (crowd[:, None] ^ simhash.ball(2)[None, :]).ravel()
    c, d = link_shard_by_middle(np.repeat(crowd, 2081), middles, 4)
    assert roots(prints, [*zip(a, b, strict=True), *zip(c, d, strict=True)]) == expected


def test_fingerprints_of_odd_texts(odd_documents):
    texts = [r.text for r in odd_documents.collect()]
    assert [int(x) for x in fingerprint(pa.array(texts), 4)] == [brute_print(t) for t in texts]


def test_query_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected_prints = [(r.doc_id, brute_print(r.text)) for r in docs.orderBy("doc_id").collect()]
    root = brute_components([p for _, p in expected_prints])
    expected = {(i, f"{p:016x}", expected_prints[r][0]) for (i, p), r in zip(expected_prints, root, strict=True)}
    assert {tuple(r) for r in near_duplicates(docs, keep=["doc_id"]).drop("component_print").collect()} == expected


def test_odd_and_empty_tables(odd_documents, no_documents):
    got = near_duplicates(odd_documents)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "fingerprint", "component_id", "component_print"] and got.count() == 10
    by_text = {(r.text, r.component_id) for r in got.collect()}
    assert (None, 2) in by_text and ("", 2) in by_text and ("no id here, but words", None) in by_text
    left = one_of_each(got).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 1, 2, 5, 6, 7] and one_of_each(got).columns == odd_documents.columns
    assert near_duplicates(no_documents).count() == 0
    clash = odd_documents.withColumnRenamed("lang", "print").withColumnRenamed("n_words", "root")
    assert near_duplicates(clash).count() == 10


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["print"]: r["root"] for r in simhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500
