import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import trie
from starloom.llm.trie import BYTE_SCORE, START, Trie, count_texts, count_tokens, piece_scores

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCORES = piece_scores(PATH)


def brute_word(word, scores):
    text = START + word
    best = [(0, 0)]
    for end in range(1, len(text) + 1):
        spelled = len(text[end - 1].encode())
        options = [(best[end - 1][0] + spelled * BYTE_SCORE, -(-best[end - 1][1] + spelled))]
        options += [(best[a][0] + scores[text[a:end]], best[a][1] - 1) for a in range(end) if text[a:end] in scores]
        best.append(max(options))
    return -best[-1][1], best[-1][0]


def brute(text, scores):
    words = (text or "").encode().split()
    made = [brute_word(w.decode(), scores) for w in words]
    return len(words), sum(t for t, _ in made), sum(s for _, s in made)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abcthesinr ▁é中\U0001f600\n\x1c\xa0", max_size=20), max_size=5))
def test_counts_against_brute_force(texts):
    got = count_texts(pa.array(texts, pa.string()), Trie.of(PATH))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [brute(t, SCORES) for t in texts]


def test_ties_take_fewest_tokens():
    scores = {START: -1, "a": -1, "b": -1, "ab": -2}
    assert Trie(scores).counts(["ab"])[0].tolist() == [2]


def test_shared_prefixes_are_scored_once():
    own = Trie(SCORES)
    own.counts(["reading", "reader", "read", "reading"])
    assert len(own.best) == 1 + len({w[:i] for w in ("reading", "reader") for i in range(1, len(w) + 1)})


def test_tables(spark, folder, odd_documents, no_documents, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    for r in count_tokens(docs, PATH).collect():
        assert (r.n_words, r.n_tokens, r.score) == brute(r.text, SCORES)
    got = count_tokens(odd_documents, PATH)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_tokens", "score"] and got.count() == 10
    assert all(r.n_tokens == 0 for r in got.collect() if r.doc_id in (2, 3, 4)) and count_tokens(no_documents, PATH).count() == 0
    monkeypatch.setattr(trie, "MAX_NODES", 5)
    small = Trie(SCORES)
    assert [small.counts([w])[0].tolist() for w in ("hello", "world", "hello")] == [[brute_word(w, SCORES)[0]] for w in ("hello", "world", "hello")]
