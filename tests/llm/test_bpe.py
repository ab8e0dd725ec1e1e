"""Streaming byte-level BPE against the tokenizers library, its lookahead, and the byte-to-text machine."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import FOLDER
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starloom.llm.bpe import Codec, Merges, Text, decode_ids, encode_texts
from starloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = list("abcdeinrst'  \n\t.,!?123éßΩ中　\xa0\x1f\x85🙂") + ["'s", "'t", "'ll", "'re", " '", "<|endoftext|>", "<|endof", "\r\n", "  "]


def check(texts):
    codec = Codec.of(PATH)
    ids, counts = codec.encode(pa.array(texts, pa.string()))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        expected = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == expected
        assert codec.decode(ids[at : at + n]) == LIBRARY.decode(expected, skip_special_tokens=False)
        at += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.lists(st.sampled_from(PARTS), max_size=20).map("".join)), max_size=8))
def test_same_ids_and_texts(texts):
    check([*texts, None])


def test_every_character():
    characters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}! {c}" for c in characters]
    ids, counts = Codec.of(PATH).encode(pa.array(texts))
    made = LIBRARY.encode_batch_fast(texts, add_special_tokens=False)
    assert counts.tolist() == [len(x) for x in made] and ids.tolist() == [i for x in made for i in x.ids]


def test_long_runs_stream():
    rng = random.Random(3)
    check(["a" * 20_000, "".join(rng.choice("thein") for _ in range(40_000)), "=" * 9_000 + "-" * 7_000, "ÃÂ" * 6_000])
    codec = Codec.of(PATH)
    assert codec.merges.lookahead < 1_000
    for _ in range(60):  # small windows, cut anywhere, at the lookahead of the list
        text = "".join(rng.choice(["th", "e", "in", "=", "==", "a", "tion", "é"]) for _ in range(rng.randrange(600, 2_500))).encode()
        cuts = sorted(rng.randrange(len(text)) for _ in range(3))
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        streamed = [t for part in codec.merges.stream(iter(chunks), codec.sizes, window=8) for t in part]
        assert streamed == codec.merges.whole(text)


def small_list(seed):
    """A random merge list over two letters."""
    rng = random.Random(seed)
    made, merges = [b"a", b"b"], []
    for _ in range(12):
        u, v = rng.choice(made), rng.choice(made)
        if u + v not in made and len(u + v) < 9:
            merges.append((u, v))
            made.append(u + v)
    ids = {bytes([b]): b for b in range(256)} | {u + v: 256 + i for i, (u, v) in enumerate(merges)}
    sizes = [1] * 256 + [len(u + v) for u, v in merges]
    return Merges(merges, ids), sizes


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 400), st.text("ab", max_size=60), st.text("ab", max_size=30), st.text("ab", max_size=30))
def test_lookahead_is_sufficient(seed, shared, one, other):
    merges, sizes = small_list(seed)
    stable = []
    for rest in (one, other):
        end, out = 0, []
        for t in merges.whole((shared + rest).encode()):
            end += sizes[t]
            if end > len(shared) - merges.lookahead:
                break
            out.append(t)
        stable.append(out)
    assert stable[0] == stable[1]
    assert [t for p in merges.stream(iter([(shared + one).encode()]), sizes, window=4) for t in p] == merges.whole((shared + one).encode())


def test_lists_out_of_order_are_refused():
    ids = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257}
    with pytest.raises(ValueError):
        Merges([(b"ab", b"c"), (b"a", b"b")], ids)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=12), st.lists(st.sampled_from([b"\xf0\x9f\x99\x82", b"\xe2\x82", b"\xed\xa0", b"\xc0", b"\xe0\x80", b"a", b"\xf4\x90", b"\xc3", b"\xa9"]), max_size=8).map(b"".join)))
def test_text_machine(data):
    text = Text()
    out = ""
    for i in range(len(data)):
        out += text.feed(data[i : i + 1])
        assert len(text.held) <= 3
    assert out + text.close() == data.decode("utf-8", "replace")


def test_odd_and_empty_tables(spark, odd_documents, no_documents):
    docs = odd_documents.withColumnRenamed("lang", "Ids").withColumnRenamed("n_words", "n_tokens")
    encoded = encode_texts(docs, PATH)
    assert encoded.columns == ["doc_id", "text", "ids", "n_tokens"]
    rows = decode_ids(encoded, PATH).collect()
    assert len(rows) == 10 and all(r.decoded == (r.text or "") and r.n_tokens * 4 == len(r.ids) for r in rows)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == LIBRARY.encode(r.text or "", add_special_tokens=False).ids for r in rows)
    assert decode_ids(encode_texts(no_documents, PATH), PATH).count() == 0
    assert decode_ids(spark.createDataFrame([(None,)], "ids binary"), PATH).first().decoded is None


def test_query(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_bpe_stream"](spark, FOLDER).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert got[doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
