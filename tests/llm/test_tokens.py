"""Token ids, records and packing: exact against the tokenizer, exact round trip."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starloom.llm import packing
from starloom.llm.packing import hilbert, pack_documents
from starloom.llm.records import crc32c, frame, read_records, unframe, write_records
from starloom.llm.tokens import Encoder, with_end

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abZ'strevmld.,;:!?<|>éÀßΣİ́ \n\t\x1c\xa0«½12中", max_size=25), max_size=5))
def test_encoder_equals_the_tokenizer(texts):
    texts = [*texts, None, "x<|endoftext|>Y <|ENDOFTEXT|>. end.'s"]
    ids, counts = Encoder.of(PATH).encode(pa.array(texts, pa.string()))
    at = np.cumsum([0, *counts])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == ids_of(texts)


def test_encoder_of_another_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, counts = Encoder.of(path).encode(pa.array(["Hello  world", None, "a\nb"]))
    expected = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in ("Hello  world", "", "a\nb")]
    assert ids.tolist() == sum(expected, []) and counts.tolist() == [len(x) for x in expected]


def slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert slow_crc(b"123456789") == 0xE3069283
    data = np.random.default_rng(0).integers(0, 256, 3_000).astype(np.uint8)
    start, stop = np.array([0, 5, 100, 3, 50, 7]), np.array([0, 6, 356, 260, 1000, 2_990])
    assert crc32c(data, start, stop).tolist() == [slow_crc(data[a:b].tobytes()) for a, b in zip(start, stop, strict=True)]


def test_frames_round_trip_and_damage():
    ids, counts = with_end(np.arange(700, dtype=np.uint32), np.array([0, 300, 400]), 1)
    data, offset = frame(ids, counts, np.array([7, 0, -3]), np.array([True, False, True]), 2)
    got_ids, known, got_counts, tokens = unframe(data, offset[::-1])
    assert got_ids.tolist() == [-3, 0, 7] and known.tolist() == [True, False, True] and got_counts.tolist() == [401, 301, 1]
    assert np.concatenate(tokens[::-1]).tolist() == ids.tolist()
    for at in (3, int(offset[1]) + 40):
        broken = data.copy()
        broken[at] ^= 1
        with pytest.raises(ValueError):
            unframe(broken, offset)


def test_records_come_back_in_order(spark, odd_documents, no_documents, tmp_path):
    got = read_records(write_records(odd_documents, f"file://{tmp_path}/a", PATH), f"file://{tmp_path}/a").orderBy("start").collect()
    assert len(got) == 10 and [r.doc_id for r in got] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7]
    by_id = {r.doc_id: r.text for r in odd_documents.collect()}
    start = 0
    for r in got:
        (expected,) = ids_of([by_id[r.doc_id]])
        assert np.frombuffer(r.ids, "<u4").tolist() == [*expected, 1] and r.start == start and r.n_tokens == len(expected) + 1
        start += r.n_tokens
    assert {p.suffix for p in (tmp_path / "a").iterdir()} == {".rec", ".idx"}
    assert read_records(write_records(no_documents, f"file://{tmp_path}/b", PATH), f"file://{tmp_path}/b").count() == 0


def test_hilbert_curve_visits_each_cell_once_by_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def check_packing(docs, length):
    rows = docs.collect()
    pieces = pack_documents(docs, PATH, length=length).collect()
    sequences, texts = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(p.ids) >= 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        texts.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids.tolist()))
    for s, parts in sequences.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or s == max(sequences) and at < length
    assert sorted(sequences) == list(range(len(sequences)))
    expected = [[*x, 1] for x in ids_of([r.text for r in rows])]
    assert sum(p.length for p in pieces) == sum(map(len, expected))
    if len({r.doc_id for r in rows}) == len(rows):
        for r, ids in zip(rows, expected, strict=True):
            assert sum((x for _, x in sorted(texts[r.doc_id, len(ids)])), []) == ids


def test_packing_puts_every_id_once(spark, folder, odd_documents, no_documents, monkeypatch):
    check_packing(odd_documents, 64)
    monkeypatch.setattr(packing, "RANGE_TOKENS", 5_000)  # many ranges
    check_packing(spark.read.parquet(f"{folder}/documents.parquet"), 2048)
    check_packing(spark.createDataFrame([(i, "same text") for i in range(300)], "doc_id long, text string").repartition(3), 16)
    assert pack_documents(no_documents, PATH).count() == 0


def test_neighbours_on_the_curve_are_alike(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    order = [lang[p.doc_id] for p in sorted(pack_documents(docs, PATH).collect(), key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    rng = np.random.default_rng(0)
    mixed = np.mean([np.mean([a == b for a, b in zip(x[:-1], x[1:], strict=True)]) for x in (rng.permutation(order) for _ in range(20))])
    assert np.mean([a == b for a, b in zip(order[:-1], order[1:], strict=True)]) > mixed + 0.1


def test_weights_of_a_table_are_those_of_the_ids():
    draw = np.random.default_rng(7)
    ids = draw.integers(1, 50_000, 3_000).astype(np.uint32)
    counts = np.array([1, 999, 2_000])
    keys = packing.curve_keys(ids, counts)
    for i, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
        assert packing.curve_keys(part, counts[i : i + 1])[0] == keys[i]
    squares, signed = packing.weights(ids)
    table = packing.weight_table(1 << 16)
    assert (table[0][ids] == squares).all() and (table[1][:, ids] == signed).all()


def test_ranges_are_bounded(spark, folder, monkeypatch):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = lambda: sorted((r["doc_id"], r["start"], r["sequence_id"], r["offset"]) for r in packing.pack_documents(documents, path).collect())
    one = ids()
    monkeypatch.setattr(packing, "RANGE_TOKENS", 100)
    monkeypatch.setattr(packing, "MAX_RANGES", 5)
    assert ids() == one
