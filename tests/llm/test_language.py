import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from starloom.llm.language import Filters, grams, held_out, identify, learn


def test_grams_stay_in_their_text():
    keys, counts = grams(pa.array(["AB", None, "", "é"]))
    assert counts.tolist() == [3, 1, 1, 3]
    assert [k.tobytes() for k in keys[:4].astype("<u4")] == [b"  ab", b" ab ", b"ab  ", b"    "]


def test_filter_holds_all_added_and_rates_are_its_false_positives():
    filters = Filters([f"l{i:02}" for i in range(70)], 12)  # two planes of masks
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**32, 300, dtype=np.uint32)
    filters.add(3, keys), filters.add(69, keys[:100])
    hits = filters.hits(keys, np.array([100, 200]))
    assert hits[0, 3] == 100 and hits[1, 3] == 200 and hits[0, 69] == 100 and hits[:, 5].sum() == 0
    other = filters.hits(rng.integers(0, 2**32, 100_000, dtype=np.uint32), np.array([100_000]))[0, 3] / 100_000
    assert abs(other - filters.rates()[3]) < 0.003


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = held_out(F.col("doc_id"), 4)
    found = identify(docs, learn(docs.where(~out)), keep=["doc_id", "lang"]).where(out)
    right, all_rows, low, high = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right / all_rows > 0.97 and 0 <= low and high <= 1


def test_odd_and_empty_tables(odd_documents, no_documents):
    filters = learn(odd_documents)
    assert filters.languages == ["de", "en", "xx"]
    got = identify(odd_documents.withColumnRenamed("n_words", "score"), filters)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == 10 and {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 7)} == {"und"} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in rows if r.doc_id == 6} == {"de"}
    nothing = learn(no_documents)
    assert identify(no_documents, filters).count() == 0 and {r.lang_pred for r in identify(odd_documents, nothing).collect()} == {"und"}
