from starloom.llm.contamination import find_contamination, remove_spans

ROWS = [(1, "Foo a b c d e f g h i j K bar"), (2, None), (3, ""), (None, "x, y!  z"), (None, "x, y!  z"), (4, "hello X Y z and"), (5, "ÜBER X y"), (6, "--- ")]
ITEMS = [("i1", "a B c, d e f g h i j k"), ("i2", "X y z"), ("i2", "X y z"), ("i3", None), ("i4", "!?")]


def tables(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string")


def test_windows_short_items_and_odd_rows(spark):
    docs, items = tables(spark)
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in find_contamination(docs, items).collect()]
    expected = [(1, 13, 11, ["i1"], True), (2, 0, 0, [], False), (3, 0, 0, [], False), (None, 3, 3, ["i2"], True), (None, 3, 3, ["i2"], True), (4, 5, 3, ["i2"], True), (5, 3, 0, [], False), (6, 0, 0, [], False)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_spans_are_cut_out(spark):
    docs, items = tables(spark)
    left = {r.doc_id: r.text for r in remove_spans(find_contamination(docs, items)).collect()}
    assert left[1].split() == ["Foo", "bar"] and left[4].split() == ["hello", "and"] and left[5] == "ÜBER X y" and left[2] is None and left[None] == ", !  "


def test_no_items_no_documents_clashing_names(spark, odd_documents, no_documents):
    docs, items = tables(spark)
    assert not any(r.contaminated for r in find_contamination(docs, items.limit(0)).collect())
    assert find_contamination(no_documents, items).count() == 0
    clash = odd_documents.withColumnRenamed("lang", "items").withColumnRenamed("n_words", "h")
    got = find_contamination(clash, items)
    assert got.count() == 10 and got.columns == ["doc_id", "text", "h", "n_words", "n_hit", "spans", "items", "contaminated"]


def test_shuffled_beyond_the_broadcast_bound(spark, monkeypatch):
    from starloom.llm import contamination

    docs, items = tables(spark)
    expected = sorted(map(repr, find_contamination(docs, items).collect()))
    monkeypatch.setattr(contamination, "BROADCAST_GRAMS", 0)
    assert sorted(map(repr, find_contamination(docs, items).collect())) == expected


def test_items_without_an_id_hit(spark, tmp_path):
    import duckdb

    from starloom.llm.queries import ORACLES, QUERIES

    items = [(None, "x y z"), (None, "p q"), ("i1", "p q"), (None, None), ("i2", None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "hello x y z end"), (2, "p q x y z"), (3, "q p"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op2_benchmark_decontamination"](spark, str(tmp_path)).collect())
    assert [(r[0], r[2], r[3], r[5]) for r in got] == [(1, 3, 0, True), (2, 5, 1, True), (3, 0, 0, False), (4, 0, 0, False)]
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["op2_benchmark_decontamination"]).fetchall())
