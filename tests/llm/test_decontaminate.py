from helpers import sql_rows, table_rows

from matchweave.llm import decontaminate


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert table_rows(decontaminate.op6_decontaminate(spark, sf)) == sql_rows(decontaminate.OP6_SQL, sf)


def test_shuffled_path_and_odd_texts(spark):
    item = "Alpha beta gamma delta Épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    items = spark.createDataFrame(
        [(1, item, 5), (2, "two words", 5), (3, None, 5), (4, " ,", 5), (10, item, 5), (5, "same same same", 5)],
        "item_id long, text string, n int",
    )
    docs = [
        (1, None), (2, ""), (3, item.upper().replace("É", "é")), (4, item), (5, "x " + item.replace(" ", "--") + " y two, WORDS"),
        (6, "same " * 9), (7, "nothing here"), (7, "two words"), (8, item[:-3] + "q " + "w " * 3_000 + item), (9, item.rsplit(" ", 4)[0]),
        (11, "two words " * 3 + "z " * 500),
    ]
    frame = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, word string, pos int")
    narrow = table_rows(decontaminate.contamination(frame, items))
    wide = table_rows(decontaminate.contamination(frame, items, broadcast_windows=0))
    assert narrow == wide
    unique = frame.where("doc_id != 7")
    want = sql_rows(decontaminate.OP6_SQL, documents=unique.toPandas(), benchmark=items.toPandas())
    assert table_rows(decontaminate.contamination(unique, items)) == want
    sevens = [r for r in decontaminate.contamination(frame, items).collect() if r.doc_id == 7]
    assert sorted(r.n_hit for r in sevens) == [0, 2]


def test_both_ways_agree_on_a_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    narrow, wide = (table_rows(decontaminate.contamination(docs, items, broadcast_windows=n)) for n in (50_000, 0))
    assert narrow == wide and len(narrow) == docs.count()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate.contamination(docs.where("false"), items).count() == 0
    got = decontaminate.contamination(docs, items.where("false")).collect()
    assert [(r.n_hit, r.contaminated) for r in got] == [(0, False)] * 2
    assert {(r.doc_id, r.contaminated) for r in decontaminate.contamination(docs, items).collect()} == {(1, True), (None, True)}
