from collections import Counter

from helpers import sql_rows, table_rows

from matchweave.llm import mixing


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert table_rows(mixing.op9_mixing(spark, sf)) == sql_rows(mixing.OP9_SQL, sf)


def test_every_prefix_is_within_one_block():
    for slots in ({"a": 1, "b": 2, "c": 997}, {"a": 333, "b": 333, "c": 334}, {str(k): 50 for k in range(20)}, {"x": 10}):
        period, done = sum(slots.values()), Counter()
        plan = list(mixing.pfair_slots(slots))
        assert [s for _, _, s in plan] == list(range(period))
        for source, j, slot in plan:
            assert j == done[source]
            done[source] += 1
            assert all(abs(done[s] - (slot + 1) * n / period) < 1 for s, n in slots.items())


def test_shares():
    assert mixing.shares({"a": 100, "b": 1}, 10, weights={"a": 3, "b": 1}) in ({"a": 8, "b": 2}, {"a": 7, "b": 3})
    many = mixing.shares({str(k): 1 for k in range(50)} | {"big": 10**9}, 204)
    assert sum(many.values()) == 204 and min(many.values()) == 1


def test_rows_are_kept_and_mixed(spark):
    rows = [(k, "t", "hot" if k % 3 else f"s{k % 7}", 1) for k in range(600)] + [(5, "t", "hot", 1), (None, None, None, 1), (None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int")
    got = mixing.mixed(docs, weights={"hot": 0.5, "s0": 0.25}, block=4, period=100, bucket_rows=32).collect()
    assert sorted((r.doc_id or -1, r.source or "") for r in got) == sorted((r[0] or -1, r[2] or "") for r in rows)
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(got)
    place = {}
    for r in sorted(got, key=lambda r: (r.mix_slot, r.mix_place)):
        assert (r.mix_block, r.mix_place) == divmod(place.setdefault(r.source, 0), 4)
        place[r.source] += 1
    assert mixing.mixed(docs.where("false")).count() == 0


def test_clashing_columns_keep_their_values(spark):
    names = ["rank", "place", "share", "p_slot", "offset", "bucket", "key", "given", "nth", "block", "slot", "mix_source"]
    frame = spark.createDataFrame([(k, "t", "ab"[k % 2], *(100 * k + i for i in range(len(names)))) for k in range(40)], ["doc_id", "text", "source", *names])
    got = mixing.mixed(frame, block=2, period=10, bucket_rows=8)
    assert got.columns == [*frame.columns, "mix_block", "mix_slot", "mix_place"]
    assert all(r[n] == 100 * r.doc_id + i for r in got.collect() for i, n in enumerate(names))


def test_many_sources_and_rows_without_ids(spark):
    docs = spark.range(30_000).selectExpr("cast(null as long) doc_id", "string(id) text", "string(id % 15000) source")
    got = mixing.mixed(docs, block=1)
    assert got.count() == 30_000 and got.select("mix_slot", "mix_place").distinct().count() == 30_000
    assert max(mixing.shares({str(k): 1 for k in range(3000)} | {"big": 10**12}, 3500, 1.0).values()) == 500
