"""Bucket tables of a stream, whatever batches are run again."""

import pytest

from matchweave.streaming import prospective as st


def show(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("kind", ["tumbling", "counted"])
def test_replayed_batches_leave_the_table_unchanged(spark, tmp_path, kind):
    rows = [(k, k % 3, float(k), k * 1700) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, g long, v double, t long").selectExpr("k", "g", "v", "timestamp_seconds(t) as ts")
    parts = [df.where(f"k between {a} and {a + 49}") for a in range(0, 200, 50)]
    table = st.BucketTable(str(tmp_path / "t"))

    def keep(k):
        if kind == "tumbling":
            table.tumbling(parts[k], k, "ts", 21600, ["g"], "v")
        else:
            table.counted(parts[k], k, 7, ["g"], ["ts"], "v")

    for k in range(4):
        keep(k)
    once = show(table.table(spark, ["g"]))
    for k in (3, 1, 3):
        keep(k)
    assert show(table.table(spark, ["g"])) == once
    want = {}
    places = {}
    for k, g, v, t in rows:
        place = places[g] = places.get(g, -1) + 1
        want.setdefault((t // 21600 * 21600 if kind == "tumbling" else place // 7, g), []).append(v)
    assert once == sorted((b, g, len(x), sum(x) / len(x)) for (b, g), x in want.items())
