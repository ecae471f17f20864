import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from matchweave.functions import probability, text
from matchweave.sources import ledger
from pyspark.sql import functions as F


def test_pages_to_records(spark, tmp_path):
    page = {"data": [{"id": 1, "stats": {"xg": 0.5}}, {"id": None, "stats": None}], "info": {"page": 1, "next_page_url": "http://x?api_token=s3cret&p=2"}}
    (tmp_path / "a.json").write_text(json.dumps(page, indent=1))
    record = T.StructType([T.StructField("id", T.LongType()), T.StructField("stats", T.StructType([T.StructField("xg", T.DoubleType())]))])
    pages = ledger.read_pages(spark, str(tmp_path), record)
    assert pages.first().next_page_url == "http://x?api_token=REDACTED&p=2"
    rows = ledger.with_missing(ledger.records(pages), ["id", "stats.xg"], F.col("stats").isNull())
    good, bad = ledger.split_rejects(rows, "id")
    assert good.first().missing_fields == [] and good.first().is_complete
    assert bad.first().missing_fields == ["id", "stats", "stats.xg"] and bad.first().missing_field_count == 3


def test_partitions_reconcile(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 5).alias("competition_id"), "id")
    ledger.write_partitioned(rows, str(tmp_path / "t"), ["competition_id"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {r.competition_id: r["count"] for r in back.groupBy("competition_id").count().collect()} == {k: 20 for k in range(5)}


def test_mixed_versions_fail(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, version string")
    with pytest.raises(PySparkException):
        ledger.one_version(rows, "version").collect()


def test_text_functions(spark):
    rows = spark.createDataFrame([("2 - 1", "nan", "Él Niño FC", "2024-01-02T03:04:05Z"), ("x", "3.5", None, "1704164645"), (None, "", "a", "junk")], "s string, n string, name string, t string")
    got = rows.select(
        text.score_part(F.col("s"), 0).alias("h"), text.safe_number(F.col("n")).alias("n"), text.fold_name(F.col("name"), ("fc",)).alias("name"), F.unix_timestamp(text.to_utc(F.col("t"))).alias("t")
    ).collect()
    assert [tuple(r) for r in got] == [(2, None, "elnino", 1704164645), (None, 3.5, None, 1704164645), (None, None, "a", None)]


def test_probability_edges(spark):
    row = spark.range(1).select(
        probability.power_devig(F.lit(3.0), F.lit(3.0), F.lit(3.0))[1].alias("fair"), probability.power_devig(F.lit(1.0), F.lit(3.0), F.lit(3.0))[1].alias("bad"),
        probability.temperature([F.lit(0.5), F.lit(0.3), F.lit(0.2)], 1.0)[0].alias("same"), probability.normalized(F.lit(0.0), F.lit(0.0), F.lit(-1.0))[0].alias("third"),
        probability.wilson(F.lit(0), F.lit(10))[0].alias("low"),
    ).first()
    assert row.fair == pytest.approx(1.0) and row.bad is None and row.same == pytest.approx(0.5) and row.third == pytest.approx(1 / 3) and row.low == 0
