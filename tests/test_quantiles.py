"""Exact quantiles against numpy, with ties, nulls, groups and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.operators import history, metrics

POINTS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("partitions", ["1", "8", "61"])
def test_equal_to_numpy(spark, partitions):
    rng = np.random.default_rng(4)
    group = rng.choice(["a", "b", "c"], 4000, p=[0.7, 0.29, 0.01])
    value = np.where(rng.random(4000) < 0.3, 1.25, rng.normal(size=4000).round(2))
    rows = [(g, None if k % 11 == 0 else float(v)) for k, (g, v) in enumerate(zip(group, value))] + [("none", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        whole = metrics.quantiles(df, "v", POINTS).first().q
        held = {r.g: r.q for r in metrics.quantiles(df.where("g is not null"), F.col("v") * 1, POINTS, ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], POINTS), abs=1e-12)
    assert sorted(held) == ["a", "b", "c"]
    for g, q in held.items():
        assert q == pytest.approx(np.quantile([v for x, v in rows if x == g and v is not None], POINTS), abs=1e-12)


def test_no_rows_give_nulls(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert metrics.quantiles(df, "v", [0.1, 0.9]).first().q == [None, None]
    assert metrics.quantiles(df, "v", [0.1, 0.9], ["g"]).count() == 0


def test_recent_mean_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(k // 3) * 86400 * 5, k % 2, None if k % 7 == 0 else int(g), int(h)) for k, (g, h) in enumerate(rng.integers(0, 5, (400, 2)))]
    df = spark.createDataFrame(rows, "fixture_id long, unix long, competition_id long, home_goals long, away_goals long")
    got = {r.fixture_id: r.league_recent for r in history.recent_league_mean(df, last=20).collect()}
    assert len(got) == len(rows)
    for c in (0, 1):
        mine = sorted((r for r in rows if r[2] == c), key=lambda r: (r[1], r[0]))
        for k, r in enumerate(mine):
            past = [x[3] + x[4] for x in mine[max(0, k - 20) : k] if x[3] is not None]
            assert got[r[0]] == pytest.approx(max(np.mean(past), 0.5) if past else 0.5)


def test_a_quantile_between_equal_values_is_that_value(spark):
    """Weights of two ranks that don't sum to one exactly would leave the value by its last digit."""
    rows = spark.createDataFrame([(n, v) for n in range(2, 40) for v in [1 / 6] * n], "n long, v double")
    points = [0.05 * k for k in range(1, 20)]
    assert {x for r in metrics.quantiles(rows, "v", points, ["n"]).collect() for x in r.q} == {1 / 6}
