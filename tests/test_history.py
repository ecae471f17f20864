"""Hand-computed windows, and what later contests must not change."""

import pytest
from pyspark.sql import functions as F

from matchweave.operators import history
from matchweave.sources.bindings import contests

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "fixture_id long, unix long, home_id long, away_id long, competition_id long, season_id long, status string, home_goals long, away_goals long,"
    " home_xg double, away_xg double, home_shots long, away_shots long, home_shots_on long, away_shots_on long"
)


def contest(fixture, unix, home, away, score=None, status="FT", season=1):
    gh, ga = score or (None, None)
    return (fixture, unix, home, away, 1, season, status, gh, ga, None, None, 5, 5, 2, 2)


def test_gates_and_windows(spark):
    rows = [contest(k, 100 * k, 1, 2, (k % 3, 1)) for k in range(1, 8)] + [contest(8, 800, 1, 2, None, "NS"), contest(9, 900, 1, 2, (1, 0), season=2)]
    found = history.rolling_features(spark.createDataFrame(rows, SCHEMA), stats=("goals",))
    team1 = {r.fixture_id: r for r in found.where("team_id = 1").collect()}
    assert team1[3].goals_for_last5 is None and team1[3].goals_for_last5_coverage == 2
    assert team1[4].goals_for_last5 == pytest.approx((1 + 2 + 0) / 3)
    assert team1[8].seen == 7 and team1[8].goals_for_last5 == pytest.approx((0 + 1 + 2 + 0 + 1) / 5)
    assert team1[9].goals_for_season is None and team1[9].n_last5 == 5


def test_ties(spark):
    rows = [contest(1, 100, 1, 2, (3, 0)), contest(2, 200, 1, 3, (1, 0)), contest(3, 200, 4, 1, (0, 2))]
    frame = spark.createDataFrame(rows, SCHEMA)
    seen = {t: {r.fixture_id: r.seen for r in history.with_position(history.team_rows(frame), t).where("team_id = 1").collect()} for t in ("row", "strict")}
    assert seen["row"] == {1: 0, 2: 1, 3: 2} and seen["strict"] == {1: 0, 2: 1, 3: 1}


@pytest.mark.parametrize("make", [history.rolling_features, history.form, history.venue, history.strength, history.trends, history.rest, history.league_context])
def test_the_future_changes_nothing(spark, make):
    whole = contests(spark, SF)
    cut = whole.agg(F.percentile("unix", 0.6)).first()[0]
    past = whole.where(F.col("unix") <= cut)
    changed = past.unionByName(whole.where(F.col("unix") > cut).withColumns({"home_goals": F.lit(9).cast("bigint"), "away_goals": F.lit(0).cast("bigint")}))
    a, b = make(past), make(changed.repartition(7))
    keys = set(r.fixture_id for r in past.select("fixture_id").collect())
    show = lambda df: sorted((tuple(r) for r in df.collect() if r.fixture_id in keys), key=repr)
    assert show(a) == show(b)


@pytest.mark.parametrize("make", [history.rolling_features, history.form, history.venue, history.strength, history.trends, history.matchup_trends, history.sample_size])
def test_blocks_change_nothing_and_no_partition_is_a_whole_team(spark, make, monkeypatch):
    whole = contests(spark, SF).where("home_id % 5 < 2")
    show = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    want = show(make(whole))
    parts = history.in_blocks(history.team_rows(whole), [(F.col("played"), 10)], size=4)
    sizes = parts.groupBy("team_id", "block").count().agg(F.max("count")).first()[0]
    assert sizes < 25 and parts.where("own").count() == 2 * whole.count()
    monkeypatch.setattr(history, "BLOCK", 4)
    assert show(make(whole)) == want
