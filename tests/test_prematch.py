"""Pre-match features, kickoff texts, live records, the gate, the pilot and guarded splits, by hand-computed rows."""

import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from matchweave.functions import probability as fn
from matchweave.functions import text
from matchweave.operators import joins, monitor, prematch, resample
from matchweave.sources import ledger

CONTEST = "fixture_id long, unix long, competition_id int, season_id int, status string, home_id long, away_id long, home_goals int, away_goals int"
STATS = ["home_xg", "away_xg", "home_shots", "away_shots", "home_shots_on", "away_shots_on"]
RATED = "fixture_id long, home_elo double, away_elo double, lambda_home double, lambda_away double, p_home double, p_draw double, p_away double, q_home double, q_draw double, q_away double"


def season(spark, n):
    """n contests of teams 1 and 2, the last at the same kickoff as the one before."""
    rows = [(k, 1000 * min(k, n - 1), 1, 1, "FT", 1, 2, 1, 0) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, CONTEST).withColumns({c: F.lit(1.0) for c in STATS})


def rated(spark, *rows):
    return spark.createDataFrame(list(rows), RATED)


def test_features_by_numpy(spark):
    p, q = np.array([0.5, 0.3, 0.2]), np.array([0.2, 0.3, 0.5])
    rows = rated(spark, (6, 1500.0, 1575.0, 1.4, 0.05, *map(float, p), *map(float, q)))
    got = prematch.features(rows, season(spark, 8), "reliability").first()
    m = (p + q) / 2
    assert got.entropy == pytest.approx(-(p * np.log(p)).sum()) and got.norm_entropy == pytest.approx(-(p * np.log(p)).sum() / np.log(3))
    assert got.js_divergence == pytest.approx(((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2)
    assert got.mean_abs_prob_diff == pytest.approx(np.abs(p - q).mean()) and got.prob_concentration == pytest.approx((p**2).sum())
    assert (got.margin_p1_p2, got.prob_spread, got.max_prob) == pytest.approx((0.2, 0.3, 0.5))
    assert got.lambda_ratio == pytest.approx(14.0) and got.total_lam == pytest.approx(1.45)
    assert (got.signed_elo_diff, got.elo_parity_tight, got.elo_parity_wide) == (25.0, 1, 0)
    assert (got.season_match_num, got.min_team_samples, got.is_promoted_sparse, got.is_early_3, got.is_early_5) == (6, 5, 0, 0, 0)


def test_zero_probabilities_and_unknown_contests_have_features(spark):
    rows = rated(spark, (99, 1500.0, 1500.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, None, 1500.0, None, 1.0, 0.4, 0.3, 0.3, 0.4, 0.3, 0.3))
    got = {r.fixture_id: r for r in prematch.features(rows, season(spark, 3), "risk").collect()}
    assert got[99].entropy == pytest.approx(0, abs=1e-9) and got[99].js_divergence == pytest.approx(np.log(2))
    assert (got[99].season_match_num, got[99].min_team_samples, got[99].is_promoted_sparse) == (10, 0, 1)
    assert got[1].abs_elo_diff is None and got[1].total_lam is None and got[1].js_divergence == pytest.approx(0)
    regime = {r.fixture_id: r for r in prematch.features(rows, season(spark, 3), "regime").collect()}
    assert regime[1].parity_tight + regime[1].parity_wide + regime[1].env_low_goals + regime[1].env_high_goals == 0


def test_every_regime_tier_holds_once(spark):
    gaps = [0, 25, 25.5, 50, 100, 101, -60]
    rows = rated(spark, *((k + 1, 1500.0 + g, 1500.0, 1.0 + k / 5, 1.0, 0.4, 0.3, 0.3, 0.4, 0.3, 0.3) for k, g in enumerate(gaps)))
    tiers = [["parity_tight", "parity_close", "parity_moderate", "parity_wide"], ["env_low_goals", "env_med_goals", "env_high_goals"], ["is_promoted_sparse", "is_developing", "is_established"], ["is_early_3", "is_early_5", "is_early_10", "is_late_season"]]
    found = prematch.features(rows, season(spark, 15), "regime").orderBy("fixture_id").collect()
    assert len(found) == 7 and all(sum(r[c] for c in names) == 1 for r in found for names in tiers)
    assert [next(c for c in tiers[0] if r[c])[7:] for r in found] == ["tight", "tight", "close", "close", "moderate", "wide", "moderate"]


def test_kickoff_texts(spark):
    stamps = [1787857800, 1767225599, 951782400, 1774747800]
    rows = spark.createDataFrame([(str(s),) for s in stamps] + [("2026-08-27T18:30:00Z",), ("2026-08-27T18:30:00+05:30",), ("soon, they say",), ("",), (None,)], "x string")
    for zone in ("UTC", "Asia/Kolkata", "Europe/London", "America/New_York"):
        got = rows.select("x", text.clock(F.col("x"), zone, "Z").alias("a"), text.clock(F.col("x"), zone, "", half_days=True, day=True).alias("b"), text.local_day(F.col("x"), zone).alias("d")).collect()
        for s, r in zip(stamps, got):
            at = dt.datetime.fromtimestamp(s, ZoneInfo(zone))
            assert (r.a, r.b, r.d) == (at.strftime("%H:%M Z"), at.strftime("%d %b %Y, %I:%M %p"), at.strftime("%Y-%m-%d"))
        assert (got[6].a, got[6].d, got[7].a, got[8].a, got[8].d) == ("soon, they say", "soon, they", "", None, None)
    got = rows.select(text.clock(F.col("x")).alias("a"), text.on_day(F.col("x"), "2026-08-27").alias("d")).collect()
    assert [(r.a, r.d) for r in got[4:6]] == [("18:30 UTC", True), ("13:00 UTC", True)]
    assert not got[0].d or got[0].a


def test_live_records_by_layout(spark):
    texts = [
        '{"id": 7, "status": "ft", "home_goals": 2, "home_score": 9, "away_goals": "1", "elapsed": 90, "time_added": 4}',
        '{"id": 0, "fixture_id": "8", "home_score": 0, "scores": {"home": 5, "away": 3}}',
        '{"fixture_id": 9, "status": "LIVE", "scores": "n/a", "away_goals": null, "away_score": 1}',
        '{"id": 10, "scores": {"home": "x"}, "elapsed": "half"}', "not json", "", None,
    ]
    rows = spark.createDataFrame([(k, "kept", t) for k, t in enumerate(texts)], "k int, status string, t string")
    got = [tuple(r)[1:] for r in ledger.live_records(rows, "t").orderBy("k").collect()]
    nothing = (None, "NS", None, None, None, None)
    assert got == [(7, "FT", 2, 1, 90, 4), (8, "NS", 0, 3, None, None), (9, "LIVE", None, 1, None, None), (10, "NS", None, None, None, None), nothing, nothing, nothing]


def gate_of(spark, losses, briers, **more):
    rows = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(losses, briers))], "k long, loss double, brier double")
    return resample.gate(rows, "k", "loss", "brier", replicates=100, **more).first()


def test_each_condition_closes_the_gate(spark):
    better = [-0.02 - 0.001 * (k % 3) for k in range(1050)]
    ok = gate_of(spark, better, [0.0] * 1050)
    assert ok.decision == "ACCEPTED_PENDING_REVIEW" and ok.p_value == 0 and ok.low <= ok.delta_log_loss <= ok.high < 0
    few = gate_of(spark, better[:-1], [0.0] * 1049)
    assert (few.enough_rows, few.improved, few.decision) == (False, True, "REJECTED")
    worse = gate_of(spark, better, [0.001] * 1050)
    assert (worse.no_degradation, worse.significant, worse.decision) == (False, True, "REJECTED")
    small = gate_of(spark, [x / 100 for x in better], [0.0] * 1050)
    assert (small.significant, small.practical, small.decision) == (True, False, "REJECTED")
    noisy = gate_of(spark, [-0.002 + (1 if k % 2 else -1) for k in range(1050)], [0.0] * 1050)
    assert (noisy.practical, noisy.significant, noisy.decision) == (True, False, "REJECTED")
    none = gate_of(spark, [], [])
    assert (none.n, none.improved, none.significant, none.no_degradation, none.decision) == (0, False, False, False, "REJECTED")


def pilot_of(spark, rows):
    df = spark.createDataFrame(rows, "league string, id long, at long, good boolean, a double, b double, y_true string, p_draw double")
    found = monitor.pilot(df, ["league"], "id", "at", F.col("good"), F.col("a"), F.col("b")).collect()
    return {r.league if not r.above else "all": r for r in found}


def test_pilot_counts_and_verdicts(spark):
    clean = [("x", k, k, True, 1.0, 0.5, "D" if k % 4 == 0 else "H", 0.25) for k in range(100)]
    got = pilot_of(spark, clean)
    assert got["x"].verdict == "PILOT_PASS — OPERATIONALLY CLEAN" and got["x"].milestone == "100 / 100"
    assert (got["all"].n, got["all"].delta_log_loss, got["all"].draw_rate) == (100, -0.5, 0.25)
    again = [("x", 5, 900, True, 9.0, 9.0, "D", 0.9), ("y", 200, 1, False, 7.0, 7.0, "D", 0.9), ("z", 300, 1, True, 2.0, 1.0, "D", 0.5), ("z", 300, 0, False, 9.0, 9.0, "H", 0.5)]
    got = pilot_of(spark, clean + again)
    assert (got["x"].duplicates, got["x"].base_log_loss, got["x"].verdict) == (1, 1.0, "PILOT_PASS_WITH_WARNINGS")
    assert (got["y"].n, got["y"].rejected, got["y"].base_log_loss, got["y"].verdict) == (0, 1, None, "PILOT WAITING FOR FRESH DATA")
    assert (got["z"].n, got["z"].rejected, got["z"].base_log_loss, got["z"].verdict, got["z"].milestone) == (1, 1, 2.0, "PILOT_IN_PROGRESS (1/100)", "0 / 100")
    assert (got["all"].n, got["all"].rejected, got["all"].duplicates) == (101, 2, 1)


def test_final_split_is_untouched_and_in_order(spark):
    rows = spark.createDataFrame([(1, 2000, 10), (2, 2001, 20), (3, 2002, 30), (4, 1990, 1)], "id int, season_year int, unix long")
    got = joins.final_split(rows, {2001}, {2000, 2001}, {2002})
    assert sorted((r.id, r.role) for r in got.collect()) == [(1, "train"), (2, "train"), (3, "eval")] and got.columns == [*rows.columns, "role"]
    with pytest.raises(ValueError, match="used before"):
        joins.final_split(rows, {2001, 2002}, {2000}, {2002})
    late = rows.unionByName(spark.createDataFrame([(5, 2001, 30)], rows.schema))
    with pytest.raises(PySparkException, match="reaches into"):
        joins.final_split(late, {2001}, {2000, 2001}, {2002}).collect()
    assert joins.final_split(rows.where("false"), set(), {2000}, {2002}).count() == 0


def test_alignment_counts(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, t int, y string")
    a, b = make((1, 1, "H"), (2, 2, "D"), (2, 2, "D"), (3, 3, None), (4, 4, "A")), make((1, 1, "H"), (2, 9, "D"), (3, 3, "A"), (5, 5, "A"))
    assert tuple(joins.alignment(a, b, "k", "t", "y").first()) == (5, 1, 1, 1, 0, 1, 1)
    assert tuple(joins.alignment(a.where("k != 2"), a.where("k != 2"), "k", "t", "y").first())[1:] == (0,) * 6
    assert tuple(joins.alignment(a.where("false"), a.where("false"), "k", "t", "y").first()) == (0,) * 7


def test_ranking_and_causality(spark):
    rows = spark.createDataFrame([(0.5, 0.3, 0.2, 0.4, 0.35, 0.25), (0.5, 0.3, 0.2, 0.3, 0.5, 0.2), (0.4, 0.4, 0.2, 0.4, 0.4, 0.2), (0.4, 0.4, 0.2, 0.41, 0.39, 0.2)], "a double, b double, c double, x double, y double, z double")
    kept = rows.select(fn.ranking_preserved([F.col(c) for c in "abc"], [F.col(c) for c in "xyz"]).alias("k"))
    assert [r.k for r in kept.collect()] == [True, False, True, False]
    assert [r.c for r in spark.range(3).select(fn.causal(F.col("id"), 2).alias("c")).collect()] == [True, True, False]
