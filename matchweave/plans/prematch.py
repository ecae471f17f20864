"""Queries of pre-match feature tables, kickoff texts, live records, the gate, the pilot and the final split."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchweave.functions import probability as fn
from matchweave.functions import text
from matchweave.operators import joins, metrics, monitor, prematch, resample
from matchweave.operators.calibrate import decay_from_half_life
from matchweave.plans.base import query, r
from matchweave.plans.history import TEAMS
from matchweave.plans.joins import _PLAN, _U, _W
from matchweave.plans.metrics import LL, SCORED
from matchweave.sources import ledger
from matchweave.sources.bindings import CONTESTS, PREDS, contests, predictions

P, Q = metrics.P, ("q_home", "q_draw", "q_away")
_LL_Q = LL.replace("p_", "q_")


def _rated(spark, sf):
    """Predictions with two ratings that differ by elo_diff."""
    return predictions(spark, sf).withColumns({"home_elo": 1500 + F.col("elo_diff") / 2, "away_elo": 1500 - F.col("elo_diff") / 2})


def _features(family: str, advantage: int) -> str:
    """SQL of a family's columns, in the order of prematch.FAMILIES."""
    js = " + ".join(f"p_{s} * ln(p_{s} / ((p_{s} + q_{s}) / 2)) + q_{s} * ln(q_{s} / ((p_{s} + q_{s}) / 2))" for s in ("home", "draw", "away"))
    spread = " + ".join(f"abs(p_{s} - q_{s})" for s in ("home", "draw", "away"))
    entropy = "-(p_home * ln(p_home) + p_draw * ln(p_draw) + p_away * ln(p_away))"
    most, least = "greatest(p_home, p_draw, p_away)", "least(p_home, p_draw, p_away)"
    gap, goals, seen, number = f"abs(elo_diff + {advantage})", "(lambda_home + lambda_away)", "min_team_samples", "season_match_num"
    doubles = {
        "p_home": "p_home", "p_draw": "p_draw", "p_away": "p_away", "entropy": entropy, "norm_entropy": f"{entropy} / ln(3)", "max_prob": most, "min_prob": least,
        "margin_p1_p2": f"2 * {most} + {least} - 1", "prob_spread": f"{most} - {least}", "prob_concentration": "p_home * p_home + p_draw * p_draw + p_away * p_away",
        "js_divergence": f"({js}) / 2", "mean_abs_prob_diff": f"({spread}) / 3", "home_elo": "1500 + elo_diff / 2", "away_elo": "1500 - elo_diff / 2",
        "total_lam": goals, "lambda_ratio": "greatest(lambda_home, lambda_away) / greatest(least(lambda_home, lambda_away), 0.1e0)", "signed_elo_diff": f"elo_diff + {advantage}", "abs_elo_diff": gap,
    }
    flags = {
        "elo_parity_tight": f"{gap} <= 25", "elo_parity_wide": f"{gap} > 100", "parity_tight": f"{gap} <= 25", "parity_close": f"{gap} > 25 AND {gap} <= 50",
        "parity_moderate": f"{gap} > 50 AND {gap} <= 100", "parity_wide": f"{gap} > 100", "is_promoted_sparse": f"{seen} < 5", "is_developing": f"{seen} BETWEEN 5 AND 10", "is_established": f"{seen} > 10",
        "env_low_goals": f"{goals} < 2.4e0", "env_med_goals": f"{goals} BETWEEN 2.4e0 AND 3e0", "env_high_goals": f"{goals} > 3e0",
        "is_early_3": f"{number} <= 3", "is_early_5": f"{number} IN (4, 5)", "is_early_10": f"{number} BETWEEN 6 AND 10", "is_late_season": f"{number} > 10",
    }
    columns = [r(doubles[c], c) if c in doubles else f"({flags[c]})::INT AS {c}" if c in flags else c for c in prematch.FAMILIES[family]]
    return (
        f"{TEAMS}, {PREDS}, k AS (SELECT fixture_id, CAST(dense_rank() OVER (PARTITION BY competition_id, season_id ORDER BY unix) AS INT) AS season_match_num FROM contests), "
        f"n AS (SELECT fixture_id, min(seen) AS min_team_samples FROM pos GROUP BY fixture_id) SELECT fixture_id, {', '.join(columns)} FROM preds JOIN k USING (fixture_id) JOIN n USING (fixture_id)"
    )


@query(_features("risk", 100))
def m38_risk_features(spark, sf):
    """What is known before kickoff of how hard a contest is to predict."""
    return prematch.features(_rated(spark, sf), contests(spark, sf), "risk")


@query(_features("reliability", 100))
def m38_reliability_features(spark, sf):
    """Features of forecast reliability, and of forecast status, which takes the same ones."""
    return prematch.features(_rated(spark, sf), contests(spark, sf), "reliability")


@query(_features("regime", 0))
def m38_regime_features(spark, sf):
    """Maturity, parity, scoring and season tiers."""
    return prematch.features(_rated(spark, sf), contests(spark, sf), "regime")


_WHEN = "unix + (fixture_id * 7919) % 86400"


@query(
    f"""WITH {CONTESTS}, t AS (SELECT fixture_id, CASE WHEN fixture_id % 101 = 0 THEN 'to be confirmed ' || fixture_id ELSE CAST({_WHEN} AS VARCHAR) END AS x, CASE WHEN fixture_id % 101 <> 0 THEN make_timestamp(({_WHEN}) * 1000000) END AS u FROM contests),
 d AS (SELECT *, u + INTERVAL 330 MINUTE AS z, coalesce(strftime(u, '%Y-%m-%d'), left(x, 10)) AS day, coalesce(strftime(u + INTERVAL 330 MINUTE, '%Y-%m-%d'), left(x, 10)) AS zone_day FROM t)
SELECT fixture_id, coalesce(strftime(u, '%H:%M UTC'), x) AS clock, coalesce(strftime(u, '%d %b %Y, %H:%M UTC'), x) AS kickoff, coalesce(strftime(z, '%I:%M %p'), x) AS zone_clock,
 coalesce(strftime(z, '%d %b %Y, %I:%M %p IST'), x) AS zone_kickoff, day, zone_day, zone_day = day AS same_day FROM d"""
)
def f5_kickoff_texts(spark, sf):
    """kickoffs as texts and days in UTC and another zone, and whether the days are the same; unknown ones stay as they are."""
    unknown = F.concat(F.lit("to be confirmed "), F.col("fixture_id").cast("string"))
    rows = contests(spark, sf).select("fixture_id", F.when(F.col("fixture_id") % 101 == 0, unknown).otherwise(F.expr(_WHEN).cast("string")).alias("x"))
    x, zone = F.col("x"), "Asia/Kolkata"
    return rows.select(
        "fixture_id", text.clock(x).alias("clock"), text.clock(x, day=True).alias("kickoff"), text.clock(x, zone, "", half_days=True).alias("zone_clock"),
        text.clock(x, zone, "IST", half_days=True, day=True).alias("zone_kickoff"), text.local_day(x).alias("day"), text.local_day(x, zone).alias("zone_day"), text.on_day(x, text.local_day(x), zone).alias("same_day"),
    )


@query(
    f"""WITH {CONTESTS}, v AS (SELECT *, fixture_id % 5 AS layout FROM contests)
SELECT CASE WHEN layout > 0 OR fixture_id > 0 THEN fixture_id END AS fixture_id, CASE WHEN layout = 4 THEN 'NS' ELSE status END AS status, CASE WHEN layout < 3 THEN home_goals END::INT AS home_goals, CASE WHEN layout < 3 THEN away_goals END::INT AS away_goals,
 CASE WHEN layout = 0 THEN 90 END AS elapsed, CAST(NULL AS INT) AS time_added FROM v"""
)
def f9_live_records(spark, sf):
    """records of five layouts, goals under one of three names or none, brought to one."""
    c = contests(spark, sf)
    own = {
        0: F.struct(F.col("fixture_id").alias("id"), F.lower("status").alias("status"), "home_goals", "away_goals", F.lit(90).alias("elapsed")),
        1: F.struct("fixture_id", "status", F.col("home_goals").cast("string").alias("home_score"), F.col("away_goals").cast("string").alias("away_score")),
        2: F.struct(F.lit(0).alias("id"), "fixture_id", "status", F.struct(F.col("home_goals").alias("home"), F.col("away_goals").alias("away")).alias("scores")),
        3: F.struct("fixture_id", "status", F.lit("n/a").alias("scores")),
        4: F.struct(F.col("fixture_id").alias("id")),
    }
    layout = F.col("fixture_id") % 5
    texts = F.coalesce(*(F.when(layout == k, F.to_json(v)) for k, v in own.items()))
    return ledger.live_records(c.select(texts.alias("record")), "record")


@query(
    f"""{SCORED}, d AS (SELECT fixture_id, ({_LL_Q}) - ll AS d, power(q_home - (y_true = 'H')::INT, 2) + power(q_draw - (y_true = 'D')::INT, 2) + power(q_away - (y_true = 'A')::INT, 2) - br AS b FROM s),
 x AS (SELECT replicate, d, {_U.format(k='fixture_id')} AS u FROM d, (SELECT unnest(range(1, 201)) AS replicate)), m AS (SELECT replicate, sum({_W} * d) / sum({_W}) AS mean FROM x GROUP BY replicate),
 e AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, avg((mean >= 0)::INT) AS p FROM m), w AS (SELECT count(*) AS n, avg(d) AS dl, avg(b) AS db FROM d)
SELECT n, {r('dl', 'delta_log_loss')}, {r('db', 'delta_brier')}, {r('low', 'low')}, {r('high', 'high')}, {r('p', 'p_value')}, n >= 1050 AS enough_rows, dl < 0 AS improved, high < 0 AS significant, dl <= -0.001 AS practical,
 db <= 0.0005 AS no_degradation, CASE WHEN n >= 1050 AND dl < 0 AND high < 0 AND dl <= -0.001 AND db <= 0.0005 THEN 'ACCEPTED_PENDING_REVIEW' ELSE 'REJECTED' END AS decision FROM w, e"""
)
def b6_gate(spark, sf):
    """All five conditions of a gate registered beforehand, on the second model against the first."""
    d = predictions(spark, sf).select("fixture_id", (metrics.log_loss(Q) - metrics.log_loss()).alias("loss"), (metrics.brier(Q) - metrics.brier()).alias("brier"))
    return resample.gate(d, "fixture_id", "loss", "brier")


@query(
    f"""{SCORED}, x AS (SELECT *, unix // 2592000 AS month, fixture_id % 97 = 0 AS broken, ({_LL_Q}) AS lq FROM s), l AS (SELECT *, unix AS locked FROM x UNION ALL SELECT *, unix + 60 FROM x WHERE fixture_id % 89 = 0),
 k AS (SELECT month, competition_id, fixture_id, count(*) FILTER (NOT broken) AS v, count(*) FILTER (broken) AS bad, min(CASE WHEN NOT broken THEN ll END) AS ll, min(CASE WHEN NOT broken THEN lq END) AS lq,
  min(CASE WHEN NOT broken THEN (y_true = 'D')::INT END) AS draw, min(CASE WHEN NOT broken THEN p_draw END) AS pd FROM l GROUP BY ALL),
 g AS (SELECT month, competition_id, grouping_id(month, competition_id)::INT AS above, count(*) FILTER (v > 0) AS n, sum(bad)::BIGINT AS rejected, sum(greatest(v - 1, 0))::BIGINT AS duplicates, avg(ll) AS a, avg(lq) AS b, avg(draw) AS dr, avg(pd) AS pd FROM k GROUP BY ROLLUP (month, competition_id))
SELECT month, competition_id, above, n, rejected, duplicates, {r('a', 'base_log_loss')}, {r('b', 'candidate_log_loss')}, {r('b - a', 'delta_log_loss')}, {r('dr', 'draw_rate')}, {r('pd', 'mean_p_draw')}, least(n // 25 * 25, 100) || ' / 100' AS milestone,
 CASE WHEN n = 0 THEN 'PILOT WAITING FOR FRESH DATA' WHEN n < 100 THEN 'PILOT_IN_PROGRESS (' || n || '/100)' WHEN rejected = 0 AND duplicates = 0 THEN 'PILOT_PASS — OPERATIONALLY CLEAN' ELSE 'PILOT_PASS_WITH_WARNINGS' END AS verdict FROM g"""
)
def o10_pilot(spark, sf):
    """Scorecard, milestone and verdict of a pilot as a whole, by month and by competition, over a ledger with rejected and repeated locks."""
    p = predictions(spark, sf).withColumns({"month": F.floor(F.col("unix") / 2592000), "broken": F.col("fixture_id") % 97 == 0})
    locks = p.withColumn("locked", F.col("unix")).unionByName(p.where("fixture_id % 89 = 0").withColumn("locked", F.col("unix") + 60))
    return monitor.pilot(locks, ["month", "competition_id"], "fixture_id", "locked", ~F.col("broken"), metrics.log_loss(), metrics.log_loss(Q))


@query(f"WITH {CONTESTS} SELECT CASE WHEN season_year = 2001 THEN 'eval' ELSE 'train' END AS role, count(*) AS n, count(DISTINCT season_id) AS seasons, min(unix) AS first, max(unix) AS last FROM contests GROUP BY 1")
def l2_final_split(spark, sf):
    """L2: all earlier seasons against the last one, which no walk-forward fold has seen; fails if it isn't untouched."""
    split = joins.final_split(contests(spark, sf), {year for _, _, year in _PLAN}, set(range(1990, 2001)), {2001})
    return split.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("season_id").alias("seasons"), F.min("unix").alias("first"), F.max("unix").alias("last"))


@query(
    f"""WITH {CONTESTS}, l AS (SELECT fixture_id, unix, home_goals FROM contests WHERE fixture_id % 23 <> 1 UNION ALL SELECT fixture_id, unix, home_goals FROM contests WHERE fixture_id % 31 = 2 AND fixture_id % 23 <> 1),
 rr AS (SELECT fixture_id, unix + CASE WHEN fixture_id % 41 = 3 THEN 3600 ELSE 0 END AS unix, CASE WHEN fixture_id % 43 = 5 THEN NULL ELSE home_goals END AS home_goals FROM contests WHERE fixture_id % 29 <> 1),
 a AS (SELECT fixture_id, count(*) AS n, min(unix) AS u, min(home_goals) AS y FROM l GROUP BY 1), b AS (SELECT fixture_id, count(*) AS n, min(unix) AS u, min(home_goals) AS y FROM rr GROUP BY 1)
SELECT count(*) AS keys, count(*) FILTER (a.n IS NULL) AS missing_left, count(*) FILTER (b.n IS NULL) AS missing_right, count(*) FILTER (a.n > 1) AS repeated_left, count(*) FILTER (b.n > 1) AS repeated_right,
 count(*) FILTER (a.n > 0 AND b.n > 0 AND a.u <> b.u) AS moved, count(*) FILTER (a.n > 0 AND b.n > 0 AND a.y IS DISTINCT FROM b.y) AS relabelled FROM a FULL JOIN b ON a.fixture_id = b.fixture_id"""
)
def j16_alignment(spark, sf):
    """Keys missing, repeated, moved in time or labelled otherwise in one of two arms."""
    c = contests(spark, sf).select("fixture_id", "unix", "home_goals")
    left = c.where("fixture_id % 23 != 1")
    right = c.where("fixture_id % 29 != 1").select(
        "fixture_id", (F.col("unix") + F.when(F.col("fixture_id") % 41 == 3, 3600).otherwise(0)).alias("unix"), F.when(F.col("fixture_id") % 43 != 5, F.col("home_goals")).alias("home_goals")
    )
    return joins.alignment(left.unionByName(left.where("fixture_id % 31 = 2")), right, "fixture_id", "unix", "home_goals")


_HALF_LIVES = [90, 180, 365, 730]
_REFERENCE = 852076800


@query(
    f"""WITH {PREDS}, h AS (SELECT unnest([90, 180, 365, 730]) AS half_life)
SELECT competition_id, half_life, count(*) FILTER (unix < {_REFERENCE}) AS n, count(*) FILTER (unix >= {_REFERENCE}) AS violations, {r(f'sum(CASE WHEN unix < {_REFERENCE} THEN exp(-ln(2) / half_life * ({_REFERENCE} - unix) / 86400) END)', 'weight')},
 {r(f"sum(CASE WHEN unix < {_REFERENCE} AND y_true = 'D' THEN exp(-ln(2) / half_life * ({_REFERENCE} - unix) / 86400) END) / sum(CASE WHEN unix < {_REFERENCE} THEN exp(-ln(2) / half_life * ({_REFERENCE} - unix) / 86400) END)", 'draw_rate')} FROM preds, h GROUP BY ALL"""
)
def f36_decayed_rates(spark, sf):
    """draw rates before a reference time, weighted by four half-lives; rows that break causality are counted, not weighted."""
    p = predictions(spark, sf).select("competition_id", "y_true", "unix")
    before, draw = fn.causal(F.col("unix"), _REFERENCE), F.col("y_true") == "D"
    weights = {h: fn.decay_weight(F.col("unix"), _REFERENCE, decay_from_half_life(h)) for h in _HALF_LIVES}
    sums = p.groupBy("competition_id").agg(
        F.count_if(before).alias("n"), F.count_if(~before).alias("violations"),
        *(F.sum(F.when(before, w)).alias(f"w{h}") for h, w in weights.items()), *(F.sum(F.when(before & draw, w)).alias(f"d{h}") for h, w in weights.items()),
    )
    cells = F.explode(F.array(*(F.struct(F.lit(h).alias("half_life"), F.col(f"w{h}").alias("weight"), (F.col(f"d{h}") / F.col(f"w{h}")).alias("draw_rate")) for h in _HALF_LIVES)))
    return sums.select("competition_id", "n", "violations", cells.alias("c")).select("competition_id", "n", "violations", "c.*")



@query(
    f"""WITH {PREDS}, z AS (SELECT *, 1.5e0 * ln(p_home) AS h, 0.6e0 * ln(p_draw) + 0.2e0 AS d, 1.1e0 * ln(p_away) - 0.1e0 AS a FROM preds)
SELECT competition_id, count(*) AS n, count(*) AS by_temperature, count(*) FILTER ((p_home <= p_draw) = (h <= d) AND (p_home <= p_away) = (h <= a) AND (p_draw <= p_away) = (d <= a)) AS by_vector FROM z GROUP BY competition_id"""
)
def f37_ranking_preserved(spark, sf):
    """rows whose classes keep their order under a temperature (all) and under vector scaling (not all)."""
    p = [F.col(c) for c in P]
    kept = {"by_temperature": fn.ranking_preserved(p, fn.temperature(p, 1.5)), "by_vector": fn.ranking_preserved(p, fn.vector_scaled(p, [1.5, 0.6, 1.1], [0.0, 0.2, -0.1]))}
    rows = predictions(spark, sf).select("competition_id", *(c.alias(k) for k, c in kept.items()))
    return rows.groupBy("competition_id").agg(F.count("*").alias("n"), *(F.count_if(k).alias(k) for k in kept))
