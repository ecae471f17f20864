"""Queries of decision rules and monitoring signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchweave.functions.probability import elo_draw, logit, redistribute, sigmoid, draw_with_dependence
from matchweave.operators import decide, monitor
from matchweave.plans.base import query, r
from matchweave.plans.metrics import PICK_P, SCORED
from matchweave.sources.bindings import CONTESTS, PREDS, contests, predictions


@query(
    f"""{SCORED} SELECT fixture_id, pick AS argmax, CASE WHEN p_draw >= 0.3 THEN 'D' ELSE pick END AS threshold, CASE WHEN greatest(p_home, p_away) - p_draw <= 0.05 THEN 'D' ELSE pick END AS margin,
 CASE WHEN 1.3e0 * p_draw > p_home AND 1.3e0 * p_draw > p_away THEN 'D' ELSE pick END AS utility, CASE WHEN greatest(p_home, p_draw, p_away) >= 0.5 THEN 'HIGH' WHEN greatest(p_home, p_draw, p_away) >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM s"""
)
def g1_policies(spark, sf):
    return predictions(spark, sf).select("fixture_id", *(c.alias(n) for n, c in decide.policies().items()), decide.confidence_tier().alias("tier"))


_GATE = "p_draw >= 0.26e0 AND greatest(p_home, p_away) - p_draw <= 0.12e0 AND greatest(p_home, p_away) <= 0.45e0 AND abs(elo_diff) <= 120 AND lambda_home + lambda_away <= 3.2e0"


@query(f"""{SCORED} SELECT competition_id, count(*) AS n, count(*) FILTER ({_GATE}) AS fired, count(*) FILTER ({_GATE} AND y_true = 'D') AS hits, count(*) FILTER (pick = y_true) AS base_hits,
 count(*) FILTER (CASE WHEN {_GATE} THEN 'D' ELSE pick END = y_true) AS gated_hits FROM s GROUP BY competition_id""")
def g2_override_gate(spark, sf):
    """A conjunctive gate and what it changes."""
    g, y = decide.override_gate(), F.col("y_true")
    rows = predictions(spark, sf).withColumns({"g": g, "pick": decide.best()})
    return rows.groupBy("competition_id").agg(
        F.count("*").alias("n"), F.count_if("g").alias("fired"), F.count_if(F.col("g") & (y == "D")).alias("hits"), F.count_if(F.col("pick") == y).alias("base_hits"),
        F.count_if(F.when(F.col("g"), "D").otherwise(F.col("pick")) == y).alias("gated_hits"),
    )


@query(f"WITH {PREDS}, z AS (SELECT fixture_id, 1 / (1 + exp(-(2.5e0 * p_draw - 0.8e0 * lambda_home - 0.004e0 * elo_diff + 0.7e0))) AS s FROM preds) SELECT fixture_id, {r('s', 'score')}, s >= 0.5 AS fires FROM z")
def g3_linear_decision(spark, sf):
    score, fires = decide.linear_decision({"p_draw": 2.5, "lambda_home": -0.8, "elo_diff": -0.004}, 0.7, 0.5)
    return predictions(spark, sf).select("fixture_id", score.alias("score"), fires.alias("fires"))


@query(
    f"""WITH {PREDS}, rho(c, r) AS (VALUES (0, -0.05e0), (1, -0.08e0), (2, -0.03e0)), lf(i, l) AS (SELECT i, lgamma(i + 1.0) FROM (SELECT unnest(range(16)) AS i)),
 d AS (SELECT fixture_id, sum(exp(i * ln(lambda_home) - lambda_home - l) * exp(i * ln(lambda_away) - lambda_away - l)) AS base FROM preds, lf GROUP BY 1),
 e AS (SELECT p.*, least(greatest(base - 2 * lambda_home * lambda_away * exp(-lambda_home - lambda_away) * coalesce(r, -0.06e0), 1e-6), 1 - 1e-6) AS dc, 0.28 * exp(-0.0006 * abs(elo_diff)) AS ed FROM preds p JOIN d USING (fixture_id) LEFT JOIN rho ON c = competition_id),
 f AS (SELECT *, 1 / (1 + exp(-(0.5 * ln(dc / (1 - dc)) + 0.5 * ln(ed / (1 - ed))))) AS st FROM e)
SELECT fixture_id, {r('(1 - st) * p_home / (p_home + p_away)', 'home')}, {r('st', 'draw')}, {r('(1 - st) * p_away / (p_home + p_away)', 'away')} FROM f"""
)
def g4_champion_chain(spark, sf):
    """Dependence-corrected draw per competition (with a fallback), stacked with the rating curve, redistributed."""
    rho = F.when(F.col("competition_id") == 0, -0.05).when(F.col("competition_id") == 1, -0.08).when(F.col("competition_id") == 2, -0.03).otherwise(-0.06)
    dc = draw_with_dependence(F.col("lambda_home"), F.col("lambda_away"), F.col("rho"))
    rows = predictions(spark, sf).withColumn("rho", rho).withColumn("dc", dc)
    rows = rows.withColumn("st", sigmoid(0.5 * logit(F.col("dc")) + 0.5 * logit(elo_draw(F.col("elo_diff")))))
    h, d, a = redistribute(F.col("p_home"), F.col("p_away"), F.col("st"))
    return rows.select("fixture_id", h.alias("home"), d.alias("draw"), a.alias("away"))


_RISK = "least(100, 100 * p_draw + 15 * (abs(p_home - p_away) <= 0.1)::INT + 10 * (abs(elo_diff) <= 50)::INT + 10 * (lambda_home + lambda_away <= 2.5)::INT)"


@query(
    f"""WITH {PREDS} SELECT fixture_id, {r(_RISK, 'risk')}, CASE WHEN {_RISK} >= 60 THEN 'VERY_HIGH' WHEN {_RISK} >= 45 THEN 'HIGH' WHEN {_RISK} >= 30 THEN 'MODERATE' ELSE 'LOW' END AS tier,
 concat_ws(',', CASE WHEN abs(p_home - p_away) <= 0.1 THEN 'close' END, CASE WHEN abs(elo_diff) <= 50 THEN 'even' END, CASE WHEN lambda_home + lambda_away <= 2.5 THEN 'low_scoring' END) AS reasons FROM preds"""
)
def g5_draw_risk(spark, sf):
    return predictions(spark, sf).select("fixture_id", *(c.alias(n) for n, c in decide.draw_risk().items()))


@query(
    f"""WITH {PREDS}, g AS (SELECT y_true, {_RISK} AS risk FROM preds), t AS (SELECT CASE WHEN risk >= 60 THEN 'VERY_HIGH' WHEN risk >= 45 THEN 'HIGH' WHEN risk >= 30 THEN 'MODERATE' ELSE 'LOW' END AS tier, y_true FROM g)
SELECT coalesce(tier, 'ALL') AS tier, count(*) AS n, {r("avg((y_true = 'D')::INT)", 'draw_rate')} FROM t GROUP BY ROLLUP (tier)"""
)
def g11_tier_table(spark, sf):
    """Draw rate of each risk tier and of all."""
    rows = predictions(spark, sf).select(decide.draw_risk()["tier"].alias("t"), "y_true")
    return rows.rollup("t").agg(F.count("*").alias("n"), F.avg((F.col("y_true") == "D").cast("double")).alias("draw_rate")).select(F.coalesce("t", F.lit("ALL")).alias("tier"), "n", "draw_rate")


@query(
    f"""WITH {PREDS}, g AS (SELECT fixture_id, -p_home * ln(p_home) - p_draw * ln(p_draw) - p_away * ln(p_away) AS e, list_sort([p_home, p_draw, p_away]) AS o FROM preds)
SELECT fixture_id, CASE WHEN e < 0.95 AND o[3] - o[2] > 0.2 THEN 'STRONG' WHEN o[3] - o[2] > 0.08 THEN 'LEAN' ELSE 'AVOID' END AS advisory FROM g"""
)
def g6_advisory(spark, sf):
    return predictions(spark, sf).select("fixture_id", decide.advisory().alias("advisory"))


_FAMILIES = {"xg": ["home_xg", "away_xg"], "shots": ["home_shots", "home_shots_on"]}


def _rates(spark, sf):
    return monitor.null_rates(contests(spark, sf), _FAMILIES, ["competition_id"])


_RATES = (
    f"WITH {CONTESTS}, rates AS (SELECT competition_id, 'xg' AS family, greatest(avg((home_xg IS NULL)::INT), avg((away_xg IS NULL)::INT)) AS rate FROM contests GROUP BY 1 UNION ALL "
    "SELECT competition_id, 'shots', greatest(avg((home_shots IS NULL)::INT), avg((home_shots_on IS NULL)::INT)) FROM contests GROUP BY 1)"
)


@query(f"{_RATES} SELECT competition_id, family, {r('rate', 'rate')}, CASE WHEN rate > 0.078 + 1e-12 THEN 'ALERT' ELSE 'PASS' END AS status FROM rates")
def o1_null_rate_ceiling(spark, sf):
    """A7, O1."""
    return monitor.ceiling(_rates(spark, sf))


@query(f"{_RATES} SELECT competition_id, family, {r('rate', 'rate')}, 0.05e0 AS baseline, {r('(rate - 0.05e0) * 100', 'drift_pp')}, CASE WHEN (rate - 0.05e0) * 100 > 2 + 1e-12 THEN 'ALERT' ELSE 'PASS' END AS status FROM rates")
def o2_null_rate_drift(spark, sf):
    base = spark.createDataFrame([("xg", 0.05), ("shots", 0.05)], "family string, baseline double")
    return monitor.drift(_rates(spark, sf), base)


@query(
    f"""WITH {PREDS}, g AS (SELECT competition_id, avg(p_home) AS h, avg(p_draw) AS d, avg(p_away) AS a FROM preds GROUP BY 1), u AS (SELECT competition_id, 'H' AS class, (h - 0.44e0) * 100 AS g FROM g UNION ALL SELECT competition_id, 'D', (d - 0.26e0) * 100 FROM g UNION ALL SELECT competition_id, 'A', (a - 0.30e0) * 100 FROM g)
SELECT competition_id, class, {r('g', 'gap_pp')}, CASE WHEN abs(g) > 5 + 1e-9 THEN 'ALERT' ELSE 'PASS' END AS status FROM u"""
)
def o4_class_mass(spark, sf):
    return monitor.class_mass(predictions(spark, sf), {"H": "p_home", "D": "p_draw", "A": "p_away"}, {"H": 0.44, "D": 0.26, "A": 0.30}, ["competition_id"])


_SETTLED = f"""WITH {PREDS}, a AS (SELECT max(unix) AS t FROM preds), e AS (SELECT *, CASE WHEN fixture_id % 11 = 0 THEN NULL ELSE unix + (fixture_id % 20) * 86400 END AS settled FROM preds),
 w AS (SELECT *, CASE WHEN settled IS NULL THEN 'unsettled' WHEN settled - unix < 604800 THEN 'immature' WHEN settled > t OR settled < t - 400 * 86400 THEN 'outside_window' ELSE 'eligible' END AS reason FROM e, a)"""


def _settled(spark, sf):
    p = predictions(spark, sf)
    last = p.agg(F.max("unix").alias("as_of"))
    settled = F.when(F.col("fixture_id") % 11 != 0, F.col("unix") + (F.col("fixture_id") % 20) * 86400)
    return p.crossJoin(F.broadcast(last)).withColumn("reason", monitor.eligibility(F.col("unix"), settled, F.col("as_of"), window_days=400))


@query(f"{_SETTLED} SELECT reason, count(*) AS n FROM w GROUP BY reason")
def o5_eligibility(spark, sf):
    return _settled(spark, sf).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    f"""{_SETTLED}, g AS (SELECT competition_id, count(*) AS n, avg(p_draw) AS mp, avg((y_true = 'D')::INT) AS sh FROM w WHERE reason = 'eligible' GROUP BY 1)
SELECT competition_id, n, {r('mp', 'mean_p')}, {r('sh', 'share')}, {r('(mp - sh) * 100', 'gap_pp')}, CASE WHEN n < 200 THEN 'INSUFFICIENT_SAMPLE' WHEN abs((mp - sh) * 100) > 5 + 1e-9 THEN 'ALERT' ELSE 'PASS' END AS status FROM g"""
)
def o6_settled_calibration(spark, sf):
    return monitor.settled_gap(_settled(spark, sf).where("reason = 'eligible'"), ["competition_id"], "p_draw", F.col("y_true") == "D")


@query("""WITH e AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS signal_id, CASE WHEN event_type = 'view' THEN 'PASS' ELSE event_type END AS status, CASE WHEN user_id % 2 = 0 THEN 'INFO' ELSE 'x' END AS severity, value FROM events)
SELECT event_id, concat_ws(',', CASE WHEN signal_id IS NULL THEN 'signal_id' END, CASE WHEN status <> 'PASS' THEN 'status' END, CASE WHEN severity <> 'INFO' THEN 'severity' END, CASE WHEN value IS NULL THEN 'value' END) AS problems FROM e""")
def o8_event_schema(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("signal_id"), F.when(F.col("event_type") == "view", "PASS").otherwise(F.col("event_type")).alias("status"),
        F.when(F.col("user_id") % 2 == 0, "INFO").otherwise("x").alias("severity"), "value",
    )
    return e.select("event_id", monitor.event_problems().alias("problems"))


@query(
    f"""{SCORED}, g AS (SELECT competition_id, count(*) AS n, avg((pick = y_true)::INT) AS acc, avg(ll) AS ll FROM s WHERE season_year >= 1997 GROUP BY 1)
SELECT competition_id, n, {r('acc', 'accuracy')}, {r('ll', 'log_loss')}, CASE WHEN n < 100 THEN 'COLLECTING' WHEN n < 300 THEN 'EARLY' WHEN n < 450 THEN 'PRELIMINARY' WHEN n < 1050 THEN 'SUBSTANTIAL' ELSE 'COMPLETE' END AS status FROM g"""
)
def o13_cohort_status(spark, sf):
    """Cohort scores with the sample's standing."""
    from matchweave.operators.metrics import scorecard

    cards = scorecard(predictions(spark, sf).where("season_year >= 1997"), ["competition_id"])
    return cards.select("competition_id", "n", "accuracy", "log_loss", monitor.sample_status(F.col("n")).alias("status"))
