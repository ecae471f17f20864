"""Queries of the history family: perspective rows, windows, form, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchweave.operators import history as op
from matchweave.plans.base import query, r
from matchweave.sources.bindings import CONTESTS, contests

TEAMS = (
    "WITH " + CONTESTS + """, sides AS (
  SELECT fixture_id, unix, competition_id, season_id, status, home_id AS team_id, away_id AS opponent_id, TRUE AS is_home,
         home_goals AS goals_for, away_goals AS goals_against, home_xg AS xg_for, away_xg AS xg_against,
         home_shots AS shots_for, away_shots AS shots_against, home_shots_on AS shots_on_for, away_shots_on AS shots_on_against FROM contests
  UNION ALL
  SELECT fixture_id, unix, competition_id, season_id, status, away_id, home_id, FALSE,
         away_goals, home_goals, away_xg, home_xg, away_shots, home_shots, away_shots_on, home_shots_on FROM contests
), teams AS (
  SELECT *, status IN ('FT', 'AWARDED') AS played,
         CASE WHEN goals_for > goals_against THEN 'W' WHEN goals_for < goals_against THEN 'L' WHEN goals_for = goals_against THEN 'D' END AS outcome,
         CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for < goals_against THEN 0 WHEN goals_for = goals_against THEN 1 END AS points
  FROM sides
), pos AS (
  SELECT *, CAST(coalesce(sum(played::INT) OVER (PARTITION BY team_id ORDER BY unix, fixture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seen
  FROM teams
)"""
)
LAST = "(PARTITION BY team_id ORDER BY seen RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
SEASON = "(PARTITION BY team_id, season_id ORDER BY unix, fixture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
FRAMES = {"last5": (LAST.format(n=5), 3), "last10": (LAST.format(n=10), 5), "season": (SEASON, 2)}


def gated(value: str, window: str) -> str:
    frame, least = FRAMES[window]
    own = f"CASE WHEN played THEN {value} END"
    return f"CASE WHEN count({own}) OVER {frame} >= {least} THEN avg({own}) OVER {frame} END"


def coverage(value: str, window: str) -> str:
    return f"count(CASE WHEN played THEN {value} END) OVER {FRAMES[window][0]}"


def n_of(window: str) -> str:
    return f"CAST(coalesce(sum(played::INT) OVER {FRAMES[window][0]}, 0) AS BIGINT)"


CORE = ["points_last5", "goals_for_season"]


@query(
    TEAMS
    + f""", f AS (SELECT fixture_id, is_home, {gated('points', 'last5')} AS p5, {gated('goals_for', 'season')} AS gs FROM pos)
SELECT fixture_id, {r("max(CASE WHEN is_home THEN p5 END)", "home_points_last5")}, {r("max(CASE WHEN is_home THEN gs END)", "home_goals_for_season")},
       {r("max(CASE WHEN NOT is_home THEN p5 END)", "away_points_last5")}, {r("max(CASE WHEN NOT is_home THEN gs END)", "away_goals_for_season")},
       {r("max(CASE WHEN is_home THEN p5 END) - max(CASE WHEN NOT is_home THEN p5 END)", "diff_points_last5")},
       {r("max(CASE WHEN is_home THEN gs END) - max(CASE WHEN NOT is_home THEN gs END)", "diff_goals_for_season")}
FROM f GROUP BY fixture_id"""
)
def w_rolling_core(spark, sf):
    """Gated last-5 points and season goals of both teams."""
    return op.per_contest(op.rolling_features(contests(spark, sf), stats=("goals",), windows=("last5", "season")), CORE)


@query(TEAMS + " SELECT fixture_id, team_id, opponent_id, is_home, goals_for, goals_against, outcome, CAST(points AS INT) AS points, played FROM teams")
def p1_team_perspective(spark, sf):
    columns = ["fixture_id", "team_id", "opponent_id", "is_home", "goals_for", "goals_against", "outcome", "points", "played"]
    return op.team_rows(contests(spark, sf)).select(*columns)


_FAMILIES = [f"{s}_{d}" for s in ("goals", "xg", "shots", "shots_on") for d in ("for", "against")]


@query(
    TEAMS
    + " SELECT fixture_id, team_id, is_home, seen, "
    + ", ".join(f"{r(gated(v, w), f'{v}_{w}')}, {coverage(v, w)} AS {v}_{w}_coverage" for w in FRAMES for v in [*_FAMILIES, "points"])
    + ", "
    + ", ".join(f"{n_of(w)} AS n_{w}" for w in FRAMES)
    + " FROM pos"
)
def w4_rolling_families(spark, sf):
    """Every statistic, for and against, over three windows, with n and coverage."""
    return op.rolling_features(contests(spark, sf))


@query(TEAMS + f" SELECT fixture_id, team_id, is_home, seen, {r(gated('shots_for - shots_on_for', 'season'), 'off_target_season')}, {coverage('shots_for - shots_on_for', 'season')} AS off_target_season_coverage, {r(gated('points', 'season'), 'points_season')}, {coverage('points', 'season')} AS points_season_coverage, {n_of('season')} AS n_season FROM pos")
def w5_season_families(spark, sf):
    """Season-only families, with a registered extra column."""
    found = op.rolling_features(contests(spark, sf), stats=("goals", "shots", "shots_on"), windows=("season",), extra={"off_target": F.col("shots_for") - F.col("shots_on_for")})
    return found.select("fixture_id", "team_id", "is_home", "seen", "off_target_season", "off_target_season_coverage", "points_season", "points_season_coverage", "n_season")


def _venue(value: str, home: str) -> str:
    own = f"CASE WHEN played AND is_home = {home} THEN {value} END"
    return f"CASE WHEN count({own}) OVER {SEASON} >= 2 THEN avg({own}) OVER {SEASON} END"


@query(
    TEAMS
    + f""" SELECT fixture_id, team_id, {r(_venue('goals_for', 'TRUE'), 'goals_home_season')}, {r(_venue('goals_for', 'FALSE'), 'goals_away_season')},
 {r(_venue('goals_for - goals_against', 'TRUE'), 'gd_home_season')}, {r(_venue('goals_for - goals_against', 'FALSE'), 'gd_away_season')} FROM pos"""
)
def w6_venue(spark, sf):
    return op.venue(contests(spark, sf))


_FORM = {
    "points": "points", "win_rate": "(outcome = 'W')::INT", "draw_rate": "(outcome = 'D')::INT", "loss_rate": "(outcome = 'L')::INT",
    "goal_diff": "goals_for - goals_against", "xg_diff": "xg_for - xg_against",
}


@query(TEAMS + " SELECT fixture_id, team_id, " + ", ".join(r(gated(v, w), f"{k}_{w}") for w in ("last5", "last10") for k, v in _FORM.items()) + " FROM pos")
def w7_form(spark, sf):
    return op.form(contests(spark, sf))


_LEAGUE = {
    "row": "(PARTITION BY competition_id, season_id ORDER BY unix, fixture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "strict": "(PARTITION BY competition_id, season_id ORDER BY unix RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
}


def league(ties: str, suffix: str = "") -> str:
    w = _LEAGUE[ties]
    return f"""count(CASE WHEN status IN ('FT', 'AWARDED') THEN home_goals + away_goals END) OVER {w} AS league_matches{suffix},
 avg(CASE WHEN status IN ('FT', 'AWARDED') THEN home_goals + away_goals END) OVER {w} / 2 AS league_mean{suffix},
 avg(CASE WHEN status IN ('FT', 'AWARDED') THEN home_goals - away_goals END) OVER {w} AS league_home_advantage{suffix}"""


@query("WITH " + CONTESTS + f" SELECT fixture_id, league_matches, {r('league_mean', 'league_mean')}, {r('league_home_advantage', 'league_home_advantage')} FROM (SELECT fixture_id, {league('row')} FROM contests)")
def w3_league_context(spark, sf):
    """Running league totals before each contest."""
    return op.league_context(contests(spark, sf))


@query("WITH " + CONTESTS + f" SELECT fixture_id, league_matches, {r('league_mean', 'league_mean')}, {r('league_home_advantage', 'league_home_advantage')} FROM (SELECT fixture_id, {league('strict')} FROM contests)")
def j10_strict_asof_totals(spark, sf):
    """League totals over kickoffs strictly before the contest's."""
    return op.league_context(contests(spark, sf), ties="strict")


@query(
    "WITH " + CONTESTS + f""", b AS (SELECT fixture_id, {league('row')}, {league('strict', '_s')} FROM contests)
SELECT count(*) AS contests, count(*) FILTER (league_matches <> league_matches_s) AS affected,
 {r('avg(abs(league_mean - league_mean_s))', 'mean_gap')}, {r('max(abs(league_mean - league_mean_s))', 'max_gap')} FROM b"""
)
def l6_tie_leakage(spark, sf):
    return op.tie_leakage(contests(spark, sf))


@query(TEAMS + " SELECT fixture_id, team_id, seen, seen < 3 AS insufficient_history FROM pos")
def w9_sample_size(spark, sf):
    return op.sample_size(contests(spark, sf))


@query(
    TEAMS
    + f""", l AS (SELECT fixture_id, {league('row')} FROM contests), t AS (
 SELECT fixture_id, is_home, {n_of('season')} AS n, coalesce(sum(CASE WHEN played THEN goals_for END) OVER {SEASON}, 0) AS total FROM pos
), s AS (SELECT t.fixture_id, is_home, CASE WHEN league_mean IS NULL AND n = 0 THEN NULL ELSE (total + 5e0 * coalesce(league_mean, 0)) / (n + 5e0) END AS v FROM t JOIN l USING (fixture_id))
SELECT fixture_id, {r("max(CASE WHEN is_home THEN v END)", "home_strength")}, {r("max(CASE WHEN NOT is_home THEN v END)", "away_strength")},
 {r("max(CASE WHEN is_home THEN v END) - max(CASE WHEN NOT is_home THEN v END)", "diff_strength")} FROM s GROUP BY fixture_id"""
)
def w10_strength(spark, sf):
    return op.strength(contests(spark, sf))


@query("WITH " + CONTESTS + " SELECT fixture_id, CAST(dense_rank() OVER (PARTITION BY competition_id, season_id ORDER BY unix) AS INT) AS season_match_num FROM contests")
def w11_dense_round(spark, sf):
    return op.dense_round(contests(spark, sf))


_PAST = "(PARTITION BY team_id ORDER BY unix, fixture_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query(
    TEAMS
    + f" SELECT fixture_id, team_id, {r(f'(coalesce(sum(coalesce(xg_for, 1.25)) OVER {_PAST}, 0) + (5 - count(*) OVER {_PAST}) * 1.25) / 5', 'xg_padded')} FROM teams"
)
def w12_padded_mean(spark, sf):
    return op.padded_mean(contests(spark, sf))


def _ewma(value: str, half_life: int, newest: int, prior: str, part: str = "team_id") -> str:
    terms = [(f"lag({value}, {i + 1}) OVER w_{part.count(',')}", 0.5 ** (i / half_life)) for i in range(newest)]
    top = " + ".join(f"coalesce({t}, 0) * {w!r}" for t, w in terms)
    low = " + ".join(f"(CASE WHEN {t} IS NULL THEN 0 ELSE {w!r} END)" for t, w in terms)
    return f"CASE WHEN lag({value}) OVER w_{part.count(',')} IS NULL THEN {prior} ELSE ({top}) / ({low}) END"


@query(
    TEAMS
    + f""", v AS (SELECT *, coalesce(xg_for, 1.25) AS x, coalesce(CAST(goals_for AS DOUBLE), 0) - coalesce(xg_for, 1.25) AS l FROM teams), e AS (
 SELECT fixture_id, team_id, {_ewma('x', 3, 5, '1.25e0')} AS s, {_ewma('x', 10, 20, '1.25e0')} AS g, {_ewma('l', 5, 10, '0e0')} AS f, {_ewma('x', 5, 10, '1.25e0', 'team_id, is_home')} AS h
 FROM v WINDOW w_0 AS (PARTITION BY team_id ORDER BY unix, fixture_id), w_1 AS (PARTITION BY team_id, is_home ORDER BY unix, fixture_id))
SELECT fixture_id, team_id, {r('s', 'xg_short')}, {r('g', 'xg_long')}, {r('f', 'finishing')}, {r('h', 'xg_venue')}, {r('s - g', 'momentum')} FROM e"""
)
def w13_trends(spark, sf):
    """Weighted means by match index."""
    return op.trends(contests(spark, sf))


@query(
    TEAMS
    + f""", v AS (SELECT *, coalesce(xg_for, 1.25) AS x, coalesce(xg_against, 1.25) AS y, coalesce(CAST(goals_for AS DOUBLE), 0) - coalesce(xg_for, 1.25) AS l, coalesce(CAST(goals_against AS DOUBLE), 0) - coalesce(xg_against, 1.25) AS q FROM teams), e AS (
 SELECT fixture_id, is_home, {_ewma('l', 5, 10, '0e0')} AS f, {_ewma('q', 5, 10, '0e0')} AS d, {_ewma('x', 3, 5, '1.25e0')} - ({_ewma('x', 10, 20, '1.25e0')}) AS t, {_ewma('y', 3, 5, '1.25e0')} - ({_ewma('y', 10, 20, '1.25e0')}) AS u
 FROM v WINDOW w_0 AS (PARTITION BY team_id ORDER BY unix, fixture_id))
SELECT h.fixture_id, {r('h.f - a.f', 'finishing_gap')}, {r('h.d - a.d', 'defensive_gap')}, {r('h.f - h.d - (a.f - a.d)', 'net_luck_gap')}, {r('h.t - h.u - (a.t - a.u)', 'momentum_gap')} FROM e h JOIN e a ON a.fixture_id = h.fixture_id AND h.is_home AND NOT a.is_home"""
)
def w18_matchup_trends(spark, sf):
    """Residuals and momentum of both sides, for and against, as differences of a pairing."""
    return op.matchup_trends(contests(spark, sf))


@query(
    TEAMS
    + f""" SELECT fixture_id, team_id,
 {r("coalesce(least(greatest((unix - lag(unix) OVER (PARTITION BY team_id ORDER BY unix, fixture_id)) / 86400.0, 2.0), 21.0), 14.0)", "rest_days")},
 count(*) OVER (PARTITION BY team_id ORDER BY unix RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS matches_7d,
 count(*) OVER (PARTITION BY team_id ORDER BY unix RANGE BETWEEN 1209600 PRECEDING AND 1 PRECEDING) AS matches_14d FROM teams"""
)
def w15_rest_and_congestion(spark, sf):
    return op.rest(contests(spark, sf))


@query(
    "WITH " + CONTESTS
    + f" SELECT fixture_id, {r('greatest(coalesce(avg(home_goals + away_goals) OVER (PARTITION BY competition_id ORDER BY unix, fixture_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING), 0.5), 0.5)', 'league_recent')} FROM contests"
)
def w14_recent_league_mean(spark, sf):
    return op.recent_league_mean(contests(spark, sf))
