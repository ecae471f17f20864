"""Queries of sequential ratings.

The oracles of the Elo kernels step from kickoff to kickoff by recursion; their ratings are rounded to
four digits, because sums in another order differ in the last bits. The clipped kernels are tested by replay.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from matchweave.operators import history, joins, ratings
from matchweave.plans.base import query
from matchweave.sources.bindings import CONTESTS, contests

_SIDES = CONTESTS + """, days AS (
  SELECT *, dense_rank() OVER (PARTITION BY competition_id ORDER BY unix) AS d FROM contests
), sides AS (
  SELECT competition_id AS c, d, season_id, fixture_id, home_id AS team, away_id AS opp, 1 AS way, home_goals AS gf, away_goals AS ga,
         home_goals IS NOT NULL AND away_goals IS NOT NULL AND status IN ('FT', 'AWARDED') AS played FROM days
  UNION ALL
  SELECT competition_id, d, season_id, fixture_id, away_id, home_id, -1, away_goals, home_goals,
         home_goals IS NOT NULL AND away_goals IS NOT NULL AND status IN ('FT', 'AWARDED') FROM days
), entered AS (
  SELECT c, d, team, min(season_id) AS season, lag(min(season_id)) OVER (PARTITION BY c, team ORDER BY d) AS before FROM sides GROUP BY c, d, team
), opened AS (
  SELECT c, d, min(season_id) AS season, lag(min(season_id)) OVER (PARTITION BY c ORDER BY d) AS before FROM sides GROUP BY c, d
), steps AS (
  SELECT *, row_number() OVER (PARTITION BY c, team ORDER BY d, fixture_id) - 1 AS n,
         CASE WHEN abs(gf - ga) <= 1 THEN 1e0 WHEN abs(gf - ga) = 2 THEN 1.5e0 ELSE (11 + abs(gf - ga)) / 8e0 END AS times,
         CASE WHEN gf > ga THEN 1e0 WHEN gf = ga THEN 0.5e0 ELSE 0e0 END AS actual
  FROM sides WHERE played
)"""


def _elo_sql(step: str, pulled: str) -> str:
    """Ratings of every team as read on day d of its competition."""
    return f"""{_SIDES}, st AS (
  SELECT DISTINCT c, 1::BIGINT AS d, team, 1500e0 AS r FROM sides
  UNION ALL
  SELECT c, d + 1, team, CASE WHEN {pulled} THEN 1500 + keep * (r - 1500) ELSE r END FROM (
    SELECT s.c, s.d, s.team, s.r + coalesce(sum(x.step * x.times * (x.actual - 1 / (1 + power(10e0, (o.r - s.r - x.way * 100) / 400e0)))), 0) AS r
    FROM st s LEFT JOIN (SELECT *, {step} AS step FROM steps) x ON x.c = s.c AND x.d = s.d AND x.team = s.team
    LEFT JOIN st o ON o.c = x.c AND o.team = x.opp GROUP BY s.c, s.d, s.team, s.r) t
  WHERE EXISTS (SELECT 1 FROM opened n WHERE n.c = t.c AND n.d = t.d + 1)
)"""


_PULL_TEAM = "EXISTS (SELECT 1 FROM entered n WHERE n.c = t.c AND n.team = t.team AND n.d = t.d + 1 AND n.season <> n.before)"
_READ = """SELECT m.fixture_id, round(h.r, 4) + 0e0 AS home_rating, round(a.r, 4) + 0e0 AS away_rating FROM days m
JOIN st h ON h.c = m.competition_id AND h.d = m.d AND h.team = m.home_id JOIN st a ON a.c = m.competition_id AND a.d = m.d AND a.team = m.away_id"""
Q1_SQL = "WITH RECURSIVE " + _elo_sql("20e0", "false").replace("keep", "1") + _READ
_DYNAMIC = f"""WITH RECURSIVE {_SIDES}, st AS (
  SELECT DISTINCT c, 1::BIGINT AS d, team, 1500e0 AS r, 1500e0 AS att, 1500e0 AS def FROM sides
  UNION ALL
  SELECT c, d + 1, team, 1500 + keep * (r - 1500), 1500 + keep * (att - 1500), 1500 + keep * (def - 1500) FROM (
    SELECT *, CASE WHEN {_PULL_TEAM} THEN 0.85e0 ELSE 1e0 END AS keep FROM (
      SELECT s.c, s.d, s.team,
        s.r + coalesce(sum(20 * (1 + 1.5e0 / sqrt(x.n + 1)) * x.times * (x.actual - 1 / (1 + power(10e0, (o.r - s.r - x.way * 100) / 400e0)))), 0) AS r,
        s.att + coalesce(sum(5 * (x.gf - exp(x.way * 0.15e0 + (s.att - o.def) / 400e0))), 0) AS att,
        s.def - coalesce(sum(5 * (x.ga - exp(-x.way * 0.15e0 + (o.att - s.def) / 400e0))), 0) AS def
      FROM st s LEFT JOIN steps x ON x.c = s.c AND x.d = s.d AND x.team = s.team
      LEFT JOIN st o ON o.c = x.c AND o.team = x.opp GROUP BY s.c, s.d, s.team, s.r, s.att, s.def) t
    WHERE EXISTS (SELECT 1 FROM opened n WHERE n.c = t.c AND n.d = t.d + 1)) t
), seen AS (
  SELECT e.c, e.d, e.team, 20 * (1 + 1.5e0 / sqrt(1 + coalesce(sum(p.n) OVER (PARTITION BY e.c, e.team ORDER BY e.d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS step
  FROM entered e LEFT JOIN (SELECT c, d, team, count(*) AS n FROM steps GROUP BY c, d, team) p ON p.c = e.c AND p.d = e.d AND p.team = e.team
)
SELECT m.fixture_id, round(h.r, 4) + 0e0 AS home_rating, round(a.r, 4) + 0e0 AS away_rating, round(x.step, 4) + 0e0 AS home_step, round(y.step, 4) + 0e0 AS away_step,
  round(h.att, 4) + 0e0 AS home_attack, round(h.def, 4) + 0e0 AS home_defence, round(a.att, 4) + 0e0 AS away_attack, round(a.def, 4) + 0e0 AS away_defence
FROM days m
JOIN st h ON h.c = m.competition_id AND h.d = m.d AND h.team = m.home_id JOIN st a ON a.c = m.competition_id AND a.d = m.d AND a.team = m.away_id
JOIN seen x ON x.c = m.competition_id AND x.d = m.d AND x.team = m.home_id JOIN seen y ON y.c = m.competition_id AND y.d = m.d AND y.team = m.away_id"""


def four_digits(rated):
    return rated.select("fixture_id", *(F.round(c, 4).alias(c) for c in rated.columns if c != "fixture_id"))


@query(Q1_SQL)
def q1_elo(spark, sf):
    return four_digits(ratings.rated(contests(spark, sf)))


_ONE = _SIDES.replace("PARTITION BY competition_id ORDER BY unix", "ORDER BY unix").replace("SELECT competition_id AS c", "SELECT 0 AS c").replace("SELECT competition_id, d", "SELECT 0, d")
_EVERY_TEAM = f"""WITH RECURSIVE {_ONE}, openings AS (SELECT d, count(*) AS times FROM (SELECT min(d) AS d FROM days GROUP BY season_id) GROUP BY d), st AS (
  SELECT DISTINCT c, 1::BIGINT AS d, team, 1500e0 AS r FROM sides
  UNION ALL
  SELECT c, d + 1, team, 1500 + power(0.8e0, coalesce((SELECT times FROM openings o WHERE o.d = t.d + 1), 0)) * (r - 1500) FROM (
    SELECT s.c, s.d, s.team, s.r + coalesce(sum(24 * x.times * (x.actual - 1 / (1 + power(10e0, (o.r - s.r - x.way * 100) / 400e0)))), 0) AS r
    FROM st s LEFT JOIN steps x ON x.c = s.c AND x.d = s.d AND x.team = s.team
    LEFT JOIN st o ON o.c = x.c AND o.team = x.opp GROUP BY s.c, s.d, s.team, s.r) t
  WHERE EXISTS (SELECT 1 FROM opened n WHERE n.c = t.c AND n.d = t.d + 1)
)
SELECT m.fixture_id, round(h.r, 4) + 0e0 AS home_rating, round(a.r, 4) + 0e0 AS away_rating FROM days m
JOIN st h ON h.d = m.d AND h.team = m.home_id JOIN st a ON a.d = m.d AND a.team = m.away_id"""


@query(_EVERY_TEAM)
def q2_elo_mean_reversion(spark, sf):
    """Q2: all ratings go part of the way back to the start whenever a season begins in any competition."""
    c = contests(spark, sf)
    return four_digits(ratings.rated(c, partial(ratings.Elo, k=24.0, gamma=0.2, openings=ratings.season_openings(c))))


@query(_DYNAMIC)
def q3_dynamic_elo(spark, sf):
    """Q3: steps that shrink with a team's contests, a pull back in each team's new season, attack and defence ratings."""
    return four_digits(ratings.rated(contests(spark, sf), ratings.DynamicElo))


@query()
def q4_attack_defence(spark, sf):
    return ratings.rated(contests(spark, sf), ratings.AttackDefence)


@query()
def q5_dynamic_attack_defence(spark, sf):
    """Q5: attack and defence with variances, venue states and implied goal rates."""
    return ratings.rated(contests(spark, sf), ratings.DynamicAttackDefence)


@query("WITH RECURSIVE " + _elo_sql("20e0", "false").replace("keep", "1") + """, both_sides AS (
  SELECT m.fixture_id, m.unix, m.season_year, st.team, round(st.r, 4) AS state FROM days m JOIN st ON st.c = m.competition_id AND st.d = m.d AND st.team IN (m.home_id, m.away_id)
), latest AS (SELECT team, arg_max(state, (unix, fixture_id)) AS state, count(*) AS n FROM both_sides WHERE season_year >= 1998 AND team % 3 <> 0 GROUP BY team
), bridge AS (SELECT team, arg_max(state, (unix, fixture_id)) AS state FROM both_sides WHERE season_year < 1998 AND team % 7 <> 0 GROUP BY team)
SELECT t.team AS team_id, coalesce(l.state, b.state, 1500) + 0e0 AS state, CASE WHEN l.team IS NOT NULL THEN 'history' WHEN b.team IS NOT NULL THEN 'bridge' ELSE 'default' END AS method,
  coalesce(l.n, 0) AS rows FROM (SELECT DISTINCT team FROM sides) t LEFT JOIN latest l USING (team) LEFT JOIN bridge b USING (team)""")
def q7_cold_start(spark, sf):
    """Each team's latest rating, else an earlier season's, else the start."""
    c = contests(spark, sf)
    rated = four_digits(ratings.rated(c)).join(c.select("fixture_id", "unix", "season_year", "home_id", "away_id"), "fixture_id")
    sides = rated.select("fixture_id", "unix", "season_year", F.col("home_id").alias("team_id"), F.col("home_rating").alias("state")).unionByName(
        rated.select("fixture_id", "unix", "season_year", F.col("away_id").alias("team_id"), F.col("away_rating").alias("state"))
    )
    latest = joins.latest_state(sides.where("season_year >= 1998 and team_id % 3 != 0"), "team_id", "state", ["unix", "fixture_id"])
    bridge = joins.latest_state(sides.where("season_year < 1998 and team_id % 7 != 0"), "team_id", "state", ["unix", "fixture_id"])
    return ratings.cold_start(history.team_rows(c).select("team_id").distinct(), latest, bridge)


@query()
def q8_rating_diagnostics(spark, sf):
    return ratings.diagnostics(ratings.rated(contests(spark, sf), ratings.AttackDefence), list(ratings.AttackDefence.columns))
