"""Queries of the probability functions."""

from __future__ import annotations

from math import lgamma

from pyspark.sql import functions as F

from matchweave.functions import probability as fn
from matchweave.plans.base import query, r
from matchweave.sources.bindings import ODDS, PREDS, odds, predictions

P, Q = ["p_home", "p_draw", "p_away"], ["q_home", "q_draw", "q_away"]


def c(*names):
    return [F.col(n) for n in names]


@query(f"WITH {PREDS} SELECT fixture_id, y_true, home_goals, away_goals FROM preds")
def p3_labels(spark, sf):
    from matchweave.operators.history import result

    return predictions(spark, sf).select("fixture_id", result(F.col("home_goals"), F.col("away_goals")).alias("y_true"), "home_goals", "away_goals")


@query(
    f"""WITH {PREDS}, s AS (SELECT fixture_id, p_home - 0.3 AS a, p_draw - 0.3 AS b, p_away - 0.3 AS c FROM preds),
 k AS (SELECT fixture_id, greatest(a, 0) AS a, greatest(b, 0) AS b, greatest(c, 0) AS c FROM s)
SELECT fixture_id, {r('CASE WHEN a+b+c = 0 THEN 1/3e0 ELSE a/(a+b+c) END', 'n_home')}, {r('CASE WHEN a+b+c = 0 THEN 1/3e0 ELSE b/(a+b+c) END', 'n_draw')},
 {r('CASE WHEN a+b+c = 0 THEN 1/3e0 ELSE c/(a+b+c) END', 'n_away')} FROM k"""
)
def f12_normalize(spark, sf):
    h, d, a = fn.normalized(*(x - 0.3 for x in c(*P)))
    return predictions(spark, sf).select("fixture_id", h.alias("n_home"), d.alias("n_draw"), a.alias("n_away"))


@query(
    f"""WITH {PREDS} SELECT fixture_id,
 CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END AS pick_hda,
 CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_away >= p_draw THEN 'A' ELSE 'D' END AS pick_had FROM preds"""
)
def f13_argmax(spark, sf):
    return predictions(spark, sf).select("fixture_id", fn.argmax(*c(*P)).alias("pick_hda"), fn.argmax(*c(*P), ties="HAD").alias("pick_had"))


@query(
    f"""WITH {PREDS} SELECT fixture_id, {r('ln(p_draw / (1 - p_draw))', 'logit_draw')}, {r('1 / (1 + exp(-elo_diff / 100))', 'sig')},
 {r('exp(lambda_home) / (exp(lambda_home) + exp(lambda_away) + exp(1e0))', 'soft_home')} FROM preds"""
)
def f14_logit_sigmoid_softmax(spark, sf):
    soft = fn.softmax(F.col("lambda_home"), F.col("lambda_away"), F.lit(1.0))
    return predictions(spark, sf).select(
        "fixture_id", fn.logit(F.col("p_draw")).alias("logit_draw"), fn.sigmoid(F.col("elo_diff") / 100).alias("sig"), soft[0].alias("soft_home")
    )


def _grid(k: int) -> str:
    lf = ", ".join(f"({i}, {lgamma(i + 1.0)!r})" for i in range(k + 1))
    return f"""lf(i, l) AS (VALUES {lf}), grid AS (
 SELECT fixture_id, lambda_home AS lh, lambda_away AS la, h.i, a.i AS j, exp(h.i * ln(lambda_home) - lambda_home - h.l) AS ph, exp(a.i * ln(lambda_away) - lambda_away - a.l) AS pa
 FROM preds, lf h, lf a)"""


_WIDE = """cells AS (SELECT k, unnest(range(0, (SELECT 60 + ceil(max(greatest(lh, la)) * 3)::INT FROM rates))) AS i),
 terms AS (SELECT k, i, exp(i * ln(lh) - lh - lgamma(i + 1)) AS p, exp(i * ln(la) - la - lgamma(i + 1)) AS q FROM rates JOIN cells USING (k)),
 upto AS (SELECT *, coalesce(sum(p) OVER before, 0) AS below_p, coalesce(sum(q) OVER before, 0) AS below_q FROM terms
  WINDOW before AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s AS (SELECT k, sum(p * below_q) AS w, sum(p * q) AS d, sum(q * below_p) AS l, max(p) * max(q) AS top, arg_min(i, (-p, i)) AS mh, arg_min(i, (-q, i)) AS ma FROM upto GROUP BY k)"""


@query(
    f"""WITH {PREDS}, rates AS (SELECT fixture_id AS k, lambda_home AS lh, lambda_away AS la FROM preds), {_WIDE.replace('SELECT k, unnest', 'SELECT fixture_id AS k, unnest').replace(') AS i),', ') AS i FROM preds),', 1)}
SELECT k AS fixture_id, {r('w', 'win')}, {r('d', 'draw')}, {r('l', 'loss')}, CASE WHEN w >= d AND w >= l THEN 'H' WHEN d >= l THEN 'D' ELSE 'A' END AS pick,
 mh || '-' || ma AS modal, {r('top', 'modal_p')}, true AS safe FROM s"""
)
def f15_poisson_table(spark, sf):
    """The tail-safe Poisson table with a grid length of each row's own, likeliest score and safety gates."""
    rates = F.col("lambda_home"), F.col("lambda_away")
    table = fn.poisson_table(F.col("sums"), *rates)
    return predictions(spark, sf).withColumn("sums", fn.tail_safe_sums(*rates)).select(
        "fixture_id", *(table[k].alias(k) for k in ("win", "draw", "loss", "pick", "modal", "modal_p", "safe"))
    )


@query(
    f"""WITH {PREDS}, legs AS (SELECT competition_id, n, lh, la, row_number() OVER (ORDER BY competition_id, n) AS k FROM (
  SELECT competition_id, fixture_id % 30 + 1 AS n, sum(lambda_home) AS lh, sum(lambda_away) AS la FROM preds WHERE fixture_id // 30 < (SELECT min(fixture_id) // 30 + 12 FROM preds) GROUP BY ALL)),
 rates AS (SELECT k, lh, la FROM legs), {_WIDE.replace('SELECT k, unnest', 'SELECT k, unnest').replace(') AS i),', ') AS i FROM rates),', 1)}
SELECT competition_id, n, {r('lh', 'rate_home')}, {r('la', 'rate_away')}, {r('w', 'win')}, {r('d', 'draw')}, {r('l', 'loss')}, {r('top', 'modal_p')}, true AS safe FROM legs JOIN s USING (k)"""
)
def f15_series_totals(spark, sf):
    """F15 to F18 at high rates: who scores more over a series of contests, from the sums of their rates."""
    first = F.broadcast(predictions(spark, sf).agg(F.floor(F.min("fixture_id") / 30).alias("first")))
    legs = predictions(spark, sf).crossJoin(first).where(F.floor(F.col("fixture_id") / 30) < F.col("first") + 12)
    rates = legs.groupBy("competition_id", (F.col("fixture_id") % 30 + 1).alias("n")).agg(F.sum("lambda_home").alias("rate_home"), F.sum("lambda_away").alias("rate_away"))
    table = fn.poisson_table(F.col("sums"), F.col("rate_home"), F.col("rate_away"))
    return rates.withColumn("sums", fn.tail_safe_sums(F.col("rate_home"), F.col("rate_away"))).select(
        "competition_id", "n", "rate_home", "rate_away", *(table[k].alias(k) for k in ("win", "draw", "loss", "modal_p", "safe"))
    )


_TAU = """CASE WHEN i = 0 AND j = 0 THEN greatest(1 - lh * la * {rho}, 0) WHEN i = 0 AND j = 1 THEN 1 + lh * {rho} WHEN i = 1 AND j = 0 THEN 1 + la * {rho}
 WHEN i = 1 AND j = 1 THEN 1 - {rho} ELSE 1 END"""


@query(
    f"""WITH {PREDS}, {_grid(15)}, t AS (SELECT fixture_id, i, j, ph * pa * greatest({_TAU.format(rho='(-0.08)')}, 0) AS p FROM grid)
SELECT fixture_id, {r('sum(CASE WHEN i > j THEN p END) / sum(p)', 'win')}, {r('sum(CASE WHEN i = j THEN p END) / sum(p)', 'draw')},
 {r('sum(CASE WHEN i < j THEN p END) / sum(p)', 'loss')} FROM t GROUP BY fixture_id"""
)
def f20_corrected_grid(spark, sf):
    """Low-score corrected outcome probabilities, in closed form."""
    rates = F.col("lambda_home"), F.col("lambda_away")
    w, d, x = fn.corrected_outcomes(F.col("sums"), *rates, -0.08)
    return predictions(spark, sf).withColumn("sums", fn.score_sums(*rates, 15)).select("fixture_id", w.alias("win"), d.alias("draw"), x.alias("loss"))


@query(
    f"""WITH {PREDS}, {_grid(6)} SELECT i AS home_goals, j AS away_goals, count(*) AS n, {r('avg(ph * pa)', 'mean_p')} FROM grid GROUP BY i, j"""
)
def x6_score_cells(spark, sf):
    """One row for each cell of the score grid, averaged over contests."""
    p = predictions(spark, sf).select(fn.poisson_pmf(F.col("lambda_home"), 6).alias("ph"), fn.poisson_pmf(F.col("lambda_away"), 6).alias("pa"))
    cells = p.select("pa", F.posexplode("ph").alias("home_goals", "h")).select("home_goals", "h", F.posexplode("pa").alias("away_goals", "a"))
    return cells.groupBy("home_goals", "away_goals").agg(F.count("*").alias("n"), F.avg(F.col("h") * F.col("a")).alias("mean_p"))


@query(
    f"""WITH {PREDS}, {_grid(15)}, b AS (SELECT fixture_id, lh, la, sum(CASE WHEN i = j THEN ph * pa END) AS d FROM grid GROUP BY ALL)
SELECT fixture_id, {r('least(greatest(d + 0.08 * lh * la * exp(-lh - la) * 2, 1e-6), 1 - 1e-6)', 'draw')} FROM b"""
)
def f22_draw_with_dependence(spark, sf):
    return predictions(spark, sf).select("fixture_id", fn.draw_with_dependence(F.col("lambda_home"), F.col("lambda_away"), -0.08).alias("draw"))


@query(
    f"""WITH {PREDS}, e AS (SELECT *, 0.28 * exp(-0.0006 * abs(elo_diff)) AS ed FROM preds),
 s AS (SELECT *, 1 / (1 + exp(-(0.6 * ln(p_draw / (1 - p_draw)) + 0.4 * ln(ed / (1 - ed))))) AS st FROM e)
SELECT fixture_id, {r('exp(-elo_diff * elo_diff / 20000)', 'parity')}, {r('ed', 'elo_draw')}, {r('st', 'stacked')},
 {r('(1 - st) * p_home / (p_home + p_away)', 'home')}, {r('(1 - st) * p_away / (p_home + p_away)', 'away')} FROM s"""
)
def f24_draw_stack(spark, sf):
    """Parity, rating-gap draw curve, logit stack and redistribution of the draw mass."""
    ed = fn.elo_draw(F.col("elo_diff"))
    st = fn.sigmoid(0.6 * fn.logit(F.col("p_draw")) + 0.4 * fn.logit(ed))
    h, _, a = fn.redistribute(F.col("p_home"), F.col("p_away"), F.col("st"))
    return predictions(spark, sf).withColumn("st", st).select(
        "fixture_id", F.exp(-F.col("elo_diff") * F.col("elo_diff") / 20000).alias("parity"), ed.alias("elo_draw"), F.col("st").alias("stacked"), h.alias("home"), a.alias("away")
    )


@query(
    f"""WITH {PREDS}, s AS (SELECT *, list_sort([p_home, p_draw, p_away]) AS o, (p_home + q_home) / 2 AS mh, (p_draw + q_draw) / 2 AS md, (p_away + q_away) / 2 AS ma FROM preds)
SELECT fixture_id, {r('-p_home * ln(p_home) - p_draw * ln(p_draw) - p_away * ln(p_away)', 'entropy')}, {r('o[3] - o[2]', 'margin')}, {r('o[3] - o[1]', 'spread')},
 {r('p_home * p_home + p_draw * p_draw + p_away * p_away', 'herfindahl')},
 {r('((p_home * ln(p_home / mh) + p_draw * ln(p_draw / md) + p_away * ln(p_away / ma)) + (q_home * ln(q_home / mh) + q_draw * ln(q_draw / md) + q_away * ln(q_away / ma))) / 2', 'js')},
 {r('(abs(p_home - q_home) + abs(p_draw - q_draw) + abs(p_away - q_away)) / 3', 'mean_gap')} FROM s"""
)
def f28_geometry(spark, sf):
    """entropy, margin, spread, concentration, divergence between two models."""
    p, q = c(*P), c(*Q)
    return predictions(spark, sf).select(
        "fixture_id",
        fn.entropy(*p).alias("entropy"),
        fn.margin(*p).alias("margin"),
        (F.greatest(*p) - F.least(*p)).alias("spread"),
        (p[0] * p[0] + p[1] * p[1] + p[2] * p[2]).alias("herfindahl"),
        fn.js_divergence(p, q).alias("js"),
        ((F.abs(p[0] - q[0]) + F.abs(p[1] - q[1]) + F.abs(p[2] - q[2])) / 3).alias("mean_gap"),
    )


def wide_odds(spark, sf):
    return odds(spark, sf).groupBy("fixture_id").pivot("outcome", ["home", "draw", "away"]).agg(F.first("closing", ignorenulls=True))


_WIDE = f"""WITH {ODDS}, w AS (SELECT fixture_id, max(closing) FILTER (outcome = 'home') AS h, max(closing) FILTER (outcome = 'draw') AS d,
 max(closing) FILTER (outcome = 'away') AS a FROM odds GROUP BY fixture_id)"""


@query(f"{_WIDE} SELECT fixture_id, {r('1/h + 1/d + 1/a', 'overround')}, {r('1/h / (1/h + 1/d + 1/a)', 'i_home')}, {r('1/d / (1/h + 1/d + 1/a)', 'i_draw')}, {r('1/a / (1/h + 1/d + 1/a)', 'i_away')} FROM w")
def f30_overround(spark, sf):
    p, total = fn.implied(F.col("home"), F.col("draw"), F.col("away"))
    return wide_odds(spark, sf).select("fixture_id", total.alias("overround"), *(x.alias(n) for x, n in zip(p, ("i_home", "i_draw", "i_away"), strict=True)))


@query(
    f"""{_WIDE}, v AS (SELECT fixture_id, h, d, a, h > 1 AND d > 1 AND a > 1 AS ok FROM w),
 b AS (SELECT fixture_id, h, d, a, ok, list_reduce(list_prepend([0.01e0, 20e0], list_transform(range(60), lambda x: [0e0, 0e0])),
  lambda s, x: CASE WHEN power(1/h, (s[1] + s[2]) / 2) + power(1/d, (s[1] + s[2]) / 2) + power(1/a, (s[1] + s[2]) / 2) > 1
   THEN [(s[1] + s[2]) / 2, s[2]] ELSE [s[1], (s[1] + s[2]) / 2] END) AS s FROM v WHERE ok)
SELECT v.fixture_id, {r('(s[1] + s[2]) / 2', 'k')}, {r('power(1/b.h, (s[1] + s[2]) / 2)', 'd_home')}, {r('power(1/b.d, (s[1] + s[2]) / 2)', 'd_draw')},
 {r('power(1/b.a, (s[1] + s[2]) / 2)', 'd_away')} FROM v LEFT JOIN b ON b.fixture_id = v.fixture_id"""
)
def f31_power_devig(spark, sf):
    sides = ("home", "draw", "away")
    found = wide_odds(spark, sf).withColumn("k", fn.power_exponent(*(F.col(c) for c in sides)))
    return found.select("fixture_id", "k", *(F.pow(1 / F.col(c), F.col("k")).alias(f"d_{c}") for c in sides))


@query(
    f"""WITH {PREDS}, b AS (SELECT fixture_id, power(p_home, 0.3) * power(q_home, 0.7) AS h, power(p_draw, 0.3) * power(q_draw, 0.7) AS d, power(p_away, 0.3) * power(q_away, 0.7) AS a,
 power(p_home, 1/1.5e0) AS th, power(p_draw, 1/1.5e0) AS td, power(p_away, 1/1.5e0) AS ta FROM preds)
SELECT fixture_id, {r('h/(h+d+a)', 'b_home')}, {r('d/(h+d+a)', 'b_draw')}, {r('a/(h+d+a)', 'b_away')},
 {r('th/(th+td+ta)', 't_home')}, {r('td/(th+td+ta)', 't_draw')}, {r('ta/(th+td+ta)', 't_away')} FROM b"""
)
def f32_blend_and_temperature(spark, sf):
    """Log-linear blend and temperature."""
    b, t = fn.blend(c(*P), c(*Q), 0.3), fn.temperature(c(*P), 1.5)
    names = ["b_home", "b_draw", "b_away", "t_home", "t_draw", "t_away"]
    return predictions(spark, sf).select("fixture_id", *(x.alias(n) for x, n in zip([*b, *t], names, strict=True)))


@query(
    f"""WITH {PREDS}, m AS (SELECT avg(elo_diff) AS mu, max(unix) AS ref FROM preds)
SELECT fixture_id, {r('(elo_diff - mu) * (elo_diff - mu)', 'quadratic')}, {r('exp(-0.001 * greatest(ref - unix, 0) / 86400)', 'weight')},
 {r('home_goals / (home_goals + 3e0)', 'shrink')}, {r('1 / (1 + power(10e0, (-elo_diff - 100) / 400))', 'expected')},
 {r('CASE WHEN abs(home_goals - away_goals) <= 1 THEN 1 WHEN abs(home_goals - away_goals) = 2 THEN 1.5 ELSE (11 + abs(home_goals - away_goals)) / 8e0 END', 'multiplier')} FROM preds, m"""
)
def f33_weights(spark, sf):
    """shrinkage, time decay, centred quadratic, rating expectation and margin."""
    p = predictions(spark, sf)
    m = p.agg(F.avg("elo_diff").alias("mu"), F.max("unix").alias("ref"))
    gap = F.col("elo_diff") - F.col("mu")
    return p.crossJoin(F.broadcast(m)).select(
        "fixture_id",
        (gap * gap).alias("quadratic"),
        fn.decay_weight(F.col("unix"), F.col("ref"), 0.001).alias("weight"),
        fn.shrinkage(F.col("home_goals"), 3.0).alias("shrink"),
        fn.elo_expected(F.col("elo_diff"), F.lit(0.0)).alias("expected"),
        fn.goal_multiplier(F.col("home_goals") - F.col("away_goals")).alias("multiplier"),
    )


@query(
    f"""WITH {PREDS}, t AS (SELECT fixture_id, [p_home - q_home, p_draw - q_draw, p_away - q_away, lambda_home - lambda_away] AS x FROM preds)
SELECT fixture_id, {r('abs(x[4])', 'closeness')}, {r('abs(list_sum(x)) / list_sum(list_transform(x, lambda y: abs(y)))', 'cancellation')} FROM t"""
)
def f42_closeness_and_cancellation(spark, sf):
    terms = [F.col(f"p_{k}") - F.col(f"q_{k}") for k in ("home", "draw", "away")] + [F.col("lambda_home") - F.col("lambda_away")]
    total, spread = sum(terms[1:], terms[0]), sum((F.abs(t) for t in terms[1:]), F.abs(terms[0]))
    return predictions(spark, sf).select(
        "fixture_id", F.abs(terms[3]).alias("closeness"), F.when(spread > 0, F.abs(total) / spread).alias("cancellation")
    )


@query(
    f"""WITH {PREDS}, {_grid(10)}, o AS (SELECT fixture_id, sum(CASE WHEN i > j THEN ph * pa END) / sum(ph * pa) AS w, sum(CASE WHEN i = j THEN ph * pa END) / sum(ph * pa) AS d FROM grid GROUP BY fixture_id)
SELECT fixture_id, {r('0.94e0 * w', 'win')}, {r('0.94e0 * d + 0.06e0', 'draw')}, {r('0.94e0 * (1 - w - d)', 'loss')} FROM o"""
)
def f23_diagonal_inflation(spark, sf):
    """a share of the mass moved onto the draws of the 0..10 goal grid."""
    rates = F.col("lambda_home"), F.col("lambda_away")
    w, d, x = fn.inflated(*fn.corrected_outcomes(F.col("sums"), *rates, 0.0), 0.06)
    return predictions(spark, sf).withColumn("sums", fn.score_sums(*rates, 10)).select("fixture_id", w.alias("win"), d.alias("draw"), x.alias("loss"))


@query(f"WITH {PREDS} SELECT fixture_id, {r('lambda_home * exp(greatest(least(elo_diff / 1000, 0.15), -0.15))', 'home')}, {r('lambda_away * exp(greatest(least(-elo_diff / 1000, 0.15), -0.15))', 'away')} FROM preds")
def f35_bounded_adjustment(spark, sf):
    shift = F.col("elo_diff") / 1000
    return predictions(spark, sf).select(
        "fixture_id", fn.bounded_rate(F.col("lambda_home"), shift, 0.15).alias("home"), fn.bounded_rate(F.col("lambda_away"), -shift, 0.15).alias("away")
    )
