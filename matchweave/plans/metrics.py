"""Queries of scoring, calibration and aggregation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchweave.functions.probability import argmax, wilson
from matchweave.operators import metrics as m
from matchweave.plans.base import query, r
from matchweave.sources.bindings import CONTESTS, ODDS, PREDS, contests, odds, predictions

Q = ("q_home", "q_draw", "q_away")
ORDER, MONTH = ["unix", "fixture_id"], "floor(unix / 2592000)"
PICK = "CASE WHEN {h} >= {d} AND {h} >= {a} THEN 'H' WHEN {d} >= {a} THEN 'D' ELSE 'A' END"
PICK_P, PICK_Q = PICK.format(h="p_home", d="p_draw", a="p_away"), PICK.format(h="q_home", d="q_draw", a="q_away")
TRUE_P = "CASE y_true WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END"
LL = f"-ln(least(greatest({TRUE_P}, 1e-15), 1 - 1e-15))"
BRIER = "power(p_home - (y_true = 'H')::INT, 2) + power(p_draw - (y_true = 'D')::INT, 2) + power(p_away - (y_true = 'A')::INT, 2)"
RPS = "(power(p_home - (y_true = 'H')::INT, 2) + power(p_home + p_draw - (y_true IN ('H', 'D'))::INT, 2)) / 2"
SCORED = f"WITH {PREDS}, s AS (SELECT *, {PICK_P} AS pick, {PICK_Q} AS pick_q, {LL} AS ll, {BRIER} AS br, {RPS} AS rps FROM preds)"


def _card(group: str) -> str:
    each = []
    for v in "HDA":
        tp, pk, tr = f"count(*) FILTER (y_true = '{v}' AND pick = '{v}')", f"count(*) FILTER (pick = '{v}')", f"count(*) FILTER (y_true = '{v}')"
        each.append(f"{pk} AS pick_{v}, {tr} AS true_{v}, CASE WHEN {pk} > 0 THEN {tp} / {pk}::DOUBLE ELSE 0 END AS pr_{v}, CASE WHEN {tr} > 0 THEN {tp} / {tr}::DOUBLE ELSE 0 END AS re_{v}, CASE WHEN {pk} + {tr} > 0 THEN 2 * {tp} / ({pk} + {tr})::DOUBLE ELSE 0 END AS f_{v}")
    inner = f"SELECT {group} count(*) AS n, avg((y_true = pick)::INT) AS acc, avg(ll) AS ll, avg(br) AS br, avg(rps) AS rp, {', '.join(each)} FROM s" + (f" GROUP BY {group.strip(', ')}" if group else "")
    return (
        f"{SCORED}, g AS ({inner}) SELECT {group} n, {r('acc', 'accuracy')}, {r('ll', 'log_loss')}, {r('br', 'brier')}, {r('rp', 'rps')}, "
        + ", ".join(f"pick_{v}, true_{v}, {r(f'pr_{v}', f'precision_{v}')}, {r(f're_{v}', f'recall_{v}')}, {r(f'f_{v}', f'f1_{v}')}" for v in "HDA")
        + f", {r('(f_H + f_D + f_A) / 3', 'macro_f1')}, {r('(re_H + re_D + re_A) / 3', 'balanced_accuracy')} FROM g"
    )


@query(_card(""))
def m17_scorecard(spark, sf):
    """The whole scorecard in one aggregate."""
    return m.scorecard(predictions(spark, sf))


@query(_card("competition_id, season_year, "))
def m33_group_scorecards(spark, sf):
    """The scorecard of every competition and season."""
    return m.scorecard(predictions(spark, sf), ["competition_id", "season_year"])


@query(f"{SCORED} SELECT coalesce(y_true, 'all') AS y, coalesce(pick, 'all') AS pick, count(*) AS n FROM s GROUP BY CUBE (y_true, pick)")
def a12_confusion(spark, sf):
    return m.confusion(predictions(spark, sf))


@query(
    f"""{SCORED} SELECT {r("avg((y_true = 'H')::INT)", 'f_home')}, {r("avg((y_true = 'D')::INT)", 'f_draw')}, {r("avg((y_true = 'A')::INT)", 'f_away')},
 (SELECT y_true FROM s GROUP BY y_true ORDER BY count(*) DESC, CASE y_true WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END LIMIT 1) AS majority,
 {r('avg(home_goals)', 'mean_home')}, {r('avg(away_goals)', 'mean_away')} FROM s"""
)
def a2_class_frequencies(spark, sf):
    """A2, A3, A4, A5: class frequencies, majority class and base scoring rates."""
    share = {v: F.avg((F.col("y_true") == v).cast("double")) for v in "HDA"}
    found = predictions(spark, sf).agg(
        share["H"].alias("f_home"), share["D"].alias("f_draw"), share["A"].alias("f_away"), F.avg("home_goals").alias("mean_home"), F.avg("away_goals").alias("mean_away")
    )
    return found.withColumn("majority", argmax(F.col("f_home"), F.col("f_draw"), F.col("f_away")))


@query("WITH " + CONTESTS + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS missing, {r(f'avg(({c} IS NULL)::INT)', 'share')} FROM contests" for c in ("home_goals", "home_xg", "home_shots")))
def a6_null_rates(spark, sf):
    columns = ("home_goals", "home_xg", "home_shots")
    one = contests(spark, sf).agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(c)).alias("missing")) for c in columns))
    return one.select("n", F.explode(cells).alias("x")).select("x.column", "n", "x.missing", (F.col("x.missing") / F.col("n")).alias("share"))


@query(
    "WITH " + CONTESTS + f""" SELECT competition_id, season_id, count(*) AS total, count(home_xg) AS covered, {r('count(home_xg) / count(*)::DOUBLE', 'share')},
 grouping(competition_id, season_id) AS level FROM contests GROUP BY GROUPING SETS ((competition_id, season_id), (competition_id), ())"""
)
def a8_coverage(spark, sf):
    """Coverage per league and season, per league, and pooled, in one pass."""
    found = contests(spark, sf).rollup("competition_id", "season_id").agg(
        F.count("*").alias("total"), F.count("home_xg").alias("covered"), F.grouping_id().alias("level")
    )
    return found.withColumn("share", F.col("covered") / F.col("total"))


@query(
    f"""WITH {ODDS}, g AS (SELECT fixture_id, competition_id, bookmaker_id, count(closing) AS k, count(opening) AS o FROM odds GROUP BY ALL)
SELECT bookmaker_id, count(*) AS fixtures, count(*) FILTER (k = 3) AS complete, count(*) FILTER (o > 0 AND k > 0) AS both, count(*) FILTER (o > 0 AND k = 0) AS opening_only,
 count(*) FILTER (o = 0 AND k > 0) AS closing_only, count(*) FILTER (o = 0 AND k = 0) AS neither FROM g GROUP BY bookmaker_id"""
)
def a10_odds_audit(spark, sf):
    """Complete markets, and where opening and closing odds are there."""
    g = odds(spark, sf).groupBy("fixture_id", "competition_id", "bookmaker_id").agg(F.count("closing").alias("k"), F.count("opening").alias("o"))
    return g.groupBy("bookmaker_id").agg(
        F.count("*").alias("fixtures"),
        F.count_if(F.col("k") == 3).alias("complete"),
        F.count_if((F.col("o") > 0) & (F.col("k") > 0)).alias("both"),
        F.count_if((F.col("o") > 0) & (F.col("k") == 0)).alias("opening_only"),
        F.count_if((F.col("o") == 0) & (F.col("k") > 0)).alias("closing_only"),
        F.count_if((F.col("o") == 0) & (F.col("k") == 0)).alias("neither"),
    )


@query(
    f"""{SCORED}, g AS (SELECT competition_id, season_year, avg(ll) AS ll, sum(ll) AS total FROM s GROUP BY ALL)
SELECT competition_id, count(*) AS folds, {r('avg(ll)', 'mean_ll')}, {r('stddev_pop(ll)', 'sd_ll')}, {r('min(ll)', 'low')}, {r('max(ll)', 'high')}, {r('max(ll) - min(ll)', 'spread')},
 arg_max(season_year, ll) AS worst_season, {r('sum(total) / (SELECT sum(total) FROM g)', 'loss_share')} FROM g GROUP BY competition_id"""
)
def a14_fold_summary(spark, sf):
    """folds' mean and population deviation, worst fold, share of the whole loss."""
    g = predictions(spark, sf).groupBy("competition_id", "season_year").agg(F.avg(m.log_loss()).alias("ll"), F.sum(m.log_loss()).alias("total"))
    found = g.groupBy("competition_id").agg(
        F.count("*").alias("folds"),
        F.avg("ll").alias("mean_ll"),
        F.stddev_pop("ll").alias("sd_ll"),
        F.min("ll").alias("low"),
        F.max("ll").alias("high"),
        F.max_by("season_year", "ll").alias("worst_season"),
        F.sum("total").alias("t"),
    )
    whole = g.agg(F.sum("total").alias("whole"))
    return found.crossJoin(F.broadcast(whole)).withColumns({"spread": F.col("high") - F.col("low"), "loss_share": F.col("t") / F.col("whole")}).drop("t", "whole")


def _bins(value: str, style: str = "left") -> str:
    op = ">" if style == "right" else ">="
    return " + ".join(f"({value} {op} {k / 10!r})::INT" for k in range(1, 10))


_TABLE = "SELECT CAST(bin AS INT) AS bin, count(*) AS n, avg(c) AS mean_p, avg(hit::INT) AS share, abs(avg(c) - avg(hit::INT)) AS gap FROM b GROUP BY bin"
_SHOW = f"SELECT bin, n, {r('mean_p', 'mean_p')}, {r('share', 'share')}, {r('gap', 'gap')} FROM t"


@query(f"{SCORED}, b AS (SELECT {_bins('greatest(p_home, p_draw, p_away)')} AS bin, greatest(p_home, p_draw, p_away) AS c, y_true = pick AS hit FROM s), t AS ({_TABLE}) {_SHOW}")
def m7_top_label_reliability(spark, sf):
    top = F.greatest(*map(F.col, m.P))
    return m.reliability(predictions(spark, sf), top, F.col("y_true") == argmax(*map(F.col, m.P)))


@query(
    f"""{SCORED}, b AS (SELECT 'H' AS class, p_home AS c, y_true = 'H' AS hit FROM s UNION ALL SELECT 'D', p_draw, y_true = 'D' FROM s UNION ALL SELECT 'A', p_away, y_true = 'A' FROM s),
 t AS (SELECT class, {_bins('c')} AS bin, count(*) AS n, abs(avg(c) - avg(hit::INT)) AS gap FROM b GROUP BY 1, 2)
SELECT class, {r('sum(n * gap) / sum(n)', 'ece')}, {r('max(gap)', 'mce')}, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY class"""
)
def m9_class_calibration(spark, sf):
    """M8, M9: calibration error of each class."""
    table = m.reliability(m.by_class(predictions(spark, sf)), F.col("p"), F.col("hit"), groups=("class",))
    return m.calibration_error(table, ("class",))


@query(
    f"""{SCORED}, o AS (SELECT 'open' AS style, {_bins('p_draw')} AS bin, p_draw AS c, y_true = 'D' AS hit FROM s WHERE p_draw < 1 UNION ALL
 SELECT 'right', {_bins('p_draw', 'right')}, p_draw, y_true = 'D' FROM s WHERE p_draw > 0), t AS (SELECT style, bin, count(*) AS n, abs(avg(c) - avg(hit::INT)) AS gap FROM o GROUP BY ALL)
SELECT style, {r('sum(n * gap) / sum(n)', 'ece')}, {r('max(gap)', 'mce')}, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY style"""
)
def m10_draw_ece_styles(spark, sf):
    """Draw calibration error under both other binnings."""
    p = predictions(spark, sf)
    parts = [
        m.calibration_error(m.reliability(p, F.col("p_draw"), F.col("y_true") == "D", style=s)).withColumn("style", F.lit(s)) for s in ("open", "right")
    ]
    return parts[0].unionByName(parts[1])


_EDGES = (0.0, 0.15, 0.2, 0.25, 0.3, 0.35, 0.45, 1.01)


@query(
    f"""{SCORED}, e(lo, hi) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in zip(_EDGES, _EDGES[1:]))})
SELECT {r('lo', 'lo')}, {r('hi', 'hi')}, count(y_true) AS n, {r('avg(p_draw)', 'mean_p')}, {r("avg((y_true = 'D')::INT)", 'share')} FROM e LEFT JOIN s ON p_draw >= lo AND p_draw < hi GROUP BY e.lo, e.hi"""
)
def m12_custom_edges(spark, sf):
    """A calibration table over given edges, empty bins included."""
    edges = spark.createDataFrame(list(zip(_EDGES, _EDGES[1:])), "lo double, hi double")
    number = sum((F.when(F.col("p_draw") >= e, 1).otherwise(0) for e in _EDGES[2:]), F.when(F.col("p_draw") >= _EDGES[1], 1).otherwise(0))
    lo = F.get(F.array(*map(F.lit, _EDGES)), number)
    rows = predictions(spark, sf).groupBy(lo.alias("lo")).agg(F.count("*").alias("n"), F.avg("p_draw").alias("mean_p"), F.avg((F.col("y_true") == "D").cast("double")).alias("share"))
    return edges.join(rows, "lo", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    f"""{SCORED}, b(band, lo, hi) AS (VALUES ('40-50', 0.4, 0.5), ('50-60', 0.5, 0.6), ('60-70', 0.6, 0.7), ('70+', 0.7, 1.01)),
 j AS (SELECT band, count(pick) AS n, count(*) FILTER (pick = y_true) AS hits, avg(greatest(p_home, p_draw, p_away)) AS c, avg(br) AS br FROM b LEFT JOIN s ON greatest(p_home, p_draw, p_away) >= lo AND greatest(p_home, p_draw, p_away) < hi GROUP BY band)
SELECT band, n, hits, {r('c', 'mean_p')}, {r('br', 'brier')}, {r('CASE WHEN n > 0 THEN c - hits / n::DOUBLE END', 'gap')},
 {r('CASE WHEN n > 0 THEN greatest((hits / n::DOUBLE + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(hits / n::DOUBLE * (1 - hits / n::DOUBLE) / n + 3.8416 / (4 * n * n::DOUBLE)) / (1 + 3.8416 / n), 0) END', 'wilson_low')},
 {r('CASE WHEN n > 0 THEN least((hits / n::DOUBLE + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(hits / n::DOUBLE * (1 - hits / n::DOUBLE) / n + 3.8416 / (4 * n * n::DOUBLE)) / (1 + 3.8416 / n), 1) END', 'wilson_high')} FROM j"""
)
def m13_confidence_bands(spark, sf):
    """Confidence bands with Wilson intervals."""
    top = F.greatest(*map(F.col, m.P))
    bands = spark.createDataFrame([("40-50",), ("50-60",), ("60-70",), ("70+",)], "band string")
    band = F.when(top >= 0.7, "70+").when(top >= 0.6, "60-70").when(top >= 0.5, "50-60").when(top >= 0.4, "40-50")
    rows = predictions(spark, sf).groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), F.count_if(F.col("y_true") == argmax(*map(F.col, m.P))).alias("hits"), F.avg(top).alias("mean_p"), F.avg(m.brier()).alias("brier")
    )
    full = bands.join(rows, "band", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "hits": F.coalesce("hits", F.lit(0))})
    n = F.when(F.col("n") > 0, F.col("n"))
    low, high = wilson(F.col("hits"), n)
    return full.select("band", "n", "hits", "mean_p", "brier", (F.col("mean_p") - F.col("hits") / n).alias("gap"), F.when(n.isNotNull(), low).alias("wilson_low"), F.when(n.isNotNull(), high).alias("wilson_high"))


@query(
    f"""{SCORED} SELECT coalesce(y_true, 'all') AS actual, count(*) AS n, {r('avg(p_home)', 'mean_home')}, {r('avg(p_draw)', 'mean_draw')}, {r('avg(p_away)', 'mean_away')}, {r("avg((pick = 'D')::INT)", 'draw_picks')},
 {r('avg((p_draw >= p_home AND p_draw >= p_away)::INT)', 'draw_first')}, {r('avg((((p_home > p_draw)::INT + (p_away > p_draw)::INT) = 2)::INT)', 'draw_last')}, {r('stddev_pop(p_draw)', 'sd_draw')}, {r('avg((p_draw > 1/3e0)::INT)', 'over_third')}
FROM s GROUP BY GROUPING SETS ((y_true), ())"""
)
def m14_probability_diagnostics(spark, sf):
    """Mean probabilities and the draw's rank, by outcome and overall."""
    d = F.col("p_draw")
    share = lambda x: F.avg(x.cast("double"))
    return predictions(spark, sf).rollup("y_true").agg(
        F.count("*").alias("n"), F.avg("p_home").alias("mean_home"), F.avg(d).alias("mean_draw"), F.avg("p_away").alias("mean_away"),
        share(argmax(*map(F.col, m.P)) == "D").alias("draw_picks"), share((d >= F.col("p_home")) & (d >= F.col("p_away"))).alias("draw_first"),
        share((F.col("p_home") > d) & (F.col("p_away") > d)).alias("draw_last"), F.stddev_pop(d).alias("sd_draw"), share(d > 1 / 3).alias("over_third"),
    ).withColumn("actual", F.coalesce("y_true", F.lit("all"))).drop("y_true")


@query(f"""{SCORED}, c AS (SELECT greatest(p_home, p_draw, p_away) AS t FROM s) SELECT {r('avg(t)', 'mean')}, {r('min(t)', 'low')}, {r('max(t)', 'high')}, {r('quantile_cont(t, 0.1)', 'p10')}, {r('quantile_cont(t, 0.5)', 'p50')}, {r('quantile_cont(t, 0.9)', 'p90')} FROM c""")
def m16_confidence_profile(spark, sf):
    t = F.greatest(*map(F.col, m.P))
    p = predictions(spark, sf)
    cuts = m.quantiles(p, t, [0.1, 0.5, 0.9]).select(*(F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("p10", "p50", "p90"))))
    return p.agg(F.avg(t).alias("mean"), F.min(t).alias("low"), F.max(t).alias("high")).crossJoin(F.broadcast(cuts))


@query(
    f"""{SCORED}, d AS (SELECT *, CASE WHEN p_draw >= 0.3 THEN 'D' ELSE pick END AS over FROM s)
SELECT competition_id, count(*) FILTER (over = y_true AND pick <> y_true) AS gained, count(*) FILTER (over <> y_true AND pick = y_true) AS sacrificed,
 count(*) FILTER (over <> pick AND (over = y_true) = (pick = y_true)) AS neutral, count(*) FILTER (over <> pick) AS overrides, {r('avg((pick = pick_q)::INT)', 'agreement')} FROM d GROUP BY competition_id"""
)
def m18_override_economics(spark, sf):
    """What overriding to a draw gains and costs; agreement of two models."""
    y = F.col("y_true")
    rows = predictions(spark, sf).withColumns({"pick": argmax(*map(F.col, m.P)), "pick_q": argmax(*map(F.col, Q))})
    rows = rows.withColumn("over", F.when(F.col("p_draw") >= 0.3, "D").otherwise(F.col("pick")))
    was, now = F.col("pick") == y, F.col("over") == y
    return rows.groupBy("competition_id").agg(
        F.count_if(now & ~was).alias("gained"), F.count_if(~now & was).alias("sacrificed"), F.count_if((F.col("over") != F.col("pick")) & (now == was)).alias("neutral"),
        F.count_if(F.col("over") != F.col("pick")).alias("overrides"), F.avg((F.col("pick") == F.col("pick_q")).cast("double")).alias("agreement"),
    )


@query(
    f"""{SCORED}, t AS (SELECT *, -ln(CASE y_true WHEN 'H' THEN q_home WHEN 'D' THEN q_draw ELSE q_away END) AS lq FROM s)
SELECT season_year, {r('avg(ll - lq)', 'delta')}, {r('corr(ll, lq)', 'loss_corr')}, {r('avg((ll < lq)::INT)', 'p_better')}, {r('avg(abs(p_home - q_home))', 'moved')}, {r('avg((abs(p_home - q_home) > 0.02)::INT)', 'material')},
 CASE WHEN avg(ll - lq) < 0 THEN 'p' ELSE 'q' END AS better FROM t GROUP BY season_year"""
)
def m22_paired_deltas(spark, sf):
    """Paired differences of two models."""
    lp, lq = m.log_loss(), m.log_loss(Q)
    moved = F.abs(F.col("p_home") - F.col("q_home"))
    return predictions(spark, sf).groupBy("season_year").agg(
        F.avg(lp - lq).alias("delta"), F.corr(lp, lq).alias("loss_corr"), F.avg((lp < lq).cast("double")).alias("p_better"), F.avg(moved).alias("moved"), F.avg((moved > 0.02).cast("double")).alias("material"),
    ).withColumn("better", F.when(F.col("delta") < 0, "p").otherwise("q"))


@query(
    f"""{SCORED}, k AS (SELECT competition_id, p_draw AS s, y_true = 'D' AS y, rank() OVER (PARTITION BY competition_id ORDER BY p_draw) + (count(*) OVER (PARTITION BY competition_id, p_draw) - 1) / 2.0 AS rk FROM s)
SELECT competition_id, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, {r('(sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y))', 'auc')} FROM k GROUP BY competition_id"""
)
def m25_auc(spark, sf):
    """ROC-AUC from tie-averaged ranks."""
    return m.auc_by_counts(predictions(spark, sf), F.col("p_draw"), F.col("y_true") == "D", ["competition_id"])


@query(
    f"""{SCORED} SELECT season_year, count(*) FILTER (y_true = 'D') AS n1, count(*) FILTER (y_true <> 'D') AS n2, {r('''CASE WHEN count(*) FILTER (y_true = 'D') >= 30 AND count(*) FILTER (y_true <> 'D') >= 30 THEN
 (avg(elo_diff) FILTER (y_true = 'D') - avg(elo_diff) FILTER (y_true <> 'D')) / sqrt(((count(*) FILTER (y_true = 'D') - 1) * var_samp(elo_diff) FILTER (y_true = 'D') + (count(*) FILTER (y_true <> 'D') - 1) * var_samp(elo_diff) FILTER (y_true <> 'D')) / (count(*) - 2)) END''', 'cohens_d')} FROM s GROUP BY season_year"""
)
def m25_effect_size(spark, sf):
    return m.effect_size(predictions(spark, sf), F.col("elo_diff"), F.col("y_true") == "D", ["season_year"])


@query(
    f"""{SCORED}, k AS (SELECT competition_id, p_home, (y_true = 'H')::INT AS y, rank() OVER (PARTITION BY competition_id ORDER BY p_home) + (count(*) OVER (PARTITION BY competition_id, p_home) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY competition_id ORDER BY elo_diff) + (count(*) OVER (PARTITION BY competition_id, elo_diff) - 1) / 2.0 AS rb FROM s)
SELECT competition_id, {r('corr(ra, rb)', 'spearman')}, {r('corr(p_home, y)', 'pearson')}, {r('avg(abs(p_home - y))', 'mae')}, {r('sqrt(avg(power(p_home - y, 2)))', 'rmse')},
 {r('covar_samp(p_home, y) / var_samp(p_home)', 'slope')}, {r('avg(y) - covar_samp(p_home, y) / var_samp(p_home) * avg(p_home)', 'intercept')} FROM k GROUP BY competition_id"""
)
def m26_correlations(spark, sf):
    """Spearman, Pearson, errors, calibration slope and intercept."""
    rows = predictions(spark, sf).select("competition_id", "p_home", "elo_diff", (F.col("y_true") == "H").cast("double").alias("y"))
    ranked = rows.withColumns({"ra": m.average_rank(F.col("p_home"), "competition_id"), "rb": m.average_rank(F.col("elo_diff"), "competition_id")})
    err = F.col("p_home") - F.col("y")
    slope = F.covar_samp("p_home", "y") / F.var_samp("p_home")
    return ranked.groupBy("competition_id").agg(
        F.corr("ra", "rb").alias("spearman"), F.corr("p_home", "y").alias("pearson"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), slope.alias("slope"), (F.avg("y") - slope * F.avg("p_home")).alias("intercept"),
    )


@query(
    f"""{SCORED} SELECT season_year, {r('avg(abs(home_goals - lambda_home))', 'mae_home')}, {r('sqrt(avg(power(away_goals - lambda_away, 2)))', 'rmse_away')}, {r('avg(abs(home_goals + away_goals - lambda_home - lambda_away))', 'mae_total')},
 {r('avg((home_goals > 0 AND away_goals > 0)::INT)', 'btts')}, {r('avg((home_goals + away_goals > 2.5)::INT)', 'over25')}, {r('avg((home_goals + away_goals > 1.5)::INT)', 'over15')},
 {r('avg((floor(lambda_home) = home_goals AND floor(lambda_away) = away_goals)::INT)', 'exact')} FROM s GROUP BY season_year"""
)
def m27_goal_metrics(spark, sf):
    h, a, lh, la = (F.col(c) for c in ("home_goals", "away_goals", "lambda_home", "lambda_away"))
    share = lambda x: F.avg(x.cast("double"))
    return predictions(spark, sf).groupBy("season_year").agg(
        F.avg(F.abs(h - lh)).alias("mae_home"), F.sqrt(F.avg((a - la) * (a - la))).alias("rmse_away"), F.avg(F.abs(h + a - lh - la)).alias("mae_total"),
        share((h > 0) & (a > 0)).alias("btts"), share(h + a > 2.5).alias("over25"), share(h + a > 1.5).alias("over15"), share((F.floor(lh) == h) & (F.floor(la) == a)).alias("exact"),
    )


@query(
    f"""{SCORED}, bet AS (SELECT competition_id, unix, fixture_id, CASE WHEN pick_q = y_true THEN 1 / (1.05 * CASE pick_q WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END) - 1 ELSE -1 END AS pnl FROM s
 WHERE (CASE pick_q WHEN 'H' THEN q_home - p_home WHEN 'D' THEN q_draw - p_draw ELSE q_away - p_away END) >= -0.03),
 cum AS (SELECT *, sum(pnl) OVER (PARTITION BY competition_id ORDER BY unix, fixture_id ROWS UNBOUNDED PRECEDING) AS c FROM bet), dd AS (SELECT *, max(c) OVER (PARTITION BY competition_id ORDER BY unix, fixture_id ROWS UNBOUNDED PRECEDING) - c AS d FROM cum)
SELECT competition_id, count(*) AS bets, count(*) FILTER (pnl > 0) AS won, {r('sum(pnl)', 'profit')}, {r('avg(pnl)', 'roi')}, {r('max(d)', 'max_drawdown')} FROM dd GROUP BY competition_id"""
)
def m29_betting(spark, sf):
    """Bets on the second model's edge; profit, return and maximal drawdown."""
    pick = argmax(*map(F.col, Q))
    of = lambda cols: F.when(F.col("k") == "H", F.col(cols[0])).when(F.col("k") == "D", F.col(cols[1])).otherwise(F.col(cols[2]))
    bets = predictions(spark, sf).withColumn("k", pick).where(of(Q) - of(m.P) >= -0.03)
    pnl = F.when(F.col("k") == F.col("y_true"), 1 / (1.05 * of(m.P)) - 1).otherwise(-1.0)
    run = m.carried(bets.select("competition_id", "unix", "fixture_id", pnl.alias("pnl")), "competition_id", F.expr(MONTH), ORDER, F.col("pnl"))
    found = m.drawdowns(run, "competition_id", ORDER)
    return found.select("competition_id", F.col("n").alias("bets"), "won", "profit", (F.col("profit") / F.col("n")).alias("roi"), "max_drawdown")


_T = (0.2, 0.25, 0.3, 0.35, 0.4)


@query(
    f"""{SCORED}, t(thr) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in _T)}), d AS (SELECT thr, y_true, CASE WHEN p_draw >= thr THEN 'D' WHEN p_home >= p_away THEN 'H' ELSE 'A' END AS k FROM s, t)
SELECT {r('thr', 'threshold')}, {r('avg((k = y_true)::INT)', 'accuracy')}, count(*) FILTER (k = 'D') AS picks, count(*) FILTER (k = 'D' AND y_true = 'D') AS hits FROM d GROUP BY thr"""
)
def m30_threshold_layer(spark, sf):
    """The draw-threshold decision over several thresholds, in one pass over the rows."""
    rows = predictions(spark, sf).select("y_true", *m.P, F.explode(F.array(*map(F.lit, _T))).alias("threshold"))
    k = F.when(F.col("p_draw") >= F.col("threshold"), "D").when(F.col("p_home") >= F.col("p_away"), "H").otherwise("A")
    return rows.withColumn("k", k).groupBy("threshold").agg(
        F.avg((F.col("k") == F.col("y_true")).cast("double")).alias("accuracy"), F.count_if(F.col("k") == "D").alias("picks"), F.count_if((F.col("k") == "D") & (F.col("y_true") == "D")).alias("hits")
    )


@query(
    f"""{SCORED}, e AS (SELECT *, -p_home * ln(p_home) - p_draw * ln(p_draw) - p_away * ln(p_away) AS risk FROM s), q AS (SELECT unnest([0.5, 0.75, 0.9, 1.0]) AS coverage, unnest(quantile_cont(risk, [0.5, 0.75, 0.9, 1.0])) AS cut FROM e)
SELECT {r('coverage', 'coverage')}, count(*) AS n, {r('avg(ll)', 'log_loss')}, {r('avg(rps)', 'rps')}, {r('avg((pick = y_true)::INT)', 'accuracy')} FROM q JOIN e ON risk <= cut GROUP BY coverage"""
)
def m31_risk_coverage(spark, sf):
    """Losses of the rows under risk percentiles."""
    from matchweave.functions.probability import entropy

    shares = (0.5, 0.75, 0.9, 1.0)
    rows = predictions(spark, sf).withColumn("risk", entropy(*map(F.col, m.P)))
    cuts = m.quantiles(rows, "risk", list(shares)).withColumnRenamed("q", "cut")
    spread = rows.crossJoin(F.broadcast(cuts)).select("*", F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("coverage"), F.col("cut"))).alias("x"))
    return spread.where(F.col("risk") <= F.col("x.cut")).groupBy(F.col("x.coverage").alias("coverage")).agg(
        F.count("*").alias("n"), F.avg(m.log_loss()).alias("log_loss"), F.avg(m.rps()).alias("rps"), F.avg((F.col("y_true") == argmax(*map(F.col, m.P))).cast("double")).alias("accuracy")
    )


@query(
    f"""{SCORED}, q AS (SELECT competition_id, list_distinct(quantile_cont(elo_diff, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM s GROUP BY 1),
 b AS (SELECT s.competition_id, len(list_filter(edges, lambda x: elo_diff > x)) AS bin, ll FROM s JOIN q USING (competition_id))
SELECT competition_id, CAST(bin AS INT) AS bin, count(*) AS n, {r('avg(ll)', 'mean_ll')} FROM b GROUP BY 1, 2"""
)
def w25_quantile_bins(spark, sf):
    """Exact quantile edges, right-closed."""
    rows = m.quantile_bins(predictions(spark, sf).withColumn("ll", m.log_loss()), "elo_diff", 10, ["competition_id"])
    return rows.groupBy("competition_id", "bin").agg(F.count("*").alias("n"), F.avg("ll").alias("mean_ll"))


@query(
    f"""{SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY unix, fixture_id) AS k FROM s)
SELECT competition_id, CAST((k - 1) // 50 AS BIGINT) AS block, count(*) AS n, {r('avg(ll)', 'log_loss')}, {r('avg((pick = y_true)::INT)', 'accuracy')} FROM n GROUP BY 1, 2"""
)
def w21_chronological_blocks(spark, sf):
    """Blocks of 50 contests in order of kickoff."""
    hit = (F.col("y_true") == argmax(*map(F.col, m.P))).cast("double")
    rows = m.carried(predictions(spark, sf), "competition_id", F.expr(MONTH), ORDER, hit).withColumn("block", F.floor((F.col("place") - 1) / 50))
    return rows.groupBy("competition_id", "block").agg(F.count("*").alias("n"), F.avg(m.log_loss()).alias("log_loss"), F.avg("value").alias("accuracy"))


@query(
    f"""{SCORED}, n AS (SELECT competition_id, row_number() OVER w AS k, avg((pick = y_true)::INT) OVER (PARTITION BY competition_id ORDER BY unix, fixture_id ROWS UNBOUNDED PRECEDING) AS acc FROM s WINDOW w AS (PARTITION BY competition_id ORDER BY unix, fixture_id))
SELECT competition_id, k, {r('acc', 'accuracy')} FROM n WHERE k % 100 = 0"""
)
def w22_cumulative_accuracy(spark, sf):
    """Accuracy up to every hundredth contest."""
    hit = (F.col("y_true") == argmax(*map(F.col, m.P))).cast("double")
    rows = m.carried(predictions(spark, sf).select("competition_id", *ORDER, *m.P, "y_true"), "competition_id", F.expr(MONTH), ORDER, hit)
    return rows.where("place % 100 = 0").select("competition_id", F.col("place").cast("long").alias("k"), (F.col("upto") / F.col("place")).alias("accuracy"))


_CANDIDATES, _EXISTING = ("lambda_home", "lambda_away", "q_home", "q_draw"), ("elo_diff", "p_home", "p_draw", "p_away")


@query(
    f"{SCORED}, c AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS candidate, '{b}' AS existing, corr({a}, {b}) AS r, corr({a}, home_goals) AS goals, corr({a}, (y_true = 'D')::INT) AS draw FROM s" for a in _CANDIDATES for b in _EXISTING)
    + f") SELECT candidate, arg_max(existing, (round(abs(r), 9), existing)) AS nearest, {r('max(abs(r))', 'r')}, {r('any_value(goals)', 'r_goals')}, {r('any_value(draw)', 'r_draw')} FROM c GROUP BY candidate"
)
def m42_redundancy(spark, sf):
    """For each candidate the existing column of largest correlation, and its correlations with the targets, in one aggregate."""
    p = predictions(spark, sf).withColumn("draw", (F.col("y_true") == "D").cast("double"))
    found = p.agg(
        *(
            F.struct(
                F.lit(a).alias("candidate"),
                F.array_max(F.array(*(F.struct(F.round(F.abs(F.corr(a, b)), 9).alias("rounded"), F.lit(b).alias("existing"), F.abs(F.corr(a, b)).alias("r")) for b in _EXISTING))).alias("top"),
                F.corr(a, "home_goals").alias("r_goals"),
                F.corr(a, "draw").alias("r_draw"),
            ).alias(a)
            for a in _CANDIDATES
        )
    )
    return found.select(F.explode(F.array(*_CANDIDATES)).alias("c")).select("c.candidate", F.col("c.top.existing").alias("nearest"), F.col("c.top.r").alias("r"), "c.r_goals", "c.r_draw")


@query(
    f"""{SCORED}, c AS (SELECT home_goals || '-' || away_goals AS score, count(*) AS n FROM s GROUP BY 1) SELECT score, n, {r('n / (SELECT sum(n) FROM c)::DOUBLE', 'share')} FROM c QUALIFY row_number() OVER (ORDER BY n DESC, score) <= 5"""
)
def a18_top_scores(spark, sf):
    """The five most frequent scores and their share."""
    scores = predictions(spark, sf).groupBy(F.concat_ws("-", "home_goals", "away_goals").alias("score")).agg(F.count("*").alias("n"))
    whole = scores.agg(F.sum("n").alias("all"))
    return scores.crossJoin(F.broadcast(whole)).select("score", "n", (F.col("n") / F.col("all")).alias("share")).orderBy(F.desc("n"), "score").limit(5)


@query(
    "WITH " + CONTESTS + """ SELECT count(*) AS total, count(DISTINCT fixture_id) AS ids, count(home_goals) AS labelled, count(*) FILTER (home_goals < 0) AS negative, count(*) FILTER (home_goals > 15) AS beyond,
 count(*) FILTER (home_shots_on > home_shots) AS on_over_all, count(*) FILTER (status = 'ABANDONED') AS abandoned, count(*) FILTER (status = 'NS') AS not_started FROM contests"""
)
def a21_label_audit(spark, sf):
    """Counts of valid, impossible and missing labels in one aggregate."""
    k = F.count_if
    return contests(spark, sf).agg(
        F.count("*").alias("total"), F.countDistinct("fixture_id").alias("ids"), F.count("home_goals").alias("labelled"), k(F.col("home_goals") < 0).alias("negative"), k(F.col("home_goals") > 15).alias("beyond"),
        k(F.col("home_shots_on") > F.col("home_shots")).alias("on_over_all"), k(F.col("status") == "ABANDONED").alias("abandoned"), k(F.col("status") == "NS").alias("not_started"),
    )


_SEGMENTS = [("first3", 1, 3), ("first5", 1, 5), ("first10", 1, 10), ("remaining", 11, 10**6)]


@query(
    f"""{SCORED}, n AS (SELECT *, dense_rank() OVER (PARTITION BY competition_id, season_id ORDER BY unix) AS k FROM s), g(segment, lo, hi) AS (VALUES {', '.join(f"('{a}', {b}, {c})" for a, b, c in _SEGMENTS)})
SELECT segment, count(*) AS n, {r('avg(ll)', 'log_loss')}, {r('avg(rps)', 'rps')} FROM n JOIN g ON k BETWEEN lo AND hi GROUP BY segment"""
)
def m40_season_segments(spark, sf):
    """Overlapping segments of the season, each row listed under all of its segments."""
    k = F.dense_rank().over(W.partitionBy("competition_id", "season_id").orderBy("unix"))
    listed = F.array_compact(F.array(*(F.when(F.col("k").between(lo, hi), F.lit(name)) for name, lo, hi in _SEGMENTS)))
    rows = predictions(spark, sf).withColumn("k", k).withColumn("segment", F.explode(listed))
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.avg(m.log_loss()).alias("log_loss"), F.avg(m.rps()).alias("rps"))
