"""Queries of calibration and model fits."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.functions.probability import bounded_rate, decay_weight, entropy, logit, poisson_outcomes, score_sums
from matchweave.operators import calibrate as cal
from matchweave.operators import metrics
from matchweave.plans.base import query, r
from matchweave.plans.metrics import SCORED
from matchweave.plans.probability import _grid
from matchweave.sources.bindings import CONTESTS, PREDS, contests, predictions
from matchweave.sources.storage import shared_folder

CLASSES = {"H": "p_home", "D": "p_draw", "A": "p_away"}
COLUMNS = ["elo_diff", "lambda_home", "lambda_away"]


def split(spark, sf):
    p = predictions(spark, sf)
    return p.where("season_year < 1997"), p.where("season_year >= 1997")


@query(
    f"""WITH {PREDS}, g AS (SELECT (x - 12) / 50e0 AS rho FROM (SELECT unnest(range(25)) AS x)), c AS (SELECT competition_id, rho,
 CASE WHEN home_goals = 0 AND away_goals = 0 THEN 1 - lambda_home * lambda_away * rho WHEN home_goals = 0 AND away_goals = 1 THEN 1 + lambda_home * rho WHEN home_goals = 1 AND away_goals = 0 THEN 1 + lambda_away * rho ELSE 1 - rho END AS tau,
 CASE WHEN home_goals = 0 AND away_goals = 0 THEN lambda_home * lambda_away WHEN home_goals = 0 AND away_goals = 1 THEN lambda_home WHEN home_goals = 1 AND away_goals = 0 THEN lambda_away ELSE 1 END AS d FROM preds, g WHERE home_goals <= 1 AND away_goals <= 1),
 l AS (SELECT competition_id, rho, sum(ln(greatest(tau, 1e-9))) AS ll, sum(power(d / greatest(tau, 1e-9), 2)) AS info, count(*) AS n FROM c GROUP BY 1, 2)
SELECT competition_id, {r('rho', 'rho')}, {r('ll', 'll')}, {r('1 / sqrt(info)', 'se')}, n FROM l QUALIFY row_number() OVER (PARTITION BY competition_id ORDER BY ll DESC, abs(rho)) = 1"""
)
def k11_rho_likelihood(spark, sf):
    """Dependence per competition by a likelihood grid, with its standard error."""
    return cal.fit_rho(predictions(spark, sf), ["competition_id"], [(x - 12) / 50 for x in range(25)])


@query(f"""{SCORED}, b AS (SELECT CAST(floor(elo_diff / 40) AS BIGINT) AS bin, count(*) AS n, avg((y_true = 'D')::INT) AS own FROM s GROUP BY 1) SELECT bin, n, {r("CASE WHEN n >= 10 THEN own ELSE (SELECT avg((y_true = 'D')::INT) FROM s) END", 'share')} FROM b""")
def k12_binned_draw_curve(spark, sf):
    return cal.binned_curve(predictions(spark, sf), "elo_diff", 40.0, F.col("y_true") == "D")


@query(
    f"""WITH {CONTESTS}, t AS (SELECT * FROM contests WHERE season_year < 1997), m AS (SELECT quantile_cont(home_shots, 0.5) AS m FROM t), z AS (SELECT m, avg(coalesce(home_shots, m)) AS a, stddev_pop(coalesce(home_shots, m)) AS s FROM t, m GROUP BY m)
SELECT fixture_id, {r('(coalesce(home_shots, m) - a) / s', 'z_home_shots')}, (competition_id = 0)::INT::DOUBLE AS is_competition_id_0, (competition_id = 4)::INT::DOUBLE AS is_competition_id_4 FROM contests, z"""
)
def k1_preprocess(spark, sf):
    c = contests(spark, sf)
    out = cal.preprocess(c.where("season_year < 1997"), c, ["home_shots"], "competition_id")
    return out.select("fixture_id", "z_home_shots", "is_competition_id_0", "is_competition_id_4")


@query("WITH " + CONTESTS + """, k AS (SELECT home_id, dense_rank() OVER (ORDER BY home_id) - 1 AS code FROM (SELECT DISTINCT home_id FROM contests WHERE season_year < 1993 AND home_id % 9 <> 0)) SELECT fixture_id, CAST(coalesce(code, -1) AS INT) AS code FROM contests LEFT JOIN k USING (home_id)""")
def k2_category_codes(spark, sf):
    c = contests(spark, sf)
    return cal.category_codes(c.where("season_year < 1993 and home_id % 9 != 0"), c, "home_id").select("fixture_id", "code")


@query(
    f"""{SCORED}, e AS (SELECT *, -p_home * ln(p_home) - p_draw * ln(p_draw) - p_away * ln(p_away) AS x FROM s), q AS (SELECT quantile_cont(x, 0.8) AS a, quantile_cont(x, 0.4) AS b FROM e WHERE season_year < 1997),
 k AS (SELECT CASE WHEN x >= a THEN 'AVOID' WHEN x >= b THEN 'CAUTION' ELSE 'REST' END AS band, ll FROM e, q WHERE season_year >= 1997) SELECT band, count(*) AS n, {r('avg(ll)', 'log_loss')} FROM k GROUP BY band"""
)
def k16_percentile_bands(spark, sf):
    """Bands by training percentiles."""
    train, test = (x.withColumn("x", entropy(*(F.col(c) for c in metrics.P))) for x in split(spark, sf))
    return cal.bands(train, test, "x", {"AVOID": 0.8, "CAUTION": 0.4}).groupBy("band").agg(F.count("*").alias("n"), F.avg(metrics.log_loss()).alias("log_loss"))


@query(
    f"""{SCORED}, q AS (SELECT quantile_cont(rps, 0.9) AS a, quantile_cont(rps, 0.8) AS b FROM s WHERE season_year < 1997)
SELECT fixture_id, {r('rps', 'rps')}, {r('ll', 'log_loss')}, rps >= a - 1e-12 AS top10, rps >= b - 1e-12 AS top20, {r('least(greatest(1 - rps, 0), 1)', 'reliability')} FROM s, q WHERE season_year >= 1997"""
)
def m37_error_targets(spark, sf):
    train, test = split(spark, sf)
    cuts = metrics.quantiles(train, metrics.rps(), [0.9, 0.8]).select(F.get("q", F.lit(0)).alias("a"), F.get("q", F.lit(1)).alias("b"))
    x = metrics.rps()
    return test.crossJoin(F.broadcast(cuts)).select(
        "fixture_id", x.alias("rps"), metrics.log_loss().alias("log_loss"), (x >= F.col("a") - 1e-12).alias("top10"), (x >= F.col("b") - 1e-12).alias("top20"), F.least(F.greatest(1 - x, F.lit(0.0)), F.lit(1.0)).alias("reliability")
    )


@query(
    f"""{SCORED}, w AS (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]) AS w), b AS (SELECT competition_id, w, avg(-ln(w * CASE y_true WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END + (1 - w) * CASE y_true WHEN 'H' THEN q_home WHEN 'D' THEN q_draw ELSE q_away END)) AS loss FROM s, w GROUP BY 1, 2)
SELECT competition_id, {r('arg_min(w, (round(loss, 12), w))', 'weight')}, {r('min(loss)', 'loss')} FROM b GROUP BY competition_id"""
)
def k17_expert_weights(spark, sf):
    """The mixture weight of two models of least loss, per regime."""
    mix = lambda w: -F.log(w * metrics.p_true() + (1 - w) * metrics.p_true(("q_home", "q_draw", "q_away")))
    return cal.searched(predictions(spark, sf), mix, [0.0, 0.25, 0.5, 0.75, 1.0], ["competition_id"]).withColumnRenamed("setting", "weight")


@query()
def k6_platt(spark, sf):
    """K6: Platt calibration learnt on early seasons, scored on later ones, against no calibration."""
    train, test = split(spark, sf)
    done = cal.platt_per_class(train, test, CLASSES)
    before = metrics.scorecard(test).select(F.lit("raw").alias("method"), "n", "log_loss", "brier", "rps")
    return before.unionByName(metrics.scorecard(done, p=("cal_H", "cal_D", "cal_A")).select(F.lit("platt").alias("method"), "n", "log_loss", "brier", "rps"))


@query()
def k7_isotonic(spark, sf):
    train, test = split(spark, sf)
    return metrics.scorecard(cal.isotonic_per_class(train, test, CLASSES), p=("cal_H", "cal_D", "cal_A")).select("n", "log_loss", "brier", "rps", "accuracy")


@query()
def k3_outcome_regression(spark, sf):
    """K3: multinomial logistic regression and its scores."""
    train, test = split(spark, sf)
    out = cal.outcome_model(train, COLUMNS).transform(test).withColumn("p", vector_to_array("probability"))
    rows = out.select("y_true", *(F.get("p", F.lit(k)).alias(f"m_{v}") for k, v in enumerate("HDA")))
    return metrics.scorecard(rows, p=("m_H", "m_D", "m_A")).select("n", "log_loss", "brier", "rps", "accuracy")


@query()
def k4_goal_regression(spark, sf):
    """Time-weighted Poisson regressions, batch scoring, outcome table."""
    train, test = split(spark, sf)
    weighted = train.withColumn("w", decay_weight(F.col("unix"), 883612800, cal.decay_from_half_life(365.0)))
    scored = cal.score_goals(cal.goal_models(weighted, COLUMNS, weight="w"), test).withColumn("sums", score_sums(F.col("fit_home"), F.col("fit_away"), 20))
    h, d, a = poisson_outcomes(F.col("sums"))
    rows = scored.select("y_true", h.alias("m_H"), d.alias("m_D"), a.alias("m_A"))
    return metrics.scorecard(rows, p=("m_H", "m_D", "m_A")).select("n", "log_loss", "brier", "rps", "accuracy")


@query()
def k20_batch_scoring(spark, sf):
    """Goal models saved to shared storage, loaded again and applied to every later contest."""
    train, test = split(spark, sf)
    path = shared_folder(spark)
    cal.save_goal_models(cal.goal_models(train, COLUMNS), path)
    scored = cal.score_batch(cal.load_goal_models(path), test)
    return scored.select("fixture_id", "fit_home", "fit_away", "fit_win", "fit_draw", "fit_loss", "fit_pick", "fit_safe")


@query()
def k24_joint_stack(spark, sf):
    """A stack in score space and its weight beside the given probabilities, with the losses of all three."""
    p = predictions(spark, sf)
    weight, rows = cal.joint_stack(p.where("season_year < 1996"), p.where("season_year = 1996"), p.where("season_year >= 1997"), [k / 20 for k in range(21)])
    sides = {"given": metrics.P, "stack": ("stack_H", "stack_D", "stack_A"), "joint": ("joint_H", "joint_D", "joint_A")}
    cards = [metrics.scorecard(rows, p=c).select(F.lit(n).alias("model"), F.lit(weight).alias("weight"), "n", "log_loss", "brier", "rps") for n, c in sides.items()]
    return reduce(DataFrame.unionByName, cards)


@query()
def k5_boosted_goals(spark, sf):
    """K5: boosted trees for home goals; error on both sides of the split."""
    train, test = split(spark, sf)
    model = cal.boosted_goals(train, COLUMNS)
    err = F.sqrt(F.avg(F.pow(F.col("gbt_home") - F.col("home_goals"), F.lit(2))))
    parts = [model.transform(x).agg(F.lit(n).alias("part"), F.count("*").alias("n"), err.alias("rmse")) for n, x in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


@query()
def k15_risk_forest(spark, sf):
    """A forest for high-loss rows; mean risk where the loss was high and where not."""
    train, test = (x.withColumn("bad", (metrics.rps() > 0.3).cast("double")) for x in split(spark, sf))
    out = cal.risk_forest(train, COLUMNS, "bad").transform(test).withColumn("risk", F.get(vector_to_array("probability"), F.lit(1)))
    return out.groupBy("bad").agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"))


@query()
def k18_regimes(spark, sf):
    """Gaussian-mixture regimes and their losses."""
    train, test = split(spark, sf)
    out = cal.regimes(train, COLUMNS).transform(test)
    return out.groupBy("regime").agg(F.count("*").alias("n"), F.avg(metrics.log_loss()).alias("log_loss"))


@query(
    f"""WITH {PREDS}, {_grid(2)}, e AS (SELECT i, j, avg(ph * pa) AS e, count(*) AS n FROM grid GROUP BY i, j), o AS (SELECT home_goals AS i, away_goals AS j, count(*) AS k FROM preds GROUP BY 1, 2)
SELECT e.i AS home_goals, e.j AS away_goals, {r('e', 'expected')}, {r('coalesce(k, 0) / n::DOUBLE', 'observed')}, {r('(n * (coalesce(k, 0) / n::DOUBLE) + 50e0 * e) / ((n + 50e0) * e)', 'multiplier')} FROM e LEFT JOIN o ON o.i = e.i AND o.j = e.j"""
)
def k13_cell_multiplier(spark, sf):
    """Shrunk ratio of observed to expected share for the nine lowest scores."""
    return cal.cell_multiplier(predictions(spark, sf), 2, 50.0)


_TEMPERATURES = (0.8, 1.0, 1.2, 1.5)


@query(
    f"""WITH {PREDS}, g AS (SELECT unnest([0.8e0, 1.0e0, 1.2e0, 1.5e0]) AS t), l AS (SELECT competition_id, t, avg(-ln(power(CASE y_true WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END, 1 / t) / (power(p_home, 1 / t) + power(p_draw, 1 / t) + power(p_away, 1 / t)))) AS loss FROM preds, g GROUP BY 1, 2),
 d AS (SELECT l.competition_id, l.t, l.loss - b.loss AS d FROM l JOIN l b ON b.competition_id = l.competition_id AND b.t = 1)
SELECT {r('t', 'setting')}, count(*) FILTER (d < -1e-12) AS wins, {r('min(d)', 'best')}, {r('max(d)', 'worst')}, {r('avg(d)', 'mean')}, t IN (0.8e0, 1.5e0) AS edge,
 CASE WHEN count(*) FILTER (d < -1e-12) = count(*) THEN 'A' WHEN avg(d) < -1e-12 THEN 'B' WHEN avg(d) < 0.001 THEN 'C' ELSE 'D' END AS verdict FROM d GROUP BY t"""
)
def m24_grid_robustness(spark, sf):
    """Each grid setting against the middle one: wins, range, verdict, and whether it is at the edge."""
    from matchweave.functions.probability import temperature

    rows = predictions(spark, sf).select("competition_id", "y_true", *metrics.P, F.explode(F.array(*map(F.lit, _TEMPERATURES))).alias("setting"))
    h, d, a = temperature([F.col(c) for c in metrics.P], F.col("setting"))
    loss = -F.log(F.when(F.col("y_true") == "H", h).when(F.col("y_true") == "D", d).otherwise(a))
    curve = rows.groupBy("competition_id", "setting").agg(F.avg(loss).alias("loss"))
    return cal.robustness(curve, "competition_id", "setting", 1.0)


@query()
def k8_nested_calibration(spark, sf):
    """Every calibrator by its fit and transform, learnt on the seasons before each assessed one; isotonic with at least 50 rows of each class."""
    p, parts = predictions(spark, sf), []
    # Fits see rows that differ in nothing they use as one with a weight, read once for all years.
    seen = cal.counting(p.where("season_year < 1997"), ["season_year", "y_true", *CLASSES.values()]).persist()
    try:
        for year in (1995, 1996, 1997):
            train, test = seen.where(F.col("season_year") < year), p.where(F.col("season_year") == year)
            few = (train.groupBy("y_true").agg(F.sum("weight").alias("n")).agg(F.min("n")).first()[0] or 0) < 50
            for name, kind in cal.CALIBRATORS.items():
                if name != "isotonic" or not few:
                    rows = kind(CLASSES, weight="weight").fit(train).transform(test)
                    parts.append(metrics.scorecard(rows, p=("cal_H", "cal_D", "cal_A")).select(F.lit(year).alias("season_year"), F.lit(name).alias("method"), "n", "log_loss", "brier"))
    finally:
        seen.unpersist()
    return reduce(DataFrame.unionByName, parts)


_FOLDS, _SHARES = (1995, 1996, 1997), (0.0, 0.1, 0.2, 0.3, 0.5)


@query(
    f"""WITH {PREDS}, y AS (SELECT unnest({list(_FOLDS)}) AS y), w AS (SELECT unnest({list(_SHARES)})::DOUBLE AS w),
 f AS (SELECT y, avg((y_true = 'H')::INT) AS fh, avg((y_true = 'D')::INT) AS fd, avg((y_true = 'A')::INT) AS fa FROM preds JOIN y ON season_year < y GROUP BY y),
 l AS (SELECT w, y, avg(-ln(greatest((1 - w) * CASE y_true WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END + w * CASE y_true WHEN 'H' THEN fh WHEN 'D' THEN fd ELSE fa END, 1e-15))) AS loss
  FROM preds JOIN y ON season_year = y JOIN f USING (y), w GROUP BY w, y),
 c AS (SELECT w AS setting, count(*) AS splits, avg(loss) AS mean_loss FROM l GROUP BY w)
SELECT setting, splits, {r('mean_loss', 'mean_loss')}, setting = (SELECT arg_min(setting, (round(mean_loss, 12), setting)) FROM c) AS best FROM c"""
)
def x3_split_search(spark, sf):
    """A search over splits whose callback refits, here the class shares towards which probabilities are drawn.

    A split without training rows has no loss and doesn't count.
    """
    p = predictions(spark, sf)
    splits = [(y, p.where(F.col("season_year") < y), p.where(F.col("season_year") == y)) for y in _FOLDS]
    shares = {v: f"share_{v}" for v in "HDA"}

    def fit_predict(train: DataFrame, test: DataFrame, setting: float) -> DataFrame:
        learnt = train.agg(*(F.avg((F.col("y_true") == v).cast("double")).alias(c) for v, c in shares.items()))
        mixed = (1 - setting) * metrics.p_true() + setting * metrics.p_true(tuple(shares.values()))
        return test.crossJoin(F.broadcast(learnt)).select(F.when(mixed.isNotNull(), -F.log(F.greatest(mixed, F.lit(1e-15)))).alias("loss"))

    return cal.split_search(splits, list(_SHARES), fit_predict)


@query()
def k14_draw_stackers(spark, sf):
    """Weighted logistic fits for the draw: two models' logits stacked, the draw's logit alone, and a beta curve."""
    weighted = lambda rows: rows.withColumns({"y": (F.col("y_true") == "D").cast("double"), "w": decay_weight(F.col("unix"), 883612800, cal.decay_from_half_life(730.0))})
    train, test = map(weighted, split(spark, sf))
    shapes = {
        "stacked": {"a": logit(F.col("p_draw")), "b": logit(F.col("q_draw"))},
        "draw_only": {"a": logit(F.col("p_draw"))},
        "beta": {"a": F.log("p_draw"), "b": -F.log(1 - F.col("p_draw"))},
    }
    parts = []
    for name, columns in shapes.items():
        model = cal.binary_model(train.withColumns(columns), list(columns), "y", "w")
        p = F.get(vector_to_array("probability"), F.lit(1))
        done = model.transform(test.withColumns(columns)).select("y", p.alias("p"))
        loss = -F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))
        parts.append(done.agg(F.lit(name).alias("shape"), F.count("*").alias("n"), F.avg(loss).alias("log_loss"), F.avg("p").alias("mean_p"), F.avg("y").alias("share")))
    return reduce(DataFrame.unionByName, parts)


@query()
def k19_residual_regression(spark, sf):
    """Elastic net on the log of goals over the goal rate; the correction is held within 0.15."""
    residual = F.log((F.col("home_goals") + 0.5) / (F.col("lambda_home") + 0.5))
    train, test = (x.withColumn("residual", residual) for x in split(spark, sf))
    out = cal.residual_model(train, ["elo_diff", "p_draw"], "residual").transform(test)
    fixed = bounded_rate(F.col("lambda_home"), F.col("residual_fit"), 0.15)
    return out.agg(
        F.count("*").alias("n"),
        *(F.sqrt(F.avg(F.pow(c - F.col("home_goals"), F.lit(2)))).alias(n) for n, c in (("rmse_base", F.col("lambda_home")), ("rmse_fixed", fixed))),
        F.avg("residual_fit").alias("mean_fit"),
    )


@query()
def k22_importances(spark, sf):
    """Importances of the boosted trees, with the gap between held-out and training error."""
    train, test = split(spark, sf)
    model = cal.boosted_goals(train, COLUMNS)
    err = F.sqrt(F.avg(F.pow(F.col("gbt_home") - F.col("home_goals"), F.lit(2))))
    gap = model.transform(test).agg(err.alias("test")).crossJoin(model.transform(train).agg(err.alias("train"))).select((F.col("test") - F.col("train")).alias("gap"))
    found = spark.createDataFrame([(c, float(x)) for c, x in zip(COLUMNS, model.stages[-1].featureImportances.toArray(), strict=True)], "feature string, importance double")
    return found.crossJoin(F.broadcast(gap))


@query()
def k23_rating_head(spark, sf):
    """Outcome probabilities from the standardised rating difference and its size."""
    train, test = (x.withColumn("gap", F.abs("elo_diff")) for x in split(spark, sf))
    moments = train.agg(*(f(c).alias(f"{n}_{c}") for c in ("elo_diff", "gap") for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = lambda rows: rows.withColumns({f"z_{c}": (F.col(c) - moments[f"m_{c}"]) / (moments[f"s_{c}"] or 1.0) for c in ("elo_diff", "gap")})
    out = cal.outcome_model(scaled(train), ["z_elo_diff", "z_gap"]).transform(scaled(test)).withColumn("p", vector_to_array("probability"))
    rows = out.select("y_true", *(F.get("p", F.lit(k)).alias(f"m_{v}") for k, v in enumerate("HDA")))
    return metrics.scorecard(rows, p=("m_H", "m_D", "m_A")).select("n", "log_loss", "brier", "rps", "accuracy")
