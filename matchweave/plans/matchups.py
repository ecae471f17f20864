"""Queries of pairings, nested splits, calibrator transforms, method comparison and cohort reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchweave.functions import probability as fn
from matchweave.operators import history, joins, matchups, metrics
from matchweave.plans.base import query, r
from matchweave.plans.history import SEASON, TEAMS, gated, league
from matchweave.plans.metrics import PICK_P, SCORED
from matchweave.plans.probability import _TAU, _grid
from matchweave.sources import ledger
from matchweave.sources.bindings import CONTESTS, PREDS, contests, predictions
from matchweave.sources.storage import shared_folder

P = ("p_home", "p_draw", "p_away")


def _gd(home: str) -> tuple[str, str]:
    own = f"CASE WHEN played AND is_home = {home} THEN goals_for - goals_against END"
    return f"CASE WHEN count({own}) OVER {SEASON} >= 2 THEN avg({own}) OVER {SEASON} END", f"count({own}) OVER {SEASON}"


@query(
    TEAMS
    + f""", l AS (SELECT fixture_id, {league('row')} FROM contests),
 v AS (SELECT fixture_id, is_home, {_gd('TRUE')[0]} AS hg, {_gd('TRUE')[1]} AS hn, {_gd('FALSE')[0]} AS ag, {_gd('FALSE')[1]} AS an FROM pos)
SELECT v.fixture_id, {r('max(hg) FILTER (is_home)', 'home_gd')}, max(hn) FILTER (is_home) AS home_n, {r('max(ag) FILTER (NOT is_home)', 'away_gd')},
 max(an) FILTER (NOT is_home) AS away_n, {r('max(league_home_advantage)', 'league_gd')}, max(league_matches) AS league_n FROM v JOIN l USING (fixture_id) GROUP BY v.fixture_id"""
)
def w8_home_advantage(spark, sf):
    return matchups.home_advantage(contests(spark, sf))


@query(
    TEAMS
    + " SELECT fixture_id, team_id, coalesce((unix - lag(unix) OVER (PARTITION BY team_id ORDER BY unix, fixture_id)) / 86400e0 < 4, FALSE) AS short_turnaround FROM teams"
)
def w16_short_turnaround(spark, sf):
    return matchups.turnaround(contests(spark, sf))


@query(
    TEAMS
    + f""", g AS (SELECT fixture_id, is_home, {gated('xg_for', 'last10')} AS f, {gated('xg_against', 'last10')} AS a FROM pos),
 w AS (SELECT fixture_id, coalesce(max(f) FILTER (is_home), 1.25e0) AS hf, coalesce(max(a) FILTER (is_home), 1.25e0) AS ha,
  coalesce(max(f) FILTER (NOT is_home), 1.25e0) AS af, coalesce(max(a) FILTER (NOT is_home), 1.25e0) AS aa FROM g GROUP BY fixture_id),
 e AS (SELECT fixture_id, hf * aa / 1.25e0 * 1.12e0 AS h, af * ha / 1.25e0 * 0.88e0 AS a FROM w)
SELECT fixture_id, {r('h', 'home_expected')}, {r('a', 'away_expected')}, {r('h + a', 'total_expected')}, {r('h - a', 'gap_expected')}, {r('exp(-power(h - a, 2) / 0.405e0)', 'parity')} FROM e"""
)
def w20_expectations(spark, sf):
    return matchups.expectations(contests(spark, sf))


def _terms(f: str) -> str:
    s, t, v = (f"{f}_{w}" for w in ("season", "last10", "last5"))
    whole = f"{s} IS NOT NULL AND {t} IS NOT NULL AND {v} IS NOT NULL"
    terms = ((s, "level"), (f"{t} - {s}", "medium"), (f"{v} - {t}", "recent"))
    return ", ".join(r(f"CASE WHEN {whole} THEN {e} END", f"{f}_{name}") for e, name in terms)


@query(
    TEAMS
    + ", g AS (SELECT fixture_id, team_id, "
    + ", ".join(f"{gated(f, w)} AS {f}_{w}" for f in ("goals_for", "xg_for") for w in ("season", "last10", "last5"))
    + f" FROM pos) SELECT fixture_id, team_id, {_terms('goals_for')}, {_terms('xg_for')} FROM g"
)
def w26_recency_terms(spark, sf):
    return matchups.recency_terms(history.rolling_features(contests(spark, sf), stats=("goals", "xg")), ["goals_for", "xg_for"])


@query(
    "WITH " + CONTESTS + """, k AS (SELECT fixture_id FROM contests WHERE fixture_id % 3 = 0 UNION ALL SELECT fixture_id + 100000000000 FROM contests WHERE fixture_id % 50 = 0)
SELECT k.fixture_id, CASE WHEN status IN ('FT', 'AWARDED') AND home_goals IS NOT NULL THEN 'ft' WHEN status IN ('POSTP', 'ABANDONED', 'CANC', 'SUSP') THEN 'postponed'
 WHEN status = 'NS' AND unix > 820454400 THEN 'upcoming' ELSE 'error' END AS row_status FROM k LEFT JOIN contests USING (fixture_id)"""
)
def j13_row_status(spark, sf):
    """Ledger rows against results: played, upcoming, postponed, or without a usable result."""
    c = contests(spark, sf)
    ids = c.where("fixture_id % 3 = 0").select("fixture_id").unionAll(c.where("fixture_id % 50 = 0").select((F.col("fixture_id") + 100000000000).alias("fixture_id")))
    status = matchups.row_status(F.col("status"), F.col("home_goals"), F.col("unix"), 820454400)
    return ids.join(c.select("fixture_id", "status", "home_goals", "unix"), "fixture_id", "left").select("fixture_id", status.alias("row_status"))


_TRUE_Q = "CASE y_true WHEN 'H' THEN q_home WHEN 'D' THEN q_draw ELSE q_away END"
_BRIER_Q = "power(q_home - (y_true = 'H')::INT, 2) + power(q_draw - (y_true = 'D')::INT, 2) + power(q_away - (y_true = 'A')::INT, 2)"


@query(
    f"""{SCORED}, m AS (SELECT competition_id, 'p' AS model, avg(ll) AS ll, avg(br) AS br FROM s GROUP BY 1 UNION ALL SELECT competition_id, 'q', avg(-ln({_TRUE_Q})), avg({_BRIER_Q}) FROM s GROUP BY 1),
 g AS (SELECT competition_id, max(ll) - min(ll) AS lead, arg_min(model, ll) AS a, arg_min(model, br) AS b FROM m GROUP BY 1)
SELECT competition_id, CASE WHEN lead <= 0.005 THEN b ELSE a END AS selected, lead <= 0.005 AS tie_break, {r('lead', 'lead')} FROM g"""
)
def t8_model_selection(spark, sf):
    one = predictions(spark, sf).groupBy("competition_id").agg(
        *(F.avg(score(p)).alias(f"{name}_{m}") for m, p in (("p", P), ("q", ("q_home", "q_draw", "q_away"))) for name, score in (("ll", metrics.log_loss), ("br", metrics.brier))),
    )
    cells = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"ll_{m}").alias("log_loss"), F.col(f"br_{m}").alias("brier")) for m in "pq"))
    return matchups.selected_model(one.select("competition_id", F.inline(cells)), ["competition_id"])


_NODES = ", ".join(f"({x!r}::DOUBLE, {w!r}::DOUBLE)" for x, w in fn.quadrature())
_SD = "least(greatest(sqrt(greatest({v}, 1e-4)), 0.01), 0.35)"
_VH, _VA = "(0.02e0 + (fixture_id % 5) / 50e0)", "(0.02e0 + (fixture_id % 7) / 70e0)"


@query(
    f"""WITH raw AS (WITH {PREDS} SELECT * FROM preds), n(x, w) AS (VALUES {_NODES}), v AS (SELECT *, {_SD.format(v=_VH)} AS sh, {_SD.format(v=_VA)} AS sa FROM raw),
 preds AS (SELECT v.fixture_id * 25 + row_number() OVER (PARTITION BY v.fixture_id) - 1 AS fixture_id, v.lambda_home * exp(sh * a.x - sh * sh / 2) AS lambda_home,
  v.lambda_away * exp(sa * b.x - sa * sa / 2) AS lambda_away, a.w * b.w AS w FROM v, n a, n b), {_grid(15)},
 t AS (SELECT fixture_id, i, j, ph * pa * greatest({_TAU.format(rho='(-0.08)')}, 0) AS p FROM grid),
 o AS (SELECT fixture_id, sum(CASE WHEN i > j THEN p END) / sum(p) AS h, sum(CASE WHEN i = j THEN p END) / sum(p) AS d, sum(CASE WHEN i < j THEN p END) / sum(p) AS a FROM t GROUP BY fixture_id),
 m AS (SELECT fixture_id // 25 AS fixture_id, sum(w * h) AS h, sum(w * d) AS d, sum(w * a) AS a FROM o JOIN preds USING (fixture_id) GROUP BY 1)
SELECT fixture_id, {r('h', 'win')}, {r('d', 'draw')}, {r('a', 'loss')}, {r('-h * ln(h) - d * ln(d) - a * ln(a)', 'entropy')} FROM m"""
)
def f34_uncertain_rates(spark, sf):
    """outcome probabilities over log-normal rates at 5 x 5 nodes, all within the row."""
    variances = (0.02 + (F.col("fixture_id") % 5) / 50), (0.02 + (F.col("fixture_id") % 7) / 70)
    found = fn.uncertain_outcomes(F.col("lambda_home"), F.col("lambda_away"), *variances, -0.08)
    rows = predictions(spark, sf).select("fixture_id", found.alias("o")).select("fixture_id", "o.win", "o.draw", "o.loss")
    return rows.withColumn("entropy", fn.entropy(F.col("win"), F.col("draw"), F.col("loss")))


def _rest(draw: str, name: str) -> str:
    return f"{r(f'p_home * (1 - ({draw})) / (p_home + p_away)', f'{name}_home')}, {r(draw, f'{name}_draw')}, {r(f'p_away * (1 - ({draw})) / (p_home + p_away)', f'{name}_away')}"


@query(
    f"""WITH {PREDS}, v AS (SELECT *, exp(1.1e0 * ln(p_home) + 0.05e0) AS h, exp(0.9e0 * ln(p_draw) - 0.1e0) AS d, exp(1.05e0 * ln(p_away)) AS a FROM preds)
SELECT fixture_id, {r('h / (h + d + a)', 'vector_home')}, {r('d / (h + d + a)', 'vector_draw')}, {r('a / (h + d + a)', 'vector_away')},
 {_rest('1 / (1 + exp(-(0.8e0 * ln(p_draw / (1 - p_draw)) - 0.2e0)))', 'platt')}, {_rest('1 / (1 + exp(-(1.2e0 * ln(p_draw) - 0.7e0 * ln(1 - p_draw) + 0.1e0)))', 'beta')} FROM v"""
)
def f38_calibrator_transforms(spark, sf):
    """vector scaling, and the draw through a logistic and a beta curve."""
    p = [F.col(c) for c in P]
    found = {"vector": fn.vector_scaled(p, [1.1, 0.9, 1.05], [0.05, -0.1, 0.0]), "platt": fn.platt_draw(p, 0.8, -0.2), "beta": fn.beta_draw(p, 1.2, 0.7, 0.1)}
    return predictions(spark, sf).select("fixture_id", *(c.alias(f"{k}_{side}") for k, v in found.items() for c, side in zip(v, ("home", "draw", "away"), strict=True)))


@query(
    f"""WITH raw AS (WITH {PREDS} SELECT * FROM preds), steps AS (SELECT unnest(range(1, 15)) AS k),
 preds AS (SELECT h.k * 100 + a.k AS fixture_id, h.k / 4e0 AS lambda_home, a.k / 4e0 AS lambda_away FROM steps h, steps a), {_grid(20)},
 o AS (SELECT fixture_id, any_value(lh) AS lh, any_value(la) AS la, sum(CASE WHEN i > j THEN ph * pa END) AS h, sum(CASE WHEN i = j THEN ph * pa END) AS d FROM grid GROUP BY fixture_id),
 t AS (SELECT DISTINCT p_home, p_draw, p_away FROM raw),
 m AS (SELECT p_home, p_draw, p_away, min({{'gap': round(power(h - p_home, 2) + power(d - p_draw, 2) + power(1 - h - d - p_away, 2), 9), 'lh': lh, 'la': la}}) AS b FROM t, o GROUP BY ALL)
SELECT raw.fixture_id, {r('b.lh', 'lambda_home')}, {r('b.la', 'lambda_away')}, {r('b.gap', 'gap')} FROM raw JOIN m USING (p_home, p_draw, p_away)"""
)
def f41_rates_from_outcomes(spark, sf):
    """the pair of a table of 14 x 14 goal rates whose outcome probabilities lie nearest; the table is one row of fixed size."""
    side = F.array(*(F.lit(k / 4) for k in range(1, 15)))
    pairs = spark.range(1).select(F.explode(side).alias("home")).select("home", F.explode(side).alias("away"))
    h, d, a = fn.poisson_outcomes(F.col("sums"))
    table = pairs.withColumn("sums", fn.score_sums(F.col("home"), F.col("away"), 20)).select("home", "away", h.alias("h"), d.alias("d"), a.alias("a")).agg(F.collect_list(F.struct("home", "away", "h", "d", "a")).alias("grid"))
    near = fn.nearest_rates([F.col(c) for c in P], F.col("grid"))
    triples = predictions(spark, sf).select(*P).distinct().crossJoin(F.broadcast(table)).select(*P, near.alias("b"))
    return predictions(spark, sf).select("fixture_id", *P).join(triples, list(P)).select(
        "fixture_id", F.col("b.home").alias("lambda_home"), F.col("b.away").alias("lambda_away"), F.col("b.gap").alias("gap")
    )


_INNER = [(f"f{f}/i{i}", role, y) for f in (1996, 1997, 1998) for i in (f - 2, f - 1) for y in range(1990, i + 1) for role in (["eval"] if y == i else ["train"])]


@query(
    "WITH " + CONTESTS + """, p AS (SELECT 'f' || f || '/i' || i AS fold, y AS season_year, CASE WHEN y = i THEN 'eval' ELSE 'train' END AS role
  FROM (SELECT unnest([1996, 1997, 1998]) AS f), (SELECT unnest([1, 2]) AS back), LATERAL (SELECT f - back AS i), (SELECT unnest(range(1990, 2000)) AS y) WHERE y <= i),
 s AS (SELECT * FROM contests JOIN p USING (season_year))
SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'eval') AS n_eval, max(unix) FILTER (role = 'train') < min(unix) FILTER (role = 'eval') AS ordered,
 0 AS shared_keys, max(unix) FILTER (role = 'train') AS reference_unix FROM s GROUP BY fold"""
)
def l3_nested_splits(spark, sf):
    """L3: inner folds within the training seasons of every outer fold, with the reference time of each."""
    split = joins.folds(contests(spark, sf), spark.createDataFrame(_INNER, "fold string, role string, season_year long"))
    reference = split.where("role = 'train'").groupBy("fold").agg(F.max("unix").alias("reference_unix"))
    return joins.temporal_safety(split).join(reference, "fold", "left")


@query(
    f"""WITH {PREDS}, u AS (SELECT competition_id, y_true, 'first' AS method, p_home AS h, p_draw AS d, p_away AS a FROM preds UNION ALL SELECT competition_id, y_true, 'second', q_home, q_draw, q_away FROM preds
 UNION ALL SELECT competition_id, y_true, 'blend', (p_home + q_home) / 2, (p_draw + q_draw) / 2, (p_away + q_away) / 2 FROM preds),
 k AS (SELECT *, CASE WHEN h >= d AND h >= a THEN 'H' WHEN d >= a THEN 'D' ELSE 'A' END AS pick, CASE y_true WHEN 'H' THEN h WHEN 'D' THEN d ELSE a END AS t FROM u)
SELECT method, coalesce(competition_id::VARCHAR, 'all') AS competition, count(*) AS n, {r('avg((pick = y_true)::INT)', 'accuracy')}, {r('avg(-ln(t))', 'log_loss')}, {r("avg((pick = 'D')::INT)", 'draw_picks')},
 {r("avg((y_true = 'D')::INT)", 'draw_share')}, {r("avg(d) - avg((y_true = 'D')::INT)", 'draw_bias')} FROM k GROUP BY GROUPING SETS ((method, competition_id), (method))"""
)
def g10_method_comparison(spark, sf):
    """Single and blended sources by competition and in all, in one pass over each row's methods."""
    p, q = [F.col(c) for c in P], [F.col(c) for c in ("q_home", "q_draw", "q_away")]
    methods = {"first": p, "second": q, "blend": [(x + y) / 2 for x, y in zip(p, q, strict=True)]}
    cells = F.array(*(F.struct(F.lit(m).alias("method"), *(c.alias(k) for c, k in zip(v, "hda", strict=True))) for m, v in methods.items()))
    rows = predictions(spark, sf).select("competition_id", "y_true", F.inline(cells))
    sides, draw = ("h", "d", "a"), (F.col("y_true") == "D").cast("double")
    rows = rows.withColumn("pick", fn.argmax(*(F.col(c) for c in sides)))
    by_both = rows.groupingSets([["method", "competition_id"], ["method"]], "method", "competition_id").agg(
        F.count("*").alias("n"),
        F.avg((F.col("pick") == F.col("y_true")).cast("double")).alias("accuracy"),
        F.avg(metrics.log_loss(sides)).alias("log_loss"),
        F.avg((F.col("pick") == "D").cast("double")).alias("draw_picks"),
        F.avg(draw).alias("draw_share"),
        (F.avg("d") - F.avg(draw)).alias("draw_bias"),
    )
    return by_both.withColumn("competition", F.coalesce(F.col("competition_id").cast("string"), F.lit("all"))).drop("competition_id")


_PICK_Q = PICK_P.replace("p_", "q_")


@query(
    f"""{SCORED}, g AS (SELECT competition_id, count(*) AS n, count(*) FILTER (pick = y_true) AS k, avg(ll) AS ll, avg(br) AS br, count(*) FILTER (pick = y_true AND {_PICK_Q} <> y_true) AS first_only,
 count(*) FILTER (pick <> y_true AND {_PICK_Q} = y_true) AS second_only, count(*) FILTER (pick <> y_true AND {_PICK_Q} <> y_true) AS neither FROM s GROUP BY 1),
 w AS (SELECT *, k / n::DOUBLE AS p, 1.96e0 * 1.96e0 AS z FROM g)
SELECT competition_id, n, {r('p', 'accuracy')}, {r('(p + z / (2 * n) - 1.96e0 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)', 'low')},
 {r('(p + z / (2 * n) + 1.96e0 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)', 'high')}, {r('ll', 'log_loss')}, {r('br', 'brier')}, first_only, second_only, neither,
 CASE WHEN n >= 1000 THEN 'FULL' WHEN n >= 300 THEN 'INTERIM' WHEN n >= 100 THEN 'PILOT' ELSE 'TOO_FEW' END AS milestone, {r('least(n / 1000e0, 1)', 'progress')} FROM w"""
)
def o10_cohort_report(spark, sf):
    """Scores, interval, paired correctness and progress of every competition's cohort."""
    rows = predictions(spark, sf).select(
        "competition_id", metrics.log_loss().alias("ll"), metrics.brier().alias("br"),
        (fn.argmax(*(F.col(c) for c in P)) == F.col("y_true")).alias("one"), (fn.argmax(*(F.col(c) for c in ("q_home", "q_draw", "q_away"))) == F.col("y_true")).alias("two"),
    )
    one, two, n = F.col("one"), F.col("two"), F.col("n")
    g = rows.groupBy("competition_id").agg(
        F.count("*").alias("n"), F.count_if(one).alias("k"), F.avg("ll").alias("log_loss"), F.avg("br").alias("brier"),
        F.count_if(one & ~two).alias("first_only"), F.count_if(~one & two).alias("second_only"), F.count_if(~one & ~two).alias("neither"),
    )
    low, high = fn.wilson(F.col("k"), n)
    milestone = F.when(n >= 1000, "FULL").when(n >= 300, "INTERIM").when(n >= 100, "PILOT").otherwise("TOO_FEW")
    return g.select(
        "competition_id", "n", (F.col("k") / n).alias("accuracy"), low.alias("low"), high.alias("high"), "log_loss", "brier", "first_only", "second_only", "neither",
        milestone.alias("milestone"), F.least(n / 1000.0, F.lit(1.0)).alias("progress"),
    )


_TOTALS = f"{r('sum(p_home)', 'home')}, {r('sum(p_draw)', 'draw')}"


@query(f"WITH {PREDS} SELECT season_year, count(*) AS n, {_TOTALS} FROM preds GROUP BY season_year")
def s11_csv_round_trip(spark, sf):
    """Fold predictions written as CSV with a header and read back under their schema."""
    rows, path = predictions(spark, sf).select("fixture_id", "season_year", "y_true", *P), shared_folder(spark)
    rows.write.csv(path, header=True)
    back = spark.read.schema(rows.schema).csv(path, header=True)
    return back.groupBy("season_year").agg(F.count("*").alias("n"), F.sum("p_home").alias("home"), F.sum("p_draw").alias("draw"))


@query(f"WITH {PREDS} SELECT competition_id, season_year, count(*) AS n, {_TOTALS} FROM preds WHERE competition_id = 2 GROUP BY ALL")
def s18_partitioned(spark, sf):
    """Parquet partitioned by competition and season, read back with one partition pruned to."""
    path = shared_folder(spark)
    ledger.write_partitioned(predictions(spark, sf).select("fixture_id", "competition_id", "season_year", *P), path, ["competition_id", "season_year"])
    back = spark.read.parquet(path).where("competition_id = 2")
    return back.groupBy(F.col("competition_id").cast("long").alias("competition_id"), F.col("season_year").cast("long").alias("season_year")).agg(
        F.count("*").alias("n"), F.sum("p_home").alias("home"), F.sum("p_draw").alias("draw")
    )
