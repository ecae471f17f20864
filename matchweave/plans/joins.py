"""Queries of joins, sets, similarity search, splits and bootstraps."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchweave.functions.probability import argmax
from matchweave.operators import history, joins, metrics, resample
from matchweave.plans.base import query, r
from matchweave.plans.history import TEAMS
from matchweave.plans.metrics import LL, PICK_P, SCORED
from matchweave.sources.bindings import CONTESTS, ODDS, PREDS, contests, odds, predictions
from matchweave.sources.storage import stored


@query(f"WITH {ODDS} SELECT p.fixture_id, o.outcome, {r('o.closing', 'closing')}, {r('p.lambda_home', 'lambda_home')} FROM preds p JOIN odds o USING (fixture_id) WHERE o.closing IS NOT NULL")
def j1_features_with_odds(spark, sf):
    return predictions(spark, sf).select("fixture_id", "lambda_home").join(odds(spark, sf).where("closing is not null").select("fixture_id", "outcome", "closing"), "fixture_id")


@query(f"WITH {PREDS}, {CONTESTS} SELECT count(*) FILTER (p.fixture_id IS NOT NULL) AS matched, count(*) FILTER (p.fixture_id IS NULL) AS left_only, 0 AS right_only FROM contests c LEFT JOIN preds p USING (fixture_id)")
def j2_unmatched_counts(spark, sf):
    """Full outer key comparison."""
    return joins.unmatched(contests(spark, sf), predictions(spark, sf), "fixture_id")


@query(TEAMS + f" SELECT team_id, {r('arg_max(coalesce(xg_for, -1), (unix, fixture_id))', 'state')}, count(*) AS rows FROM teams GROUP BY team_id")
def j4_latest_state(spark, sf):
    rows = history.team_rows(contests(spark, sf)).withColumn("state", F.coalesce("xg_for", F.lit(-1.0)))
    return joins.latest_state(rows, "team_id", "state", ["unix", "fixture_id"])


@query(
    TEAMS + f""", s AS (SELECT team_id, arg_max(coalesce(points, -1), (unix, fixture_id)) AS p FROM teams WHERE season_id < 19970 GROUP BY team_id)
SELECT fixture_id, home_id, {r('coalesce(p, 1500e0)', 'state')} FROM contests LEFT JOIN s ON s.team_id = home_id AND home_id % 7 <> 0"""
)
def j3_lookup_with_default(spark, sf):
    past = history.team_rows(contests(spark, sf)).where("season_id < 19970").withColumn("state", F.coalesce(F.col("points"), F.lit(-1)).cast("double"))
    lookup = past.where("team_id % 7 != 0").groupBy(F.col("team_id").alias("home_id")).agg(F.max_by("state", F.struct("unix", "fixture_id")).alias("state"))
    return joins.with_default(contests(spark, sf).select("fixture_id", "home_id"), lookup, "home_id", "state", 1500.0)


@query(f"WITH {CONTESTS} SELECT fixture_id, status FROM contests WHERE status <> 'FT'")
def j7_without_prediction(spark, sf):
    """Anti-join of contests against predictions."""
    return contests(spark, sf).select("fixture_id", "status").join(predictions(spark, sf).select("fixture_id"), "fixture_id", "left_anti")


@query(
    "WITH " + CONTESTS + """, w AS (SELECT competition_id, k AS label, DATE '1992-01-01' + CAST(k * 28 + competition_id AS INT) AS s, DATE '1992-01-01' + CAST(k * 28 + competition_id + 29 AS INT) AS e FROM (SELECT unnest(range(0, 130)) AS k), (SELECT DISTINCT competition_id FROM contests)),
 c AS (SELECT fixture_id, competition_id, CAST(make_timestamp(unix * 1000000) AS DATE) AS d FROM contests)
SELECT c.fixture_id, arg_min(label, (s, label)) AS label FROM c LEFT JOIN w ON w.competition_id = c.competition_id AND d BETWEEN s AND e GROUP BY c.fixture_id"""
)
def j9_interval_join(spark, sf):
    """The first calendar window of a competition that holds the kickoff's day."""
    c = contests(spark, sf)
    base = F.to_date(F.lit("1992-01-01"))
    w = c.select("competition_id").distinct().withColumn("label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(129).cast("long"))))
    start = F.date_add(base, (F.col("label") * 28 + F.col("competition_id")).cast("int"))
    w = w.select("competition_id", "label", start.alias("start_date"), F.date_add(start, 29).alias("end_date"))
    rows = c.select("fixture_id", "competition_id", F.to_date(F.timestamp_seconds("unix")).alias("day"))
    return joins.interval_label(rows, w, "competition_id", "day").select("fixture_id", "label")


def _near(asked: str = "") -> str:
    return f"""{SCORED}, q AS (SELECT * FROM s{asked}), pair AS (
 SELECT q.fixture_id AS query_id, c.fixture_id AS match_id, c.unix, q.pick, c.y_true AS outcome, round(100 * greatest(0, 1 - (0.7 * sqrt(power(q.p_home - c.p_home, 2) + power(q.p_draw - c.p_draw, 2) + power(q.p_away - c.p_away, 2))
  + 0.3 * sqrt(power(q.lambda_home - c.lambda_home, 2) + power(q.lambda_away - c.lambda_away, 2)) / 5 + CASE WHEN q.pick <> c.pick THEN 0.15 ELSE 0 END) / sqrt(2)), 1) AS similarity
 FROM q JOIN s c ON c.unix < q.unix AND c.competition_id = q.competition_id),
 near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, unix DESC, match_id) AS rank FROM pair WHERE similarity >= 60 QUALIFY rank <= 8)"""


_NEAR = _near(" WHERE fixture_id % 100 = 0")


def _compared(spark, sf):
    return predictions(spark, sf).withColumns({"pick": argmax(*map(F.col, metrics.P)), "outcome": F.col("y_true")})


def _neighbours(spark, sf):
    rows = _compared(spark, sf)
    return joins.nearest_past(rows, rows.where("fixture_id % 100 = 0"))


@query(f"{_NEAR} SELECT query_id, match_id, CAST(rank AS INT) AS rank, {r('similarity', 'similarity')}, pick, outcome FROM near")
def j11_nearest_past(spark, sf):
    """The eight most similar earlier contests; queries are the ids divisible by 100."""
    return _neighbours(spark, sf)


@query(
    f"""{_NEAR}, e AS (SELECT query_id, count(*) AS n, avg((outcome = pick)::INT) AS success FROM near GROUP BY query_id)
SELECT query_id, n, {r('success', 'success')}, CASE WHEN n < 3 THEN 'INSUFFICIENT' WHEN success >= 0.75 THEN 'HIGH' WHEN success >= 0.5 THEN 'MODERATE' ELSE 'CAUTION' END AS level FROM e"""
)
def g7_evidence(spark, sf):
    return joins.evidence(_neighbours(spark, sf))


@query(
    f"""{_near()}, c AS (SELECT query_id, outcome, count(*) AS k, min(rank) AS first, sum(count(*)) OVER (PARTITION BY query_id) AS n FROM near GROUP BY query_id, outcome)
SELECT query_id, arg_min(outcome, (-k, first)) AS mode, CAST(max(k) AS BIGINT) AS k, bool_or(k >= 2 AND k >= 0.35 * n) AS refined FROM c GROUP BY query_id"""
)
def g8_mode_refinement(spark, sf):
    """The most frequent outcome among each contest's analogues, ties by first appearance.

    Contests that ask the same are searched for once; their result is joined back to each of them.
    """
    rows = _compared(spark, sf)
    asked = stored(joins.asked_once(rows))
    near = joins.nearest_past(rows, asked.where("fixture_id <=> asked_as"))
    c = near.groupBy("query_id", "outcome").agg(F.count("*").alias("k"), F.min("rank").alias("first"))
    whole = c.groupBy("query_id").agg(
        F.min_by("outcome", F.struct(-F.col("k"), F.col("first"))).alias("mode"), F.max("k").alias("k"), F.sum("k").alias("n")
    )
    found = whole.select("query_id", "mode", "k", ((F.col("k") >= 2) & (F.col("k") >= 0.35 * F.col("n"))).alias("refined"))
    each = asked.where("copy = 1").select("fixture_id", "asked_as")
    return each.join(found, each.asked_as.eqNullSafe(found.query_id)).select(F.col("fixture_id").alias("query_id"), "mode", "k", "refined")


@query(
    "WITH n AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name, p_partkey AS id FROM part) SELECT name, count(*) AS n, min(id) AS first FROM n GROUP BY name"
)
def f1_normalized_names(spark, sf):
    """Accents, case and punctuation folded; first id of each name."""
    from matchweave.functions.text import fold_name

    return spark.read.parquet(f"{sf}/part.parquet").groupBy(fold_name(F.col("p_name")).alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query(
    """WITH l AS (SELECT s_suppkey AS l_id, s_nationkey % 2 AS day, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS lh, 'x' || right(s_name, 3) AS la FROM supplier),
 rr AS (SELECT c_custkey AS r_id, c_nationkey % 2 AS day, 'supplier' || right(c_name, 9) AS rh, 'x' || right(c_name, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 4 END) AS ra FROM customer),
 b AS (SELECT l_id, r_id, CASE WHEN lh = rh AND la = ra THEN 0 WHEN length(lh) >= 4 AND length(rh) >= 4 AND (contains(lh, rh) OR contains(rh, lh)) AND length(la) >= 4 AND length(ra) >= 4 AND (contains(la, ra) OR contains(ra, la)) THEN 1 END AS k FROM l JOIN rr USING (day))
SELECT l_id, arg_min(r_id, (k, r_id)) AS r_id, CASE WHEN min(k) = 0 THEN 'exact' ELSE 'substring' END AS method, CASE WHEN min(k) = 0 THEN 1e0 ELSE 0.8e0 END AS confidence FROM b WHERE k IS NOT NULL GROUP BY l_id"""
)
def j12_name_resolution(spark, sf):
    """Pairs of one day by exact, else contained, normalised names."""
    from matchweave.functions.text import fold_name

    left = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.col("s_suppkey").alias("l_id"), (F.col("s_nationkey") % 2).alias("day"), fold_name(F.col("s_name")).alias("l_home"), F.concat(F.lit("x"), F.right("s_name", F.lit(3))).alias("l_away")
    )
    right = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("r_id"), (F.col("c_nationkey") % 2).alias("day"), F.concat(F.lit("supplier"), F.right("c_name", F.lit(9))).alias("r_home"),
        F.concat(F.lit("x"), F.when(F.col("c_custkey") % 2 == 0, F.right("c_name", F.lit(3))).otherwise(F.right("c_name", F.lit(4)))).alias("r_away"),
    )
    return joins.best_name_match(left, right, "day")


@query("SELECT name FROM (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier)")
def u1_distinct_union(spark, sf):
    """Distinct union of two name columns."""
    a, b = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_name").alias("name")), spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_name").alias("name"))
    return a.unionByName(b).distinct()


@query("WITH " + CONTESTS + """ SELECT season_year, count(*) FILTER (away_id NOT IN (SELECT home_id FROM contests WHERE season_year < 1995)) AS unseen, count(*) AS rows FROM contests WHERE season_year >= 1995 GROUP BY season_year""")
def u5_unseen_categories(spark, sf):
    """Rows of a later cohort whose category was never seen before."""
    c = contests(spark, sf)
    known = c.where("season_year < 1995").select(F.col("home_id").alias("away_id")).distinct().withColumn("known", F.lit(True))
    return c.where("season_year >= 1995").join(known, "away_id", "left").groupBy("season_year").agg(F.count_if(F.col("known").isNull()).alias("unseen"), F.count("*").alias("rows"))


_PLAN = [(f"f{y}", "train", x) for y in (1996, 1997, 1998) for x in range(1990, y)] + [(f"f{y}", "eval", y) for y in (1996, 1997, 1998)]


@query(
    "WITH " + CONTESTS + """, p AS (SELECT f AS fold_year, 'f' || f AS fold, y AS season_year, CASE WHEN y = f THEN 'eval' ELSE 'train' END AS role FROM (SELECT unnest([1996, 1997, 1998]) AS f), (SELECT unnest(range(1990, 2000)) AS y) WHERE y <= f),
 s AS (SELECT * FROM contests JOIN p USING (season_year))
SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'eval') AS n_eval, max(unix) FILTER (role = 'train') < min(unix) FILTER (role = 'eval') AS ordered, 0 AS shared_keys FROM s GROUP BY fold"""
)
def l1_walk_forward_folds(spark, sf):
    """Expanding folds in one pass, with their temporal safety."""
    plan = spark.createDataFrame(_PLAN, "fold string, role string, season_year long")
    return joins.temporal_safety(joins.folds(contests(spark, sf), plan))


@query("WITH " + CONTESTS + " SELECT season_year, count(home_xg) AS xg, count(home_shots) AS shots, least(count(home_xg), count(home_shots)) > 0 AS eligible FROM contests GROUP BY season_year")
def l5_fold_eligibility(spark, sf):
    return contests(spark, sf).groupBy("season_year").agg(F.count("home_xg").alias("xg"), F.count("home_shots").alias("shots")).withColumn("eligible", F.least("xg", "shots") > 0)


_GRID = [0.6, 0.8, 1.0, 1.2, 1.5, 2.0]


@query(
    f"""WITH {PREDS}, g AS (SELECT i, t FROM (SELECT unnest(range(6)) AS i, unnest([0.6e0, 0.8e0, 1.0e0, 1.2e0, 1.5e0, 2.0e0]) AS t)), l AS (
 SELECT competition_id, i, t, avg(-ln(power(CASE y_true WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END, 1 / t) / (power(p_home, 1 / t) + power(p_draw, 1 / t) + power(p_away, 1 / t)))) AS loss FROM preds, g GROUP BY ALL)
SELECT competition_id, {r('arg_min(t, (round(loss, 12), i))', 'temperature')}, {r('min(loss)', 'loss')} FROM l GROUP BY competition_id"""
)
def t7_grid_argmin(spark, sf):
    """The temperature of least loss per competition; the first wins ties."""
    from matchweave.functions.probability import temperature

    rows = predictions(spark, sf).select("competition_id", "y_true", *metrics.P, F.posexplode(F.array(*map(F.lit, _GRID))).alias("i", "t"))
    h, d, a = temperature([F.col(c) for c in metrics.P], F.col("t"))
    loss = -F.log(F.when(F.col("y_true") == "H", h).when(F.col("y_true") == "D", d).otherwise(a))
    curve = rows.groupBy("competition_id", "i", "t").agg(F.avg(loss).alias("loss"))
    return curve.groupBy("competition_id").agg(F.min_by("t", F.struct(F.round("loss", 12), "i")).alias("temperature"), F.min("loss").alias("loss"))


@query(f"{SCORED} SELECT fixture_id, {r('greatest(p_home, p_draw, p_away)', 'confidence')}, pick, y_true FROM s WHERE pick <> y_true QUALIFY row_number() OVER (ORDER BY greatest(p_home, p_draw, p_away) DESC, fixture_id) <= 10")
def t4_worst_misses(spark, sf):
    """T4: the ten most confident misses."""
    rows = predictions(spark, sf).select("fixture_id", F.greatest(*map(F.col, metrics.P)).alias("confidence"), argmax(*map(F.col, metrics.P)).alias("pick"), "y_true")
    return rows.where("pick != y_true").orderBy(F.desc("confidence"), "fixture_id").limit(10)


@query(
    "WITH " + CONTESTS + """, u AS (SELECT competition_id, min(unix) AS anchor FROM contests WHERE status = 'NS' GROUP BY 1),
 c AS (SELECT c.fixture_id, c.competition_id, c.unix, CASE WHEN c.unix BETWEEN anchor - 172800 AND anchor + 432000 THEN 0 WHEN c.unix > anchor THEN 1 ELSE 2 END AS priority FROM contests c JOIN u USING (competition_id)),
 k AS (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY priority, unix, fixture_id) AS rank FROM c)
SELECT fixture_id, competition_id, priority, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10"""
)
def t5_active_window(spark, sf):
    """Ten contests per competition around its first upcoming one, then later, then earlier ones."""
    c = contests(spark, sf)
    anchor = c.where("status = 'NS'").groupBy("competition_id").agg(F.min("unix").alias("anchor"))
    rows = c.join(F.broadcast(anchor), "competition_id").withColumn(
        "priority", F.when(F.col("unix").between(F.col("anchor") - 172800, F.col("anchor") + 432000), 0).when(F.col("unix") > F.col("anchor"), 1).otherwise(2)
    )
    order = W.partitionBy("competition_id").orderBy("priority", "unix", "fixture_id")
    return rows.select("fixture_id", "competition_id", "priority", F.row_number().over(order).alias("rank")).where("rank <= 10")


_U = "(('0x' || substr(md5(((replicate - 1) // 4) || '|' || {k}), 1 + 8 * ((replicate - 1) % 4), 8))::BIGINT / 4294967296.0)"
_W = "(" + " + ".join(f"(u >= {x!r})::INT" for x in resample.STEPS) + ")"
_CI = f"SELECT count(*) AS replicates, {r('quantile_cont(mean, 0.025)', 'low')}, {r('quantile_cont(mean, 0.975)', 'high')}, {r('avg((mean < 0)::INT)', 'share_below')}, {r('least(2 * avg((mean < 0)::INT), 2 * (1 - avg((mean < 0)::INT)), 1)', 'p_value')}, quantile_cont(mean, 0.025) > 0 OR quantile_cont(mean, 0.975) < 0 AS conclusive FROM m"


_D = f"{SCORED}, d AS (SELECT *, {LL} + ln(CASE y_true WHEN 'H' THEN q_home WHEN 'D' THEN q_draw ELSE q_away END) AS d FROM s)"


@query(f"{_D}, x AS (SELECT replicate, fixture_id, d, {_U.format(k='fixture_id')} AS u FROM d, (SELECT unnest(range(1, 101)) AS replicate)), m AS (SELECT replicate, sum({_W} * d) / sum({_W}) AS mean FROM x GROUP BY replicate) {_CI}")
def b1_paired_bootstrap(spark, sf):
    """B1: paired bootstrap of the mean loss difference of two models."""
    d = metrics.log_loss() - metrics.log_loss(("q_home", "q_draw", "q_away"))
    rows = predictions(spark, sf).select("fixture_id", d.alias("total"), F.lit(1).alias("size"))
    return resample.interval(resample.means(rows, "fixture_id", "total", "size", 100))


@query(f"{_D}, k AS (SELECT unix // 604800 AS week, sum(d) AS d, count(*) AS n FROM d GROUP BY 1), x AS (SELECT replicate, week, d, n, {_U.format(k='week')} AS u FROM k, (SELECT unnest(range(1, 501)) AS replicate)), m AS (SELECT replicate, sum({_W} * d) / sum({_W} * n) AS mean FROM x GROUP BY replicate) {_CI}")
def b2_cluster_bootstrap(spark, sf):
    """B2: bootstrap over weeks, combined to one row each before they are drawn."""
    p = predictions(spark, sf).withColumn("week", F.floor(F.col("unix") / 604800))
    p = p.withColumn("d", metrics.log_loss() - metrics.log_loss(("q_home", "q_draw", "q_away")))
    return resample.interval(resample.means(p.groupBy("week").agg(F.sum("d").alias("total"), F.count("*").alias("size")), "week", "total", "size", 500))


@query(
    f"""{_D}, g AS (SELECT count(*) AS n, avg(d) AS mu, stddev_samp(d) AS sd FROM d), z(power, z) AS (VALUES (80, 0.8416e0), (90, 1.2816e0), (95, 1.6449e0))
SELECT power, {r('ceil(power((1.96 + z) * sd / abs(mu), 2))', 'required')}, n >= 300 AND mu <= -0.001 AS gate FROM g, z"""
)
def b7_power(spark, sf):
    """B7, and two of B6's conditions: rows needed for a power, and a pre-registered gate on the mean difference."""
    d = predictions(spark, sf).select((metrics.log_loss() - metrics.log_loss(("q_home", "q_draw", "q_away"))).alias("d"))
    g = d.agg(F.count("*").alias("n"), F.avg("d").alias("mu"), F.stddev_samp("d").alias("sd"))
    z = F.explode(F.array(*(F.struct(F.lit(p).alias("power"), F.lit(v).alias("z")) for p, v in ((80, 0.8416), (90, 1.2816), (95, 1.6449)))))
    need = F.ceil(F.pow((1.96 + F.col("z")) * F.col("sd") / F.abs("mu"), F.lit(2))).cast("double")
    return g.select("*", z.alias("x")).select("n", "mu", "sd", "x.*").select("power", need.alias("required"), ((F.col("n") >= 300) & (F.col("mu") <= -0.001)).alias("gate"))
