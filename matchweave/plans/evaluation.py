"""Queries of contracts, bootstraps, comparisons of models and their selection."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchweave.functions import probability as fn
from matchweave.operators import calibrate as cal
from matchweave.operators import contracts as con
from matchweave.operators import metrics as m
from matchweave.operators import resample
from matchweave.plans.base import query, r
from matchweave.plans.joins import _CI, _D, _U, _W
from matchweave.plans.metrics import BRIER, LL, PICK, RPS, SCORED
from matchweave.plans.probability import _grid
from matchweave.sources.bindings import CONTESTS, PREDS, contests, predictions
from matchweave.sources.storage import shared_folder

Q = ("q_home", "q_draw", "q_away")
LABELS, METADATA = ["y_true", "home_goals", "away_goals"], ["fixture_id", "unix", "competition_id", "season_id", "season_year"]
DESIGN = ["fixture_id", "elo_diff", "lambda_away", "lambda_home"]


@query(f"WITH {PREDS} SELECT {', '.join(DESIGN)} FROM preds")
def p4_feature_contract(spark, sf):
    """The named columns in their order, or an error that names the missing ones."""
    return con.select_exact(predictions(spark, sf), DESIGN)


_FEATURES = ["p_home", "p_draw", "p_away", "q_home", "q_draw", "q_away", "lambda_home", "lambda_away", "elo_diff"]


@query(f"WITH {PREDS} " + " UNION ALL ".join(f"SELECT {k} AS place, '{c}' AS feature, count({c}) AS known, {r(f'avg({c})', 'mean')} FROM preds" for k, c in enumerate(_FEATURES)))
def p5_feature_columns(spark, sf):
    """P5: the columns that are neither labels nor metadata, with their counts, in one aggregate."""
    p = predictions(spark, sf)
    found = con.feature_columns(p, LABELS, METADATA)
    cells = [F.struct(F.lit(k).alias("place"), F.lit(c).alias("feature"), F.count(c).alias("known"), F.avg(c).alias("mean")) for k, c in enumerate(found)]
    return p.agg(*(c.alias(f"c{k}") for k, c in enumerate(cells))).select(F.explode(F.array(*(F.col(f"c{k}") for k in range(len(cells))))).alias("c")).select("c.*")


_CHECKED = ["home_xg", "home_shots", "away_shots_on", "home_goals"]


@query(
    f"WITH {CONTESTS}, t AS (SELECT * FROM contests WHERE season_year < 1997), b AS (SELECT *, 1 AS version FROM contests WHERE season_year < 1997 AND season_year > 1995 OR season_year > 1996), g AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col, (SELECT avg(({c} IS NULL)::INT) FROM b) AS nr, (SELECT avg(({c} IS NULL)::INT) FROM t) AS tr, (SELECT min({c}) = max({c}) FROM b) AS cs" for c in _CHECKED
    )
    + f""" UNION ALL SELECT 'version', 0, NULL, true UNION ALL SELECT 'vendor_score', NULL, NULL, NULL)
SELECT col AS "column", {r('nr', 'null_rate')}, {r('nr - tr', 'change')}, CASE WHEN nr IS NULL THEN 'missing' WHEN nr = 1 THEN 'all_null' WHEN cs THEN 'constant' WHEN nr > 0.25 THEN 'over_rate' ELSE 'ok' END AS status FROM g"""
)
def p17_availability(spark, sf):
    """Null rates of a later batch against training, with missing, constant and over-null columns."""
    c = contests(spark, sf)
    return con.availability(c.where("season_year < 1997"), c.where("season_year > 1995").withColumn("version", F.lit(1)), [*_CHECKED, "version", "vendor_score"], 0.25)


@query("WITH " + CONTESTS + """, l AS (SELECT *, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' WHEN home_goals = away_goals THEN 'D' END AS y FROM contests)
SELECT season_year, y, count(*) AS n FROM l WHERE y IS NOT NULL AND fixture_id % 10 <> 3 GROUP BY 1, 2""")
def s10_labelled_scan(spark, sf):
    """Labelled rows without the known exclusions; a label outside H, D, A fails the run."""
    c = contests(spark, sf)
    h, a = F.col("home_goals"), F.col("away_goals")
    rows = c.withColumn("y", F.when(h > a, "H").when(h < a, "A").when(h == a, "D"))
    return con.labelled(rows, "y", ["H", "D", "A"], c.where("fixture_id % 10 = 3"), "fixture_id").groupBy("season_year", "y").agg(F.count("*").alias("n"))


@query("SELECT event_type AS signal_id, count(*) AS n, count(DISTINCT user_id) AS users, 2 AS appends FROM events GROUP BY 1")
def s14_event_log(spark, sf):
    """JSON lines appended in two runs and read again; signals with their events."""
    path, events = shared_folder(spark), spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("signal_id"), "user_id")
    for k in range(2):
        events.where(F.col("user_id") % 2 == k).withColumn("run", F.lit(k)).write.mode("append").json(path)
    back = spark.read.schema("signal_id string, user_id long, run int").json(path)
    runs = back.agg(F.count_distinct("run").cast("int").alias("appends"))
    found = back.groupBy("signal_id").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return found.crossJoin(F.broadcast(runs))


@query(f"WITH {PREDS}, f AS (SELECT *, CASE season_year WHEN 1995 THEN 'fold1' WHEN 1996 THEN 'fold2' ELSE 'fold3' END AS part, season_year - 1995 AS part_order FROM preds WHERE season_year BETWEEN 1995 AND 1997) SELECT part, CAST(part_order AS INT) AS part_order, fixture_id, row_number() OVER (PARTITION BY part ORDER BY unix, fixture_id) AS place FROM f")
def u3_disjoint_folds(spark, sf):
    """Fold predictions concatenated in fold order; a key in two folds fails the run."""
    p = predictions(spark, sf).select("fixture_id", "unix", "season_year")
    union = con.disjoint_union({f"fold{k}": p.where(F.col("season_year") == 1994 + k) for k in (1, 2, 3)}, "fixture_id")
    return union.select("part", "part_order", "fixture_id", F.row_number().over(W.partitionBy("part").orderBy("unix", "fixture_id")).alias("place"))


@query(f"WITH {PREDS} SELECT fixture_id, fixture_id % 97 <> 0 AS verified FROM preds")
def f8_hash_check(spark, sf):
    """F8: record hashes computed anew against the stored ones; every 97th row was changed after it was stored."""
    digest = F.sha2(F.to_json(F.struct("fixture_id", "p_away", "p_draw", "p_home")), 256)
    stored = predictions(spark, sf).select("fixture_id", "p_home", "p_draw", "p_away", digest.alias("stored"))
    later = stored.withColumn("p_home", F.when(F.col("fixture_id") % 97 == 0, F.col("p_home") + 1e-9).otherwise(F.col("p_home")))
    return later.select("fixture_id", (digest == F.col("stored")).alias("verified"))


_RAW = ["FT", "aet", "PEN ", "LIVE", "HT", "POSTP", "CANC", "SUSP", "NS", "TIMED"]


@query(
    f"WITH {CONTESTS}, s AS (SELECT *, list_extract({_RAW!r}, CAST(fixture_id % 10 AS INT) + 1) AS raw FROM contests), t AS (SELECT *, upper(trim(raw)) AS u FROM s)"
    """ SELECT fixture_id, CASE WHEN u IN ('NS', 'TIMED') THEN 'UPCOMING' ELSE u END AS status,
 CASE u WHEN 'FT' THEN 'FINISHED' WHEN 'POSTP' THEN 'POSTPONED' WHEN 'CANC' THEN 'CANCELLED' WHEN 'SUSP' THEN 'SUSPENDED' WHEN 'NS' THEN 'UPCOMING' WHEN 'TIMED' THEN 'UPCOMING' ELSE u END AS label,
 CASE WHEN u IN ('LIVE', 'HT') THEN coalesce(home_goals, 0) || '-' || coalesce(away_goals, 0) WHEN u IN ('FT', 'AET', 'PEN', 'SUSP') THEN coalesce(home_goals || '-' || away_goals, '-') ELSE '-' END AS shown,
 u IN ('FT', 'AET', 'PEN') AS finished FROM t"""
)
def f10_status_table(spark, sf):
    """raw statuses by the fixed table, with label and score to show."""
    raw = F.get(F.array(*map(F.lit, _RAW)), (F.col("fixture_id") % 10).cast("int"))
    cells = con.normalized_status(raw, F.col("home_goals"), F.col("away_goals"))
    return contests(spark, sf).select("fixture_id", *(c.alias(n) for c, n in zip(cells, ("status", "label", "shown", "finished"), strict=True)))


@query(f"WITH {PREDS}, t AS (SELECT *, round(p_home * 100, 1) AS h, round(p_draw * 100, 1) AS d, round(p_away * 100, 1) AS a FROM preds) SELECT fixture_id, {', '.join(r(f'CASE WHEN fixture_id % 7 <> 0 AND fixture_id % 11 <> 0 THEN {c} / (h + d + a) END', n) for c, n in (('h', 'home'), ('d', 'draw'), ('a', 'away')))} FROM t")
def f11_typed_percentages(spark, sf):
    """outcome fractions from the struct of type 237 in an array; null where the type or one of its values is absent."""
    percent = lambda c: F.round(F.col(c) * 100, 1)
    away = F.when(F.col("fixture_id") % 11 != 0, percent("p_away"))
    wanted = F.create_map(F.lit("home"), percent("p_home"), F.lit("draw"), percent("p_draw"), F.lit("away"), away)
    other = F.create_map(F.lit("yes"), F.lit(50.0))
    kind = F.when(F.col("fixture_id") % 7 == 0, 231).otherwise(237)
    listed = F.array(F.struct(F.lit(99).alias("type_id"), other.alias("values")), F.struct(kind.alias("type_id"), wanted.alias("values")))
    found = predictions(spark, sf).select("fixture_id", con.typed_values(listed, 237).alias("found"))
    cells = con.typed_percentages(F.col("found"))
    return found.select("fixture_id", *(c.alias(n) for c, n in zip(cells, ("home", "draw", "away"), strict=True)))


_TIER = "CASE WHEN p_draw >= 0.45 THEN 'CRITICAL' WHEN p_draw >= 0.3 THEN 'HIGH' WHEN p_draw >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END"


@query(
    f"""{SCORED}, t AS (SELECT *, {_TIER} AS tier FROM s WHERE p_draw < 0.45), k(tier) AS (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL'))
SELECT k.tier, count(t.fixture_id) AS n, count(*) FILTER (y_true = 'D') AS draws, count(*) FILTER (pick = y_true AND pick_q = y_true) AS both, count(*) FILTER (pick = y_true AND pick_q <> y_true) AS lost,
 count(*) FILTER (pick <> y_true AND pick_q = y_true) AS gained, {r('coalesce(avg((pick = y_true)::INT), 0)', 'accuracy')}, {r('CASE WHEN count(t.fixture_id) > 0 THEN avg((pick <> y_true)::INT) ELSE 0 END', 'failure')} FROM k LEFT JOIN t USING (tier) GROUP BY k.tier"""
)
def a19_transitions_by_tier(spark, sf):
    """Correctness of two models against each other by risk tier; empty tiers count zero."""
    p = predictions(spark, sf).where("p_draw < 0.45").withColumn("tier", F.expr(_TIER))
    one, two = (fn.argmax(*(F.col(c) for c in names)) == F.col("y_true") for names in (m.P, Q))
    found = p.groupBy("tier").agg(
        F.count("*").alias("n"), F.count_if(F.col("y_true") == "D").alias("draws"), F.count_if(one & two).alias("both"), F.count_if(one & ~two).alias("lost"), F.count_if(~one & two).alias("gained"),
        F.avg(one.cast("double")).alias("accuracy"), F.avg((~one).cast("double")).alias("failure"),
    )
    tiers = spark.createDataFrame([(t,) for t in ("LOW", "MEDIUM", "HIGH", "CRITICAL")], "tier string")
    return tiers.join(found, "tier", "left").fillna(0)


@query(
    f"""{SCORED}, q AS (SELECT quantile_cont(p_draw, 0.9) AS cut FROM s WHERE season_year < 1997), t AS (SELECT s.*, p_draw >= cut AS risky, p_draw >= cut AND month(to_timestamp(unix)) <= 3 AS early FROM s, q WHERE season_year >= 1997),
 o AS (SELECT 'base' AS policy, 0 AS routed, p_home AS h, p_draw AS d, y_true FROM t UNION ALL SELECT 'high_risk', risky::INT, CASE WHEN risky THEN q_home ELSE p_home END, CASE WHEN risky THEN q_draw ELSE p_draw END, y_true FROM t
 UNION ALL SELECT 'early_high_risk', early::INT, CASE WHEN early THEN 0.7 * q_home + 0.3 * p_home ELSE p_home END, CASE WHEN early THEN 0.7 * q_draw + 0.3 * p_draw ELSE p_draw END, y_true FROM t),
 g AS (SELECT policy, sum(routed) AS routed, avg((power(h - (y_true = 'H')::INT, 2) + power(h + d - (y_true <> 'A')::INT, 2)) / 2) AS rps FROM o GROUP BY policy)
SELECT policy, CAST(routed AS BIGINT) AS routed, {r('rps', 'rps')}, {r("rps - (SELECT rps FROM g WHERE policy = 'base')", 'delta')} FROM g"""
)
def m32_routing(spark, sf):
    """One model alone, high-risk rows sent to the other, and early high-risk rows sent to a blend."""
    p = predictions(spark, sf)
    cut = m.quantiles(p.where("season_year < 1997"), "p_draw", [0.9]).select(F.get("q", F.lit(0)).alias("cut"))
    t = p.where("season_year >= 1997").crossJoin(F.broadcast(cut)).withColumn("risky", F.col("p_draw") >= F.col("cut"))
    t = t.withColumn("early", F.col("risky") & (F.month(F.timestamp_seconds("unix")) <= 3))
    modes = {"base": (F.lit(False), 0.0), "high_risk": (F.col("risky"), 1.0), "early_high_risk": (F.col("early"), 0.7)}
    cells = [
        F.struct(
            F.lit(name).alias("policy"), here.cast("long").alias("routed"),
            *(F.when(here, share * F.col(q) + (1 - share) * F.col(a)).otherwise(F.col(a)).alias(n) for a, q, n in zip(m.P, Q, "hda", strict=True)),
        )
        for name, (here, share) in modes.items()
    ]
    rows = t.select("y_true", F.explode(F.array(*cells)).alias("c")).select("y_true", "c.*")
    found = rows.groupBy("policy").agg(F.sum("routed").alias("routed"), F.avg(m.rps(("h", "d", "a"))).alias("rps"))
    base = found.where("policy = 'base'").select(F.col("rps").alias("base"))
    return found.crossJoin(F.broadcast(base)).select("policy", "routed", "rps", (F.col("rps") - F.col("base")).alias("delta"))


_YEARS = (1996, 1997, 1998)
_LONG = "SELECT fixture_id, season_year, ll, 'elo_diff' AS feature, elo_diff AS x FROM s UNION ALL SELECT fixture_id, season_year, ll, 'lambda_home', lambda_home FROM s UNION ALL SELECT fixture_id, season_year, ll, 'p_draw', p_draw FROM s"


@query(
    f"""{SCORED}, l AS ({_LONG}), f AS (SELECT unnest({list(_YEARS)}) AS fold), e AS (SELECT fold, feature, quantile_cont(x, 0.2) AS low, quantile_cont(x, 0.8) AS high FROM l JOIN f ON season_year < fold GROUP BY 1, 2),
 g AS (SELECT fold, feature, avg(ll) FILTER (x > high) - avg(ll) FILTER (x <= low) AS d FROM l JOIN e USING (feature) WHERE season_year = fold GROUP BY 1, 2)
SELECT feature, count(*) AS folds, {r('avg(d)', 'mean_change')}, {r('avg(abs(d))', 'spread')}, abs(sum(sign(d))) = count(*) AND min(abs(d)) > 0 AS replicated FROM g WHERE d IS NOT NULL GROUP BY feature"""
)
def m34_extreme_bins(spark, sf):
    """Loss of the highest against the lowest fifth, by edges learnt on earlier seasons, and whether all folds agree in sign."""
    p = predictions(spark, sf).withColumn("ll", m.log_loss())
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in ("elo_diff", "lambda_home", "p_draw"))))
    long = p.select("season_year", "ll", cells.alias("c")).select("season_year", "ll", "c.*")
    plan = spark.createDataFrame([(y,) for y in _YEARS], "fold long")
    train = long.join(F.broadcast(plan), F.col("season_year") < F.col("fold"))
    edges = m.quantiles(train, "x", [0.2, 0.8], ["fold", "feature"]).select("fold", "feature", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
    tested = long.withColumnRenamed("season_year", "fold").join(edges, ["fold", "feature"])
    d = F.avg(F.when(F.col("x") > F.col("high"), F.col("ll"))) - F.avg(F.when(F.col("x") <= F.col("low"), F.col("ll")))
    found = tested.groupBy("fold", "feature").agg(d.alias("d")).where("d is not null")
    same = (F.abs(F.sum(F.signum("d"))) == F.count("*")) & (F.min(F.abs("d")) > 0)
    return found.groupBy("feature").agg(F.count("*").alias("folds"), F.avg("d").alias("mean_change"), F.avg(F.abs("d")).alias("spread"), same.alias("replicated"))


@query(
    f"""{SCORED}, t AS (SELECT *, greatest(p_home, p_draw, p_away) AS top FROM s), k AS (SELECT unnest([0.5e0, 0.6e0, 0.7e0]) AS level)
SELECT competition_id, {r('level', 'level')}, count(*) FILTER (top >= level) AS total, count(*) FILTER (top >= level AND pick <> y_true) AS wrong,
 {r('CASE WHEN count(*) FILTER (top >= level) > 0 THEN count(*) FILTER (top >= level AND pick <> y_true) / count(*) FILTER (top >= level)::DOUBLE END', 'error_rate')}, {r('avg((pick <> y_true)::INT)', 'overall')} FROM t, k GROUP BY 1, 2, level"""
)
def m35_confident_failures(spark, sf):
    """How often picks of at least .5, .6 and .7 fail, by competition, beside the overall rate."""
    p = predictions(spark, sf).select("competition_id", F.greatest(*m.P).alias("top"), (fn.argmax(*(F.col(c) for c in m.P)) != F.col("y_true")).alias("wrong"))
    rows = p.withColumn("level", F.explode(F.array(*map(F.lit, (0.5, 0.6, 0.7)))))
    sure = F.col("top") >= F.col("level")
    found = rows.groupBy("competition_id", "level").agg(F.count_if(sure).alias("total"), F.count_if(sure & F.col("wrong")).alias("wrong"), F.avg(F.col("wrong").cast("double")).alias("overall"))
    return found.select("competition_id", "level", "total", "wrong", F.when(F.col("total") > 0, F.col("wrong") / F.col("total")).alias("error_rate"), "overall")


@query(f"WITH {PREDS}, {_grid(6)}, t AS (SELECT fixture_id, i || '-' || j AS score, round(ph * pa, 9) AS p, row_number() OVER (PARTITION BY fixture_id ORDER BY round(ph * pa, 9) DESC, i, j) AS place FROM grid) SELECT fixture_id, CAST(place AS INT) AS place, score, {r('p', 'p')} FROM t WHERE place <= 3")
def t3_top_scorelines(spark, sf):
    """The three likeliest scores of the 0..6 goal grid; of equal ones those with fewer goals."""
    pmfs = predictions(spark, sf).select("fixture_id", fn.pmf_values(F.col("lambda_home"), 6).alias("ph"), fn.pmf_values(F.col("lambda_away"), 6).alias("pa"))
    found = pmfs.select("fixture_id", F.explode(fn.likeliest_scores(F.col("ph"), F.col("pa"), 6, 3)).alias("c"))
    return found.select("fixture_id", "c.place", "c.score", "c.p")


@query(
    f"""{_D}, o AS (SELECT d, row_number() OVER (ORDER BY unix, fixture_id) AS pos FROM d), w AS (SELECT pos - 1 AS start, sum(d) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS total FROM o),
 u AS (SELECT * FROM w WHERE start <= (SELECT count(*) FROM o) - 20), x AS (SELECT replicate, total, {_U.format(k='start')} AS u FROM u, (SELECT unnest(range(1, 101)) AS replicate)), m AS (SELECT replicate, sum({_W} * total) / sum({_W} * 20) AS mean FROM x GROUP BY replicate) {_CI}"""
)
def b3_moving_blocks(spark, sf):
    """Bootstrap over all runs of 20 rows in order of kickoff."""
    d = m.log_loss() - m.log_loss(Q)
    rows = predictions(spark, sf).select("unix", "fixture_id", d.alias("d"))
    blocks = resample.moving_blocks(rows, ["unix", "fixture_id"], F.floor(F.col("unix") / 86400), "d", 20)
    return resample.interval(resample.means(blocks, "start", "total", "size", 100))


@query(f"{SCORED}, x AS (SELECT replicate, (pick_q = y_true)::INT - (pick = y_true)::INT AS d, {_U.format(k='fixture_id')} AS u FROM s, (SELECT unnest(range(1, 101)) AS replicate)), m AS (SELECT replicate, sum({_W} * d) / sum({_W})::DOUBLE AS mean FROM x GROUP BY replicate) {_CI}")
def b4_accuracy_bootstrap(spark, sf):
    """Bootstrap of the accuracy difference of two models, conclusive where the interval leaves out zero."""
    right = lambda names: (fn.argmax(*(F.col(c) for c in names)) == F.col("y_true")).cast("int")
    rows = predictions(spark, sf).select("fixture_id", (right(Q) - right(m.P)).alias("total"), F.lit(1).alias("size"))
    return resample.interval(resample.means(rows, "fixture_id", "total", "size", 100))


def _as_q(sql: str) -> str:
    return sql.replace("p_home", "q_home").replace("p_draw", "q_draw").replace("p_away", "q_away")


_DELTAS = {"accuracy": "(pick_q = y_true)::INT - (pick = y_true)::INT", "log_loss": f"({_as_q(LL)}) - ({LL})", "brier": f"({_as_q(BRIER)}) - ({BRIER})", "rps": f"({_as_q(RPS)}) - ({RPS})"}


@query(
    f"{SCORED}, x AS (SELECT replicate, {', '.join(f'{e} AS {n}' for n, e in _DELTAS.items())}, {_U.format(k='fixture_id')} AS u FROM s, (SELECT unnest(range(1, 101)) AS replicate)), "
    f"y AS (SELECT replicate, {', '.join(f'sum({_W} * {n}) / sum({_W})::DOUBLE AS {n}' for n in _DELTAS)} FROM x GROUP BY replicate) "
    + " UNION ALL ".join(f"SELECT * FROM (WITH m AS (SELECT {n} AS mean FROM y) SELECT '{n}' AS metric, * FROM ({_CI}))" for n in _DELTAS)
)
def b5_metric_bootstrap(spark, sf):
    """One bootstrap for the differences of accuracy, log loss, Brier score and RPS."""
    right = lambda names: (fn.argmax(*(F.col(c) for c in names)) == F.col("y_true")).cast("int")
    deltas = {"accuracy": right(Q) - right(m.P), "log_loss": m.log_loss(Q) - m.log_loss(), "brier": m.brier(Q) - m.brier(), "rps": m.rps(Q) - m.rps()}
    rows = predictions(spark, sf).select("fixture_id", F.lit(1).alias("size"), *(c.alias(f"d_{n}") for n, c in deltas.items()))
    drawn = resample.means(rows, "fixture_id", {n: f"d_{n}" for n in deltas}, "size", 100)
    parts = [resample.interval(drawn, n).withColumn("metric", F.lit(n)) for n in deltas]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def methods(rows):
    """Candidate calibrations without a fit: (method, y_true, m_h, m_d, m_a) for every row."""
    p, q = [F.col(c) for c in m.P], [F.col(c) for c in Q]
    found = {"uncalibrated": p, "temperature": fn.temperature(p, 1.4), "blend": fn.blend(p, q, 0.5)}
    cells = [F.struct(F.lit(n).alias("method"), *(c.alias(f"m_{s}") for c, s in zip(v, "hda", strict=True))) for n, v in found.items()]
    return rows.select("season_year", "y_true", F.explode(F.array(*cells)).alias("c")).select("season_year", "y_true", "c.*")


@query(
    f"""WITH {PREDS}, c AS (SELECT season_year, y_true, 'uncalibrated' AS method, p_home AS h, p_draw AS d, p_away AS a FROM preds UNION ALL SELECT season_year, y_true, 'temperature', power(p_home, 1 / 1.4e0), power(p_draw, 1 / 1.4e0), power(p_away, 1 / 1.4e0) FROM preds
 UNION ALL SELECT season_year, y_true, 'blend', sqrt(p_home * q_home), sqrt(p_draw * q_draw), sqrt(p_away * q_away) FROM preds), n AS (SELECT season_year, method, y_true, h / (h + d + a) AS h, d / (h + d + a) AS d, a / (h + d + a) AS a FROM c WHERE season_year IN (1995, 1996, 1997)),
 f AS (SELECT method, season_year, avg(-ln(CASE y_true WHEN 'H' THEN h WHEN 'D' THEN d ELSE a END)) AS ll, avg(power(h - (y_true = 'H')::INT, 2) + power(d - (y_true = 'D')::INT, 2) + power(a - (y_true = 'A')::INT, 2)) AS br FROM n GROUP BY 1, 2),
 g AS (SELECT method, avg(ll) AS ll, avg(br) AS br FROM f GROUP BY 1), b AS (SELECT ll, br FROM g WHERE method = 'uncalibrated'),
 e AS (SELECT g.*, method <> 'uncalibrated' AND b.ll - g.ll > 0.005 AND g.br - b.br <= 0.005 AS eligible FROM g, b)
SELECT method, {r('ll', 'log_loss')}, {r('br', 'brier')}, eligible, coalesce((SELECT arg_min(method, ll) FROM e WHERE eligible), 'uncalibrated') AS selected FROM e"""
)
def k9_calibration_choice(spark, sf):
    """K9: a calibration is chosen only if its mean log loss over the folds gains more than the margin and Brier doesn't lose it."""
    rows = methods(predictions(spark, sf).where("season_year in (1995, 1996, 1997)"))
    p = ("m_h", "m_d", "m_a")
    folds = rows.groupBy("method", "season_year").agg(F.avg(m.log_loss(p)).alias("log_loss"), F.avg(m.brier(p)).alias("brier"))
    means = folds.groupBy("method").agg(F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"))
    base = means.where("method = 'uncalibrated'").select(F.col("log_loss").alias("b_ll"), F.col("brier").alias("b_br"))
    fit = (F.col("method") != "uncalibrated") & (F.col("b_ll") - F.col("log_loss") > 0.005) & (F.col("brier") - F.col("b_br") <= 0.005)
    judged = means.crossJoin(F.broadcast(base)).select("method", "log_loss", "brier", fit.alias("eligible"))
    best = judged.agg(F.coalesce(F.min_by("method", F.when(F.col("eligible"), F.col("log_loss"))), F.lit("uncalibrated")).alias("selected"))
    return judged.crossJoin(F.broadcast(best))


_PAIRED = ["elo_diff", "lambda_home", "lambda_away", "p_home", "p_draw", "q_home"]
_PAIRS = [(a, b) for k, a in enumerate(_PAIRED) for b in _PAIRED[k + 1 :]]


@query(
    f"WITH RECURSIVE {PREDS}, c(a, b, x) AS (" + " UNION ALL ".join(f"SELECT '{a}', '{b}', abs(corr({a}, {b})) FROM preds" for a, b in _PAIRS) + "), e AS (SELECT a, b FROM c WHERE x >= 0.35 UNION SELECT b, a FROM c WHERE x >= 0.35), "
    + "n(v) AS (VALUES " + ", ".join(f"('{c}')" for c in _PAIRED) + "), reach(v, w) AS (SELECT v, v FROM n UNION SELECT r.v, e.b FROM reach r JOIN e ON e.a = r.w) SELECT v AS feature, min(w) AS cluster, count(*) AS size FROM reach GROUP BY v"
)
def m36_correlation_clusters(spark, sf):
    """Features whose correlations reach .35, directly or through others; all pairs in one aggregate."""
    p = predictions(spark, sf)
    found = p.agg(*(F.abs(F.corr(a, b)).alias(f"r{k}") for k, (a, b) in enumerate(_PAIRS))).first()
    label = {c: c for c in _PAIRED}
    for _ in _PAIRED:
        for k, (a, b) in enumerate(_PAIRS):
            if found[k] >= 0.35:
                label[a] = label[b] = min(label[a], label[b])
    sizes = {c: sum(label[d] == label[c] for d in _PAIRED) for c in _PAIRED}
    return spark.createDataFrame([(c, label[c], sizes[c]) for c in _PAIRED], "feature string, cluster string, size long")


@query()
def m36_collinearity(spark, sf):
    """Variance inflation of each feature and the condition number, from one aggregate of all correlations."""
    names = ["elo_diff", "lambda_home", "lambda_away", "p_home", "q_draw"]
    found = predictions(spark, sf).agg(*(F.corr(a, b).alias(f"r{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names[:i]))).first()
    r_ = np.eye(len(names))
    for i in range(len(names)):
        for j in range(i):
            r_[i, j] = r_[j, i] = found[f"r{i}_{j}"]
    rows = [(c, float(v), float(np.linalg.cond(r_))) for c, v in zip(names, np.diag(np.linalg.inv(r_)), strict=True)]
    return spark.createDataFrame(rows, "feature string, vif double, condition double")


_ARMS = {"all": ["elo_diff", "lambda_home", "lambda_away"], "ratings": ["elo_diff"], "rates": ["lambda_home", "lambda_away"]}


@query()
def k21_ablation(spark, sf):
    """The outcome regression with each set of features, on every fold, and its loss against all features."""
    p, parts = predictions(spark, sf), []
    for year in (1996, 1997):
        train, test = p.where(F.col("season_year") < year), p.where(F.col("season_year") == year)
        for arm, columns in _ARMS.items():
            out = cal.outcome_model(train, columns).transform(test).withColumn("p", vector_to_array("probability"))
            rows = out.select("y_true", *(F.get("p", F.lit(k)).alias(f"m_{v}") for k, v in enumerate("HDA")))
            scored = m.scorecard(rows, p=("m_H", "m_D", "m_A")).select("n", "log_loss", "brier")
            parts.append(scored.select(F.lit(year).alias("fold"), F.lit(arm).alias("arm"), "n", "log_loss", "brier"))
    table = reduce(DataFrame.unionByName, parts)
    base = F.max(F.when(F.col("arm") == "all", F.col("log_loss"))).over(W.partitionBy("fold"))
    return table.withColumn("delta", F.col("log_loss") - base)
