"""Queries of selections, inventories, integrity and comparisons over cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchweave.functions import probability as fn
from matchweave.operators import metrics as m
from matchweave.plans.base import query, r
from matchweave.plans.metrics import SCORED
from matchweave.plans.probability import _grid
from matchweave.sources.bindings import CONTESTS, PREDS, contests, predictions

Q = ("q_home", "q_draw", "q_away")
NOW = 852076800


def hit(names=m.P):
    return fn.argmax(*(F.col(c) for c in names)) == F.col("y_true")


def rate(condition):
    return F.avg(condition.cast("double"))


@query("WITH " + CONTESTS + f" SELECT fixture_id, unix, competition_id, status FROM contests WHERE competition_id IN (0, 2, 4) AND status IN ('NS', 'ABANDONED') AND unix >= {NOW} AND unix < {NOW} + 90 * 86400")
def p9_upcoming(spark, sf):
    """Contests of a set of leagues and statuses within a horizon, in order of kickoff."""
    c = contests(spark, sf).where(F.col("competition_id").isin(0, 2, 4) & F.col("status").isin("NS", "ABANDONED"))
    return c.where(F.col("unix").between(NOW, NOW + 90 * 86400 - 1)).select("fixture_id", "unix", "competition_id", "status").orderBy("unix", "fixture_id")


@query("WITH " + CONTESTS + f" SELECT fixture_id, (unix >= {NOW} AND unix < {NOW} + 86400) AS by_epoch, strftime(to_timestamp(unix), '%Y-%m-%d') LIKE '1997-01%' AS by_prefix FROM contests WHERE (unix >= {NOW} AND unix < {NOW} + 86400) OR strftime(to_timestamp(unix), '%Y-%m-%d') LIKE '1997-01%'")
def p10_day_filter(spark, sf):
    """P10: contests of a day by epoch range, or by a prefix of the date."""
    epoch = (F.col("unix") >= NOW) & (F.col("unix") < NOW + 86400)
    prefix = F.date_format(F.timestamp_seconds("unix"), "yyyy-MM-dd").startswith("1997-01")
    return contests(spark, sf).where(epoch | prefix).select("fixture_id", epoch.alias("by_epoch"), prefix.alias("by_prefix"))


@query("WITH " + CONTESTS + f" SELECT DISTINCT fixture_id, unix FROM contests WHERE status = 'FT' AND unix BETWEEN {NOW} AND {NOW} + 9 * 86400")
def p12_completed_range(spark, sf):
    """Played contests of a date range from overlapping daily fetches, one row for each id."""
    c = contests(spark, sf).where("status = 'FT'")
    fetched = [c.where(F.col("unix").between(NOW + k * 86400, NOW + (k + 2) * 86400)) for k in range(8)]
    union = fetched[0]
    for part in fetched[1:]:
        union = union.unionByName(part)
    return union.dropDuplicates(["fixture_id"]).select("fixture_id", "unix").orderBy("unix", "fixture_id")


@query(
    f"""WITH {PREDS}, l AS (SELECT *, unix + (fixture_id % 5 - 3) * 3600 AS predicted_at, CASE WHEN fixture_id % 31 = 0 THEN p_home + 0.5e0 WHEN fixture_id % 37 = 0 THEN -p_home ELSE p_home END AS ph FROM preds),
 f AS (SELECT predicted_at < unix AS timely, ph BETWEEN 0 AND 1 AS inside, abs(ph + p_draw + p_away - 1) <= 1e-6 AS whole FROM l) SELECT timely, inside, whole, count(*) AS n, timely AND inside AND whole AS valid FROM f GROUP BY 1, 2, 3"""
)
def p14_integrity(spark, sf):
    """Predicted before kickoff, probabilities within bounds, sums of one; counted by outcome."""
    shifted = F.when(F.col("fixture_id") % 31 == 0, F.col("p_home") + 0.5).when(F.col("fixture_id") % 37 == 0, -F.col("p_home")).otherwise(F.col("p_home"))
    rows = predictions(spark, sf).withColumns({"ph": shifted, "predicted_at": F.col("unix") + (F.col("fixture_id") % 5 - 3) * 3600})
    flags = rows.select((F.col("predicted_at") < F.col("unix")).alias("timely"), F.col("ph").between(0, 1).alias("inside"), (F.abs(F.col("ph") + F.col("p_draw") + F.col("p_away") - 1) <= 1e-6).alias("whole"))
    return flags.groupBy("timely", "inside", "whole").agg(F.count("*").alias("n")).withColumn("valid", F.col("timely") & F.col("inside") & F.col("whole"))


_RANGES = {"home_goals": (0, 3), "away_goals": (0, 2), "home_shots_on": (0, 7), "home_xg": (0, 2)}


@query("WITH " + CONTESTS + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, {lo}e0 AS low, {hi}e0 AS high, count(*) FILTER ({c} < {lo}) AS below, count(*) FILTER ({c} > {hi}) AS above, count({c}) AS known FROM contests" for c, (lo, hi) in _RANGES.items())
       + " UNION ALL SELECT 'home_shots_on over home_shots', NULL, NULL, 0, count(*) FILTER (home_shots_on > home_shots), count(home_shots_on) FROM contests")
def p15_impossible_values(spark, sf):
    """Values outside each field's domain, and parts above their whole, in one aggregate."""
    cells = [
        F.struct(F.lit(c).alias("field"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"), F.count_if(F.col(c) < lo).alias("below"), F.count_if(F.col(c) > hi).alias("above"), F.count(c).alias("known"))
        for c, (lo, hi) in _RANGES.items()
    ]
    none = F.lit(None).cast("double")
    cells.append(F.struct(F.lit("home_shots_on over home_shots").alias("field"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below"), F.count_if(F.col("home_shots_on") > F.col("home_shots")).alias("above"), F.count("home_shots_on").alias("known")))
    found = contests(spark, sf).agg(*(c.alias(f"c{k}") for k, c in enumerate(cells)))
    return found.select(F.explode(F.array(*(F.col(f"c{k}") for k in range(len(cells))))).alias("c")).select("c.*")


def clock(now: int, buffer: int):
    """Whether a contest may still be predicted, or why not."""
    done = F.col("status").isin("FT", "AWARDED")
    return F.when(done, "completed").when(F.lit(now) >= F.col("unix"), "started").when(F.lit(now) >= F.col("unix") - buffer, "too close").otherwise("open")


@query("WITH " + CONTESTS + f" SELECT CASE WHEN status IN ('FT', 'AWARDED') THEN 'completed' WHEN {NOW} >= unix THEN 'started' WHEN {NOW} >= unix - 864000 THEN 'too close' ELSE 'open' END AS clock, count(*) AS n, min(unix) AS first FROM contests GROUP BY 1")
def p16_prediction_clock(spark, sf):
    """Contests by the eligibility clock."""
    return contests(spark, sf).groupBy(clock(NOW, 864000).alias("clock")).agg(F.count("*").alias("n"), F.min("unix").alias("first"))


@query("WITH " + CONTESTS + ", " + PREDS + """, o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS season_year, count(*) AS raw FROM orders GROUP BY 1), c AS (SELECT season_year, count(*) AS typed, count(DISTINCT fixture_id) AS ids, count(*) FILTER (home_goals IS NULL) AS without_score FROM contests GROUP BY 1),
 p AS (SELECT season_year, count(*) AS predicted FROM preds GROUP BY 1) SELECT season_year, raw, typed, ids, without_score, coalesce(predicted, 0) AS predicted, raw - coalesce(predicted, 0) AS dropped FROM o JOIN c USING (season_year) LEFT JOIN p USING (season_year)""")
def a15_reconciliation(spark, sf):
    """Raw, typed and predicted rows of each season against each other."""
    raw = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.year("o_orderdate").cast("long").alias("season_year")).agg(F.count("*").alias("raw"))
    typed = contests(spark, sf).groupBy("season_year").agg(F.count("*").alias("typed"), F.count_distinct("fixture_id").alias("ids"), F.count_if(F.col("home_goals").isNull()).alias("without_score"))
    made = predictions(spark, sf).groupBy("season_year").agg(F.count("*").alias("predicted"))
    both = raw.join(typed, "season_year").join(made, "season_year", "left").fillna(0, ["predicted"])
    return both.withColumn("dropped", F.col("raw") - F.col("predicted"))


@query("WITH " + PREDS + f""", s AS (SELECT competition_id, count(*) AS locked, count(y_true) FILTER (season_year < 1998) AS settled FROM preds GROUP BY 1) SELECT competition_id, locked, settled, locked - settled AS pending, {r('100e0 * settled / locked', 'settled_pct')}, {r('least(100e0 * settled / 300, 100)', 'progress_300')}, {r('least(100e0 * settled / 1050, 100)', 'progress_1050')} FROM s""")
def a20_progress(spark, sf):
    """Locked, settled and pending predictions, and the way to the sample sizes."""
    s = predictions(spark, sf).groupBy("competition_id").agg(F.count("*").alias("locked"), F.count_if(F.col("season_year") < 1998).alias("settled"))
    return s.select("competition_id", "locked", "settled", (F.col("locked") - F.col("settled")).alias("pending"), (100.0 * F.col("settled") / F.col("locked")).alias("settled_pct"), *(F.least(100.0 * F.col("settled") / n, F.lit(100.0)).alias(f"progress_{n}") for n in (300, 1050)))


@query("WITH " + CONTESTS + " SELECT status, competition_id, home_goals IS NOT NULL AS labelled, count(*) AS n FROM contests GROUP BY CUBE (status, competition_id, labelled) HAVING grouping_id(status, competition_id, home_goals IS NOT NULL) IN (3, 5, 6)")
def a22_inventory(spark, sf):
    """Counts by status, by league and by label, from one grouping."""
    c = contests(spark, sf).select("status", "competition_id", F.col("home_goals").isNotNull().alias("labelled"))
    return c.cube("status", "competition_id", "labelled").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g in (3, 5, 6)").drop("g")


@query(f"""{SCORED} SELECT competition_id, {r("avg(power(p_draw - (y_true = 'D')::INT, 2))", 'draw_brier')}, {r("avg(-ln(CASE WHEN y_true = 'D' THEN p_draw ELSE 1 - p_draw END))", 'draw_log_loss')}, {r("avg(p_draw) - avg((y_true = 'D')::INT)", 'bias')}, {r("avg((pick = 'D')::INT)", 'predicted_rate')}, {r("avg((pick = 'D')::INT) FILTER (y_true = 'D')", 'recall')} FROM s GROUP BY 1""")
def m6_draw_scores(spark, sf):
    """M6: Brier score, log loss, bias, predicted rate and recall of draws."""
    draw = (F.col("y_true") == "D").cast("double")
    picked = (fn.argmax(*(F.col(c) for c in m.P)) == "D").cast("double")
    return predictions(spark, sf).groupBy("competition_id").agg(
        F.avg(F.pow(F.col("p_draw") - draw, F.lit(2))).alias("draw_brier"), F.avg(-F.log(F.when(draw == 1, F.col("p_draw")).otherwise(1 - F.col("p_draw")))).alias("draw_log_loss"),
        (F.avg("p_draw") - F.avg(draw)).alias("bias"), F.avg(picked).alias("predicted_rate"), F.avg(F.when(draw == 1, picked)).alias("recall"),
    )


@query(
    f"""{SCORED}, l AS (SELECT 'H' AS y, p_home AS p, y_true FROM s UNION ALL SELECT 'D', p_draw, y_true FROM s UNION ALL SELECT 'A', p_away, y_true FROM s), b AS (SELECT y, least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg((y = y_true)::INT) AS share FROM l GROUP BY 1, 2)
SELECT k.y, k.bin, coalesce(n, 0) AS n, {r('mean_p', 'mean_p')}, {r('share', 'share')} FROM (SELECT y, bin FROM (SELECT unnest(['H', 'D', 'A']) AS y), (SELECT unnest(range(10)) AS bin)) k LEFT JOIN b ON b.y = k.y AND b.bin = k.bin"""
)
def m8_reliability_bins(spark, sf):
    """M8: ten bins of each class's probability, empty ones too."""
    cells = F.explode(F.array(*(F.struct(F.lit(v).alias("y"), F.col(c).alias("p")) for v, c in zip("HDA", m.P, strict=True))))
    rows = predictions(spark, sf).select("y_true", cells.alias("c")).select("y_true", "c.*")
    bins = rows.groupBy("y", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), rate(F.col("y") == F.col("y_true")).alias("share"))
    grid = spark.createDataFrame([(v, b) for v in "HDA" for b in range(10)], "y string, bin long")
    return grid.join(bins, ["y", "bin"], "left").fillna(0, ["n"])


@query(
    f"""{SCORED}, k AS (SELECT *, 1 + (p_home > p_draw)::INT + (p_away > p_draw)::INT AS place FROM s), g AS (SELECT y_true = 'D' AS drawn, count(*) AS n, avg((place = 1)::INT) AS one, avg((place = 2)::INT) AS two, avg((place = 3)::INT) AS three, avg((p_draw > p_home)::INT) AS over_home, avg((p_draw > p_away)::INT) AS over_away, avg(p_draw) AS mean_p, max(p_draw) AS top FROM k GROUP BY 1)
SELECT drawn, n, {r('one', 'rank1')}, {r('two', 'rank2')}, {r('three', 'rank3')}, {r('over_home', 'over_home')}, {r('over_away', 'over_away')}, {r('mean_p', 'mean_p')}, {r('top', 'top_p')}, CASE WHEN one >= 0.25 THEN 'leads' WHEN two >= one THEN 'second' ELSE 'rare' END AS verdict FROM g"""
)
def m15_draw_rank(spark, sf):
    """The draw's rank among the classes, how often it beats either side, by outcome, with a verdict."""
    above = lambda c: (F.col(c) > F.col("p_draw")).cast("int")
    rows = predictions(spark, sf).withColumn("place", 1 + above("p_home") + above("p_away"))
    found = rows.groupBy((F.col("y_true") == "D").alias("drawn")).agg(
        F.count("*").alias("n"), *(rate(F.col("place") == k).alias(f"rank{k}") for k in (1, 2, 3)), rate(F.col("p_draw") > F.col("p_home")).alias("over_home"), rate(F.col("p_draw") > F.col("p_away")).alias("over_away"), F.avg("p_draw").alias("mean_p"), F.max("p_draw").alias("top_p"),
    )
    return found.withColumn("verdict", F.when(F.col("rank1") >= 0.25, "leads").when(F.col("rank2") >= F.col("rank1"), "second").otherwise("rare"))


_JS = " + ".join(f"0.5 * ({p} * ln({p} / (({p} + {q}) / 2)) + {q} * ln({q} / (({p} + {q}) / 2)))" for p, q in zip(m.P, Q, strict=True))
_L1 = " + ".join(f"abs({p} - {q})" for p, q in zip(m.P, Q, strict=True))
_TOP = "greatest(" + ", ".join(f"abs({p} - {q})" for p, q in zip(m.P, Q, strict=True)) + ")"
_LLQ = "-ln(CASE y_true WHEN 'H' THEN q_home WHEN 'D' THEN q_draw ELSE q_away END)"


@query(
    f"""{SCORED}, d AS (SELECT *, {_LLQ} AS lq, {_JS} AS js, ({_L1}) / 3 AS mad, {_TOP} AS top FROM s) SELECT season_year, {r('avg((pick = pick_q)::INT)', 'agreement')}, {r('avg(js)', 'divergence')}, {r('avg(mad)', 'mean_abs')}, {r('avg((top > 0.02)::INT)', 'over_02')}, {r('avg((top > 0.05)::INT)', 'over_05')},
 {r('avg(least(ll, lq))', 'best_of_both')}, {r('avg((lq < ll)::INT)', 'second_better')}, {r('corr(ll, lq)', 'loss_correlation')}, count(*) FILTER (pick = y_true AND pick_q <> y_true) AS only_first, count(*) FILTER (pick <> y_true AND pick_q = y_true) AS only_second FROM d GROUP BY 1"""
)
def m19_model_comparison(spark, sf):
    """Agreement, divergence, rates of material change and complementarity of two models by season."""
    js = sum(0.5 * (F.col(p) * F.log(F.col(p) / ((F.col(p) + F.col(q)) / 2)) + F.col(q) * F.log(F.col(q) / ((F.col(p) + F.col(q)) / 2))) for p, q in zip(m.P, Q, strict=True))
    gaps = [F.abs(F.col(p) - F.col(q)) for p, q in zip(m.P, Q, strict=True)]
    top, one, two = F.greatest(*gaps), m.log_loss(), m.log_loss(Q)
    same = fn.argmax(*(F.col(c) for c in m.P)) == fn.argmax(*(F.col(c) for c in Q))
    return predictions(spark, sf).groupBy("season_year").agg(
        rate(same).alias("agreement"), F.avg(js).alias("divergence"), F.avg(sum(gaps) / 3).alias("mean_abs"), rate(top > 0.02).alias("over_02"), rate(top > 0.05).alias("over_05"),
        F.avg(F.least(one, two)).alias("best_of_both"), rate(two < one).alias("second_better"), F.corr(one, two).alias("loss_correlation"),
        F.count_if(hit() & ~hit(Q)).alias("only_first"), F.count_if(~hit() & hit(Q)).alias("only_second"),
    )


@query(f"WITH {PREDS}, {_grid(3)}, e AS (SELECT i, j, avg(ph * pa) AS expected FROM grid GROUP BY 1, 2), o AS (SELECT home_goals AS i, away_goals AS j, count(*) / (SELECT count(*) FROM preds)::DOUBLE AS observed FROM preds GROUP BY 1, 2) SELECT e.i AS home_goals, e.j AS away_goals, {r('coalesce(observed, 0)', 'observed')}, {r('expected', 'expected')}, {r('coalesce(observed, 0) - expected', 'gap')} FROM e LEFT JOIN o ON o.i = e.i AND o.j = e.j")
def m41_scores_against_model(spark, sf):
    """Observed share of each score up to three goals a side against the model's mean probability."""
    p = predictions(spark, sf).select("home_goals", "away_goals", fn.poisson_pmf(F.col("lambda_home"), 3).alias("ph"), fn.poisson_pmf(F.col("lambda_away"), 3).alias("pa"))
    cells = [
        F.struct(
            F.lit(i).alias("home_goals"), F.lit(j).alias("away_goals"), rate((F.col("home_goals") == i) & (F.col("away_goals") == j)).alias("observed"),
            F.avg(F.get("ph", F.lit(i)) * F.get("pa", F.lit(j))).alias("expected"),
        )
        for i in range(4)
        for j in range(4)
    ]
    found = p.agg(*(c.alias(f"c{k}") for k, c in enumerate(cells))).select(F.explode(F.array(*(F.col(f"c{k}") for k in range(16)))).alias("c")).select("c.*")
    return found.withColumn("gap", F.col("observed") - F.col("expected"))


@query(
    f"""{SCORED}, b AS (SELECT season_year * 10 + quarter(to_timestamp(unix)) AS bucket, *, {_LLQ} AS lq FROM s), g AS (SELECT bucket, count(*) AS n, avg((pick = y_true)::INT) AS a1, avg((pick_q = y_true)::INT) AS a2, avg(ll) AS l1, avg(lq) AS l2 FROM b GROUP BY 1)
SELECT bucket, n, {r('a1', 'accuracy')}, {r('a2', 'accuracy_second')}, {r('l1', 'log_loss')}, {r('l2', 'log_loss_second')}, {r('l2 - l1', 'delta')}, {r('l1 - lag(l1) OVER (ORDER BY bucket)', 'drift')}, {r('sum(a1 * n) OVER (ORDER BY bucket) / sum(n) OVER (ORDER BY bucket)', 'cumulative_accuracy')} FROM g"""
)
def o9_prospective(spark, sf):
    """Two models by quarter with deltas, drift against the quarter before and cumulative accuracy; windows run over quarters."""
    from pyspark.sql import Window as W

    bucket = (F.col("season_year") * 10 + F.quarter(F.timestamp_seconds("unix"))).alias("bucket")
    g = predictions(spark, sf).groupBy(bucket).agg(
        F.count("*").alias("n"), rate(hit()).alias("accuracy"), rate(hit(Q)).alias("accuracy_second"), F.avg(m.log_loss()).alias("log_loss"), F.avg(m.log_loss(Q)).alias("log_loss_second"), F.count_if(hit()).alias("right")
    )
    order = W.orderBy("bucket")
    return g.select(
        "bucket", "n", "accuracy", "accuracy_second", "log_loss", "log_loss_second", (F.col("log_loss_second") - F.col("log_loss")).alias("delta"),
        (F.col("log_loss") - F.lag("log_loss").over(order)).alias("drift"), (F.sum("right").over(order) / F.sum("n").over(order)).alias("cumulative_accuracy"),
    )
