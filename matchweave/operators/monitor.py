"""Monitoring signals: availability, drift, class mass, eligibility and settled calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12


def null_rates(rows: DataFrame, families: dict[str, list[str]], groups: list[str]) -> DataFrame:
    """Per group and family, the highest null rate among its columns."""
    rates = {f: F.greatest(*(F.avg(F.col(c).isNull().cast("double")) for c in cs), F.lit(0.0)) for f, cs in families.items()}
    wide = rows.groupBy(*groups).agg(*(e.alias(f) for f, e in rates.items()))
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.col(f).alias("rate")) for f in families)))
    return wide.select(*groups, cells.alias("x")).select(*groups, "x.family", "x.rate")


def ceiling(rates: DataFrame, limit: float = 0.078) -> DataFrame:
    """ALERT above the limit, strictly."""
    return rates.withColumn("status", F.when(F.col("rate") > limit + EPSILON, "ALERT").otherwise("PASS"))


def drift(rates: DataFrame, baseline: DataFrame, points: float = 2.0) -> DataFrame:
    """Drift in percentage points over the family's baseline rate; only rises alert."""
    gap = (F.col("rate") - F.col("baseline")) * 100
    return rates.join(F.broadcast(baseline), "family", "left").withColumn("drift_pp", gap).withColumn(
        "status", F.when(F.col("baseline").isNull(), "NO_BASELINE").when(gap > points + EPSILON, "ALERT").otherwise("PASS")
    )


def class_mass(rows: DataFrame, p: dict[str, str], base: dict[str, float], groups: list[str], points: float = 5.0) -> DataFrame:
    """Mean predicted share of each class against its base rate, in percentage points."""
    wide = rows.groupBy(*groups).agg(*(F.avg(c).alias(k) for k, c in p.items()))
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("class"), ((F.col(k) - base[k]) * 100).alias("gap_pp")) for k in p)))
    return wide.select(*groups, cells.alias("x")).select(*groups, "x.class", "x.gap_pp").withColumn(
        "status", F.when(F.abs("gap_pp") > points + 1e-9, "ALERT").otherwise("PASS")
    )


def eligibility(predicted: Column, settled: Column, as_of: Column, maturity_days: int = 7, window_days: int = 30) -> Column:
    """Why a settled observation counts, or doesn't."""
    day = 86400
    return (
        F.when(settled.isNull(), "unsettled")
        .when(settled - predicted < maturity_days * day, "immature")
        .when((settled > as_of) | (settled < as_of - window_days * day), "outside_window")
        .otherwise("eligible")
    )


def settled_gap(rows: DataFrame, groups: list[str], p: str, happened: Column, least: int = 200, points: float = 5.0) -> DataFrame:
    """Mean probability against the share that happened; too few rows are no evidence."""
    found = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(happened.cast("double")).alias("share"))
    gap = (F.col("mean_p") - F.col("share")) * 100
    return found.withColumn("gap_pp", gap).withColumn(
        "status", F.when(F.col("n") < least, "INSUFFICIENT_SAMPLE").when(F.abs(gap) > points + 1e-9, "ALERT").otherwise("PASS")
    )


def sample_status(n: Column) -> Column:
    return F.when(n < 100, "COLLECTING").when(n < 300, "EARLY").when(n < 450, "PRELIMINARY").when(n < 1050, "SUBSTANTIAL").otherwise("COMPLETE")


def event_problems() -> Column:
    """What is wrong with a monitoring event (signal_id, status, severity, value)."""
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(F.col("signal_id").isNull(), "signal_id"),
                F.when(~F.coalesce(F.col("status").isin("PASS", "ALERT", "INSUFFICIENT_SAMPLE"), F.lit(False)), "status"),
                F.when(~F.coalesce(F.col("severity").isin("INFO", "WARNING", "CRITICAL"), F.lit(False)), "severity"),
                F.when(F.col("value").isNull() | F.isnan("value"), "value"),
            )
        ),
        ",",
    )


def pilot(rows: DataFrame, levels: list[str], key: str, order: str, valid: Column, base: Column, candidate: Column, target: int = 100, step: int = 25) -> DataFrame:
    """Scorecard, milestone and verdict of each cohort, at every level from the whole down (a rollup; upper ones are null).

    A row that isn't valid is rejected; of valid ones that share a key the first by order counts, the others are
    duplicates. base and candidate are the losses of two models; p_draw and y_true give the draw rates. A cohort below
    its target is in progress, one that reached it passes, with warnings if rows were rejected or repeated. It tells
    nothing of significance, which takes resample.gate.
    """
    scores = F.struct(base.alias("base"), candidate.alias("candidate"), (F.col("y_true") == "D").cast("double").alias("draw"), F.col("p_draw").alias("p_draw"))
    # None marks rows that the smallest order passes over
    keys = rows.groupBy(*levels, key).agg(F.min_by(scores, F.when(valid, F.col(order))).alias("s"), F.count_if(valid).alias("v"), F.count_if(~valid).alias("rejected"))
    counted = F.when(F.col("v") > 0, F.col("s"))
    found = keys.rollup(*levels).agg(
        F.grouping_id().cast("int").alias("above"), F.count_if(F.col("v") > 0).alias("n"), F.sum("rejected").alias("rejected"), F.sum(F.greatest(F.col("v") - 1, F.lit(0))).alias("duplicates"),
        F.avg(counted["base"]).alias("base_log_loss"), F.avg(counted["candidate"]).alias("candidate_log_loss"), F.avg(counted["draw"]).alias("draw_rate"), F.avg(counted["p_draw"]).alias("mean_p_draw"),
    )
    n = F.col("n")
    reached = F.least(F.floor(n / step) * step, F.lit(target)).cast("string")
    #: Fixed values of the verdict.
    verdict = (
        F.when(n == 0, "PILOT WAITING FOR FRESH DATA")
        .when(n < target, F.concat(F.lit("PILOT_IN_PROGRESS ("), n.cast("string"), F.lit(f"/{target})")))
        .when((F.col("rejected") == 0) & (F.col("duplicates") == 0), "PILOT_PASS — OPERATIONALLY CLEAN")
        .otherwise("PILOT_PASS_WITH_WARNINGS")
    )
    return found.withColumns(
        {"delta_log_loss": F.col("candidate_log_loss") - F.col("base_log_loss"), "milestone": F.concat(reached, F.lit(f" / {target}")), "verdict": verdict}
    )
