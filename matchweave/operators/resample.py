"""Bootstraps with weights from key hashes: deterministic, and the same on every engine."""

from __future__ import annotations

from functools import reduce
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: P(X <= k) of a Poisson(1) count.
STEPS = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(9)]


def draws(block: Column, unit: Column) -> list[Column]:
    """Four numbers in [0, 1) from the MD5 of block and unit: eight hex digits each."""
    digest = F.md5(F.concat_ws("|", block.cast("string"), unit.cast("string")))
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("double") / 4294967296.0 for k in range(4)]


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count by inversion."""
    return sum((F.when(u >= s, 1).otherwise(0) for s in STEPS[1:]), F.when(u >= STEPS[0], 1).otherwise(0))


def means(rows: DataFrame, unit: str, totals: dict[str, str] | str, size: str, replicates: int) -> DataFrame:
    """(replicate, a mean for each of totals): units are drawn with Poisson(1) weights.

    rows holds one row per unit with sums over its observations and their number; a unit may be a
    row, a cluster or a block. totals names the sums by result; a single name gives `mean`.
    A digest serves four replicates. Only sums leave a task.
    """
    totals = {"mean": totals} if isinstance(totals, str) else totals
    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))))
    weights = {f"w{k}": poisson_weight(u) for k, u in enumerate(draws(F.col("block"), F.col(unit)))}
    sums = spread.withColumns(weights).groupBy("block").agg(
        *(F.sum(F.col(w) * F.col(c)).alias(f"{w}_{n}") for w in weights for n, c in [*totals.items(), ("size", size)])
    )
    cells = [
        F.struct((4 * F.col("block") + k + 1).alias("replicate"), *((F.col(f"{w}_{n}") / F.col(f"{w}_size")).alias(n) for n in totals))
        for k, w in enumerate(weights)
    ]
    return sums.select(F.explode(F.array(*cells)).alias("r")).select("r.*").where(F.col("replicate") <= replicates)


def moving_blocks(rows: DataFrame, order: list[str], bucket: Column, value: str, length: int) -> DataFrame:
    """(start, total, size) of every run of `length` rows in order; start counts from 0.

    Sums up to each row come from bucket totals plus a window within the bucket (such as a day, of
    which `order` must not leave the order), and meet `length` rows on by an equi-join, so that no
    task sorts all rows.
    """
    keyed = rows.select(*order, F.col(value).cast("double").alias("value"), bucket.alias("bucket"))
    sums = keyed.groupBy("bucket").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)).alias("before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank"))
    within = W.partitionBy("bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    upto = keyed.select("bucket", F.sum("value").over(within).alias("sum"), F.count("*").over(within).alias("n")).join(offsets, "bucket")
    upto = upto.select((F.col("rank") + F.col("n")).alias("at"), (F.col("before") + F.col("sum")).alias("sum"))
    starts = upto.unionByName(rows.sparkSession.createDataFrame([(0, 0.0)], "at long, sum double"))
    later = upto.select((F.col("at") - length).alias("at"), F.col("sum").alias("end"))
    return starts.join(later, "at").select(F.col("at").alias("start"), (F.col("end") - F.col("sum")).alias("total"), F.lit(length).alias("size"))


def interval(replicates: DataFrame, mean: str = "mean") -> DataFrame:
    """Percentile interval, share below zero, two-sided p-value, and whether the interval leaves out zero."""
    below = F.avg((F.col(mean) < 0).cast("double"))
    low, high = F.percentile(mean, 0.025), F.percentile(mean, 0.975)
    return replicates.agg(
        F.count("*").alias("replicates"), low.alias("low"), high.alias("high"), below.alias("share_below"), F.least(2 * below, 2 * (1 - below), F.lit(1.0)).alias("p_value"), ((low > 0) | (high < 0)).alias("conclusive")
    )


def gate(rows: DataFrame, unit: str, loss: str, brier: str, replicates: int = 200, least: int = 1050, gain: float = 0.001, worse: float = 0.0005) -> DataFrame:
    """One row: whether a candidate passes a gate registered beforehand, by differences (candidate less base) of each row.

    Five conditions, all of which must hold: enough rows, a mean loss below zero, an interval wholly below zero, a gain
    that matters, and no Brier score worse than by `worse`. p_value is the share of replicates that show no gain. Without
    rows nothing holds.
    """
    whole = rows.agg(F.count(loss).alias("n"), F.avg(loss).alias("delta_log_loss"), F.avg(brier).alias("delta_brier"))
    drawn = means(rows.select(unit, F.col(loss).alias("total"), F.lit(1).alias("size")), unit, "total", "size", replicates)
    ends = drawn.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.avg((F.col("mean") >= 0).cast("double")).alias("p_value"))
    conditions = {
        "enough_rows": F.col("n") >= least, "improved": F.col("delta_log_loss") < 0, "significant": F.col("high") < 0,
        "practical": F.col("delta_log_loss") <= -gain, "no_degradation": F.col("delta_brier") <= worse,
    }
    found = whole.crossJoin(F.broadcast(ends)).withColumns({k: F.coalesce(c, F.lit(False)) for k, c in conditions.items()})
    return found.withColumn("decision", F.when(reduce(Column.__and__, (F.col(k) for k in conditions)), "ACCEPTED_PENDING_REVIEW").otherwise("REJECTED"))
