"""Scoring rules, calibration tables and group comparisons as grouped aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchweave.sources.storage import stored

from matchweave.functions.probability import argmax

LABELS = ("H", "D", "A")
P = ("p_home", "p_draw", "p_away")


def p_true(p=P, label: str = "y_true") -> Column:
    """The probability given to what happened."""
    return F.when(F.col(label) == "H", F.col(p[0])).when(F.col(label) == "D", F.col(p[1])).when(F.col(label) == "A", F.col(p[2]))


def log_loss(p=P, label: str = "y_true", eps: float = 1e-15) -> Column:
    return -F.log(F.least(F.greatest(p_true(p, label), F.lit(eps)), F.lit(1 - eps)))


def _hit(label: str, value: str) -> Column:
    return F.when(F.col(label) == value, 1.0).otherwise(0.0)


def brier(p=P, label: str = "y_true") -> Column:
    terms = [F.pow(F.col(c) - _hit(label, v), F.lit(2)) for c, v in zip(p, LABELS, strict=True)]
    return reduce(lambda x, y: x + y, terms)


def rps(p=P, label: str = "y_true") -> Column:
    """Ranked probability score over the order home, draw, away."""
    first = F.col(p[0]) - _hit(label, "H")
    second = F.col(p[0]) + F.col(p[1]) - _hit(label, "H") - _hit(label, "D")
    return (first * first + second * second) / 2


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 when undefined."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def scorecard(rows: DataFrame, groups: list[str] | None = None, p=P, label: str = "y_true") -> DataFrame:
    """One pass: counts, accuracy, log loss, Brier, RPS, per-class precision, recall and F1, macro-F1, balanced accuracy."""
    picked = rows.withColumn("pick", argmax(*(F.col(c) for c in p)))
    y, k = F.col(label), F.col("pick")
    counts = [F.count_if((y == v) & (k == v)).alias(f"tp_{v}") for v in LABELS]
    counts += [F.count_if(k == v).alias(f"pick_{v}") for v in LABELS] + [F.count_if(y == v).alias(f"true_{v}") for v in LABELS]
    base = picked.groupBy(*(groups or [])).agg(
        F.count("*").alias("n"),
        F.avg((y == k).cast("double")).alias("accuracy"),
        F.avg(log_loss(p, label)).alias("log_loss"),
        F.avg(brier(p, label)).alias("brier"),
        F.avg(rps(p, label)).alias("rps"),
        *counts,
    )
    out = {}
    for v in LABELS:
        out[f"precision_{v}"] = ratio(F.col(f"tp_{v}"), F.col(f"pick_{v}"))
        out[f"recall_{v}"] = ratio(F.col(f"tp_{v}"), F.col(f"true_{v}"))
        out[f"f1_{v}"] = ratio(2 * F.col(f"tp_{v}"), F.col(f"pick_{v}") + F.col(f"true_{v}"))
    full = base.withColumns(out)
    return full.withColumns(
        {
            "macro_f1": (F.col("f1_H") + F.col("f1_D") + F.col("f1_A")) / 3,
            "balanced_accuracy": (F.col("recall_H") + F.col("recall_D") + F.col("recall_A")) / 3,
        }
    ).drop(*(f"tp_{v}" for v in LABELS))


def confusion(rows: DataFrame, p=P, label: str = "y_true") -> DataFrame:
    """Counts by true and picked class, with margins."""
    picked = rows.select(F.col(label).alias("y"), argmax(*(F.col(c) for c in p)).alias("pick"))
    return picked.cube("y", "pick").agg(F.count("*").alias("n")).select(
        F.coalesce("y", F.lit("all")).alias("y"), F.coalesce("pick", F.lit("all")).alias("pick"), "n"
    )


def bin_of(value: Column, bins: int = 10, style: str = "left") -> Column:
    """Bin number against literal edges k / bins.

    left: [lo, hi), the last one closed; open: the same without the last edge, 1.0 falls out;
    right: (lo, hi], 0 falls out.
    """
    edges = [k / bins for k in range(1, bins)]
    over = (lambda e: value > e) if style == "right" else (lambda e: value >= e)
    number = reduce(lambda x, y: x + y, [F.when(over(e), 1).otherwise(0) for e in edges])
    if style == "open":
        return F.when(value < 1, number)
    if style == "right":
        return F.when(value > 0, number)
    return number


def reliability(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10, style: str = "left", groups=()) -> DataFrame:
    """Count, mean confidence, share correct and gap of every bin with rows."""
    return (
        rows.select(*groups, bin_of(confidence, bins, style).alias("bin"), confidence.alias("c"), correct.cast("double").alias("hit"))
        .where("bin is not null")
        .groupBy(*groups, "bin")
        .agg(F.count("*").alias("n"), F.avg("c").alias("mean_p"), F.avg("hit").alias("share"))
        .withColumn("gap", F.abs(F.col("mean_p") - F.col("share")))
    )


def calibration_error(table: DataFrame, groups=()) -> DataFrame:
    """Expected and maximal calibration error of a reliability table."""
    return table.groupBy(*groups).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"), F.sum("n").alias("n"))


def by_class(rows: DataFrame, p=P, label: str = "y_true") -> DataFrame:
    """Three rows for each one: class, its probability and whether it happened."""
    cells = [F.struct(F.lit(v).alias("class"), F.col(c).alias("p"), (F.col(label) == v).alias("hit")) for c, v in zip(p, LABELS, strict=True)]
    return rows.select("*", F.explode(F.array(*cells)).alias("cell")).select("*", "cell.*").drop("cell")


def average_rank(value: Column, *groups: str) -> Column:
    """Rank with ties averaged."""
    w = W.partitionBy(*groups).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(W.partitionBy(*groups, value)) - 1) / 2.0


def auc_by_counts(rows: DataFrame, score: Column, positive: Column, groups: list[str]) -> DataFrame:
    """ROC-AUC per group from distinct scores: counts are combined before ranks are taken."""
    counts = rows.select(*groups, score.alias("s"), positive.cast("long").alias("y")).groupBy(*groups, "s").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    below = W.partitionBy(*groups).orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return ranked.groupBy(*groups).agg(
        (F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )


def effect_size(rows: DataFrame, value: Column, positive: Column, groups: list[str]) -> DataFrame:
    """Cohen's d with pooled sample variance; null under 30 rows on either side."""
    a, b = F.when(positive, value), F.when(~positive, value)
    n1, n2 = F.count(a), F.count(b)
    pooled = ((n1 - 1) * F.var_samp(a) + (n2 - 1) * F.var_samp(b)) / (n1 + n2 - 2)
    return rows.groupBy(*groups).agg(
        F.when((n1 >= 30) & (n2 >= 30) & (pooled > 0), (F.avg(a) - F.avg(b)) / F.sqrt(pooled)).alias("cohens_d"), n1.alias("n1"), n2.alias("n2")
    )


def quantiles(rows: DataFrame, value: Column | str, points: list[float], groups: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(groups, q): exact quantiles of each group at the points, interpolated between neighbouring ranks; nulls don't count.

    Equal values are counted first. Values are dealt out in ranges, so that a task ranks its own range only, and the ranges'
    totals tell where its ranks begin; the two ranks of each point are then looked up in the range that holds them.
    No task sees a whole group, however large. A table without groups gives one row, of nulls where it is empty.
    """
    keys, ranges = list(groups), ["__range", *groups]
    counted = rows.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__v")).where("__v is not null").groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    dealt = stored(counted.repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy(*ranges).agg(F.sum("__n").alias("__held"))
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("__start", F.coalesce(F.sum("__held").over(earlier), F.lit(0)))
    spots = F.array(*(F.struct(F.lit(k).alias("__k"), F.lit(float(q)).alias("__q")) for k, q in enumerate(points)))
    wanted = (
        (totals.groupBy(*keys) if keys else totals.groupBy()).agg((F.sum("__held") - 1).alias("__last")).where("__last is not null")
        .select(*keys, "__last", F.explode(spots).alias("__p")).select(*keys, "__p.*", (F.col("__p.__q") * F.col("__last")).alias("__at"))
        .select(*keys, "__k", "__at", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__rank"))
    )
    inside = (F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__start") + F.col("__held"))
    sought = (wanted.join(starts, keys) if keys else wanted.crossJoin(starts)).where(inside)
    upto = F.sum("__n").over(W.partitionBy(*ranges).orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    ranked = dealt.withColumn("__upto", upto)
    at = F.col("__rank") - F.col("__start")
    found = sought.join(ranked, ranges).where((at >= F.col("__upto") - F.col("__n")) & (at < F.col("__upto")))
    # from the lower rank's value on, so that two equal values give that very value
    low, high, share = F.min("__v"), F.max("__v"), F.first("__at") - F.floor(F.first("__at"))
    values = found.groupBy(*keys, "__k").agg(F.when(low == high, low).otherwise(low + (high - low) * share).alias("__x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__k", "__x"))), lambda x: x["__x"]).alias("q")
    if keys:
        return values.groupBy(*keys).agg(ordered)
    one = values.agg(ordered)
    return one.select(F.when(F.size("q") > 0, F.col("q")).otherwise(F.array(*(F.lit(None).cast("double") for _ in points))).alias("q"))


def quantile_bins(rows: DataFrame, value: str, q: int, groups: list[str]) -> DataFrame:
    """Adds decile-like bins by exact quantile edges of each group; right-closed, duplicate edges merged."""
    edges = quantiles(rows, value, [k / q for k in range(1, q)], groups).select(*groups, F.array_distinct("q").alias("edges"))
    return rows.join(edges, groups).withColumn("bin", F.size(F.filter("edges", lambda e: F.col(value) > e))).drop("edges")


def carried(rows: DataFrame, group: str, bucket: Column, order: list[str], value: Column) -> DataFrame:
    """rows with bucket, value, place (from 1) and upto, the running sum of value, in order within the group.

    Windows run within a bucket, such as a month, and carry on from the sums of the buckets before it, so
    that no task sorts a whole group. The order must not leave that of the buckets.
    """
    keyed = rows.withColumns({"bucket": bucket, "value": value.cast("double")})
    sums = keyed.groupBy(group, "bucket").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    earlier = W.partitionBy(group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(group, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("total").over(earlier), F.lit(0.0)).alias("sum_before"))
    within = W.partitionBy(group, "bucket").orderBy(*order)
    placed = keyed.withColumns({"place": F.row_number().over(within), "upto": F.sum("value").over(within.rowsBetween(W.unboundedPreceding, 0))})
    joined = placed.join(before, [group, "bucket"])
    return joined.withColumns({"place": F.col("place") + F.col("n_before"), "upto": F.col("upto") + F.col("sum_before")}).drop("n_before", "sum_before")


def drawdowns(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """carried rows -> per group: n, won, profit and max_drawdown, the largest fall of the running sum from its peak.

    A fall lies within a bucket, or between the highest peak before the bucket and its lowest point.
    """
    within = W.partitionBy(group, "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    peaks = rows.withColumn("peak", F.max("upto").over(within))
    buckets = peaks.groupBy(group, "bucket").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("won"), F.sum("value").alias("profit"),
        F.max(F.col("peak") - F.col("upto")).alias("own"), F.max("upto").alias("high"), F.min("upto").alias("low"),
    )
    earlier = W.partitionBy(group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    fall = F.greatest("own", F.max("high").over(earlier) - F.col("low"))
    return buckets.withColumn("fall", fall).groupBy(group).agg(F.sum("n").alias("n"), F.sum("won").alias("won"), F.sum("profit").alias("profit"), F.max("fall").alias("max_drawdown"))
