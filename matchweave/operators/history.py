"""Leakage-safe history of each team: perspective rows, rolling windows and context features.

The visible history of a contest is what kicked off before it. With ties='row' an earlier id at the
same kickoff is visible; with ties='strict' it is not. Only played contests count as history, but
every contest gets its features.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchweave.sources.storage import stored

PLAYED = ("FT", "AWARDED")
STATS = ("goals", "xg", "shots", "shots_on")
#: Observations that a mean needs, by window.
MINIMUM = {"last5": 3, "last10": 5, "season": 2}


def result(home: Column, away: Column) -> Column:
    """H, D or A from goals; null when either is missing."""
    return F.when(home > away, "H").when(home < away, "A").when(home == away, "D")


def team_rows(contests: DataFrame, stats=STATS) -> DataFrame:
    """Each contest once from either side: <stat>_for, <stat>_against, is_home, outcome, points."""
    keys = ["fixture_id", "unix", "competition_id", "season_id", "status"]

    def side(own: str, other: str) -> DataFrame:
        gf, ga = F.col(f"{own}_goals"), F.col(f"{other}_goals")
        return contests.select(
            *keys,
            F.col(f"{own}_id").alias("team_id"),
            F.col(f"{other}_id").alias("opponent_id"),
            F.lit(own == "home").alias("is_home"),
            *(F.col(f"{own}_{s}").alias(f"{s}_for") for s in stats),
            *(F.col(f"{other}_{s}").alias(f"{s}_against") for s in stats),
            F.when(gf > ga, "W").when(gf < ga, "L").when(gf == ga, "D").alias("outcome"),
        )

    rows = side("home", "away").unionByName(side("away", "home"))
    return rows.withColumns(
        {
            "played": F.coalesce(F.col("status").isin(*PLAYED), F.lit(False)),
            "points": F.when(F.col("outcome") == "W", 3).when(F.col("outcome") == "D", 1).when(F.col("outcome") == "L", 0),
        }
    )


#: Rows of a team that one window partition holds, but for a day's overhang and the context before it.
BLOCK = 3000
#: Rows that a task's windows hold.
TASK = 200_000


def matched(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of a table of unique keys; nulls are equal."""
    named = table.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(named, same, how).drop(*(f"__{k}" for k in keys))


def in_blocks(rows: DataFrame, reach: list[tuple[Column, int]], totals: dict[str, Column] | None = None, size: int | None = None) -> DataFrame:
    """rows with `block` and `own`: each team's time line in blocks of about size rows, so that no task sorts a whole one.

    Before a block's own rows stand those of earlier days that its windows see: for each (condition, n) of reach the
    last n rows that meet it, rounded up to days; `base` counts the rows of the first condition before them. Windows by
    (team_id, block) in time order are those by team_id; keep the rows where `own` holds afterwards. `totals` are
    conditions or values whose sums over the earlier blocks of the season are added as <name>_before. Days are
    counted first, so that tables of blocks stay small beside the rows.
    """
    totals, size = totals or {}, size or BLOCK
    keyed = rows.withColumn("day", F.floor(F.col("unix") / 86400))
    counts = [F.count_if(c).alias(f"n{k}") for k, (c, _) in enumerate(reach)]
    seasons = stored(keyed.groupBy("team_id", "season_id", "day").agg(F.count("*").alias("n"), *counts, *(F.sum(v).alias(f"{name}_before") for name, v in totals.items())))
    in_time = W.partitionBy("team_id").orderBy("day")
    upto = in_time.rowsBetween(W.unboundedPreceding, 0)
    days = seasons.groupBy("team_id", "day").agg(F.sum("n").alias("n"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(reach))))
    ends = {f"end{k}": F.sum(f"n{k}").over(upto) for k in range(len(reach))}
    days = days.withColumns({"block": F.floor((F.sum("n").over(upto) - F.col("n")) / size), "before": F.sum("n0").over(upto) - F.col("n0"), **ends})
    entry = F.struct("day", "before")
    # the days that hold the last n rows up to the end of a day
    held = [
        F.collect_list(F.when(F.col(f"n{k}") > 0, entry)).over(W.partitionBy("team_id").orderBy(f"end{k}").rangeBetween(1 - n, 0)) for k, (_, n) in enumerate(reach)
    ]
    days = days.withColumn("held", F.array_distinct(F.concat(*held)))
    opening = F.row_number().over(W.partitionBy("team_id", "block").orderBy("day")) == 1
    context = F.coalesce(F.lag("held").over(in_time), F.array().cast(days.schema["held"].dataType))
    days = stored(days.withColumns({"context": context, "opening": opening}).drop("held"))
    base = F.least(F.col("before"), F.array_min(F.transform("context", lambda c: c["before"])))
    blocks = stored(days.where("opening").select("team_id", "block", base.alias("base"), "context"))
    own = days.select("team_id", "day", "block", F.lit(True).alias("own"))
    lent = blocks.select("team_id", F.explode(F.col("context")["day"]).alias("day"), "block", F.lit(False).alias("own"))
    places = stored(matched(own.unionByName(lent), blocks.drop("context"), ["team_id", "block"]))
    sought = reduce(lambda x, y: x | y, (F.coalesce(c, F.lit(False)) for c, _ in reach))
    found = matched(keyed, places, ["team_id", "day"]).where(F.col("own") | sought)
    # as many tasks as the counted rows ask for, so that a task's share stays the same however many there are
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, (days.agg(F.sum("n")).first()[0] or 0) // TASK)
    found = found.repartition(tasks, "team_id", "block")
    if not totals:
        return found.drop("day")
    carried = matched(seasons, own, ["team_id", "day"]).groupBy("team_id", "season_id", "block").agg(*(F.sum(f"{name}_before").alias(f"{name}_before") for name in totals))
    earlier = W.partitionBy("team_id", "season_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = stored(carried.select("team_id", "season_id", "block", *(F.coalesce(F.sum(f"{name}_before").over(earlier), F.lit(0)).alias(f"{name}_before") for name in totals)))
    return matched(found, sums, ["team_id", "season_id", "block"], "left").drop("day")


def with_position(rows: DataFrame, ties: str = "row", reach: int = 10, values: dict[str, Column] | None = None) -> DataFrame:
    """Adds seen: how many played contests of the team are visible to the row.

    The last n of them are the rows whose own place lies in the n before, whatever their status in
    between, so that windows over `seen` by range are exact for unplayed targets too. Rows come in blocks: those where
    `own` is false only stand before others' windows of up to `reach` contests. Of `values` the season's sums and
    counts before the block come along, for `season_sum` and `season_count`.
    """
    totals = {}
    for name, value in (values or {}).items():
        own = F.when(F.col("played"), value)
        totals |= {f"{name}_sum": own.cast("double"), f"{name}_count": F.when(own.isNotNull(), 1).otherwise(0)}
    base = W.partitionBy("team_id", "block").orderBy("unix", "fixture_id").rowsBetween(W.unboundedPreceding, -1)
    if ties == "strict":
        base = W.partitionBy("team_id", "block").orderBy("unix").rangeBetween(W.unboundedPreceding, -1)
    placed = in_blocks(rows, [(F.col("played"), reach)], totals)
    return placed.withColumn("seen", F.col("base") + F.coalesce(F.sum(F.col("played").cast("long")).over(base), F.lit(0))).drop("base")


def visible(window: str):
    """The frame of a named window within a block: last<n> over all seasons, or the season so far."""
    if window == "season":
        return W.partitionBy("team_id", "block", "season_id").orderBy("unix", "fixture_id").rowsBetween(W.unboundedPreceding, -1)
    return W.partitionBy("team_id", "block").orderBy("seen").rangeBetween(-int(window[4:]), -1)


def season_sum(name: str, value: Column) -> Column:
    """Sum of a value of with_position over the season so far."""
    own = F.when(F.col("own") & F.col("played"), value)
    return F.coalesce(F.sum(own.cast("double")).over(visible("season")), F.lit(0.0)) + F.coalesce(f"{name}_sum_before", F.lit(0.0))


def season_count(name: str, value: Column) -> Column:
    """How many of a value of with_position the season has had so far."""
    own = F.when(F.col("own") & F.col("played"), value)
    return F.count(own).over(visible("season")) + F.coalesce(f"{name}_count_before", F.lit(0).cast("long"))


def gated(name: str, value: Column, window: str, minimum: int | None = None) -> tuple[Column, Column]:
    """(mean, coverage) of a value of with_position over a window: null mean under the minimum coverage."""
    frame, own = visible(window), F.when(F.col("played"), value)
    least = MINIMUM[window] if minimum is None else minimum
    if window == "season":
        n = season_count(name, value)
        return F.when(n >= least, season_sum(name, value) / n), n
    coverage = F.count(own).over(frame)
    return F.when(coverage >= least, F.avg(own).over(frame)), coverage


def seen_in(window: str) -> Column:
    """How many played contests a window holds; with_position must carry `played` for the season."""
    if window == "season":
        return season_count("played", F.lit(1))
    return F.coalesce(F.sum(F.col("played").cast("long")).over(visible(window)), F.lit(0))


def owned(rows: DataFrame, *columns) -> DataFrame:
    """Columns over the windows of rows in blocks, without the rows that only stand before others."""
    return rows.select("own", *columns).where("own").drop("own")


def rolling_features(contests: DataFrame, stats=STATS, windows=tuple(MINIMUM), extra: dict | None = None) -> DataFrame:
    """Gated means of every statistic, for and against, over every window; one row per team and contest.

    `extra` adds columns to every family: name -> Column over the team rows.
    """
    values = {f"{s}_{d}": F.col(f"{s}_{d}") for s in stats for d in ("for", "against")} | {"points": F.col("points")} | (extra or {})
    carried = values | {"played": F.lit(1)} if "season" in windows else None
    rows = with_position(team_rows(contests, stats), reach=max([int(w[4:]) for w in windows if w != "season"], default=1), values=carried)
    new = {}
    for w in windows:
        for name, value in values.items():
            new[f"{name}_{w}"], new[f"{name}_{w}_coverage"] = gated(name, value, w)
        new[f"n_{w}"] = seen_in(w)
    return owned(rows, "fixture_id", "team_id", "is_home", "seen", *(c.alias(k) for k, c in new.items()))


def per_contest(features: DataFrame, columns: list[str]) -> DataFrame:
    """Home and away rows side by side, with their difference, by one grouped pivot."""
    picks = [
        F.max(F.when(F.col("is_home") == side, F.col(c))).alias(f"{name}_{c}")
        for side, name in ((True, "home"), (False, "away"))
        for c in columns
    ]
    wide = features.groupBy("fixture_id").agg(*picks)
    return wide.select("*", *((F.col(f"home_{c}") - F.col(f"away_{c}")).alias(f"diff_{c}") for c in columns))


def form(contests: DataFrame, windows=("last5", "last10")) -> DataFrame:
    """Points, win, draw and loss rate, goal and xG difference over the last matches."""
    rows = with_position(team_rows(contests), reach=max(int(w[4:]) for w in windows))
    values = {
        "points": F.col("points"),
        "win_rate": (F.col("outcome") == "W").cast("double"),
        "draw_rate": (F.col("outcome") == "D").cast("double"),
        "loss_rate": (F.col("outcome") == "L").cast("double"),
        "goal_diff": F.col("goals_for") - F.col("goals_against"),
        "xg_diff": F.col("xg_for") - F.col("xg_against"),
    }
    return owned(rows, "fixture_id", "team_id", *(gated(k, v, w)[0].alias(f"{k}_{w}") for w in windows for k, v in values.items()))


def venue(contests: DataFrame) -> DataFrame:
    """Season means at home only and away only, at least two of them."""
    gap = F.col("goals_for") - F.col("goals_against")
    values = {
        f"{name}_{side}": F.when(F.col("is_home") == home, value) for side, home in (("home", True), ("away", False)) for name, value in (("goals", F.col("goals_for")), ("gd", gap))
    }
    rows = with_position(team_rows(contests), reach=1, values=values)
    means = {f"{name}_season": gated(name, values[name], "season")[0] for name in ("goals_home", "goals_away", "gd_home", "gd_away")}
    return owned(rows, "fixture_id", "team_id", *(c.alias(k) for k, c in means.items()))


def league_context(contests: DataFrame, ties: str = "row") -> DataFrame:
    """Mean goals per team and home advantage of the competition's season before each contest."""
    order = W.partitionBy("competition_id", "season_id")
    frame = (
        order.orderBy("unix").rangeBetween(W.unboundedPreceding, -1)
        if ties == "strict"
        else order.orderBy("unix", "fixture_id").rowsBetween(W.unboundedPreceding, -1)
    )
    counted = F.col("status").isin(*PLAYED) & F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()
    goals, gap = F.when(counted, F.col("home_goals") + F.col("away_goals")), F.when(counted, F.col("home_goals") - F.col("away_goals"))
    return contests.select(
        "fixture_id",
        F.count(goals).over(frame).alias("league_matches"),
        (F.avg(goals).over(frame) / 2).alias("league_mean"),
        F.avg(gap).over(frame).alias("league_home_advantage"),
    )


def sample_size(contests: DataFrame, least: int = 3) -> DataFrame:
    """Contests seen before, and whether they are too few."""
    return owned(with_position(team_rows(contests), reach=1), "fixture_id", "team_id", "seen", (F.col("seen") < least).alias("insufficient_history"))


def strength(contests: DataFrame, k: float = 5.0) -> DataFrame:
    """Season scoring rate shrunk to the league mean: (sum + k * mean) / (n + k).

    Without a league mean: null without team rows, else shrunk to zero.
    """
    rows = with_position(team_rows(contests), reach=1, values={"played": F.lit(1), "goals": F.col("goals_for")})
    n, total = seen_in("season"), season_sum("goals", F.col("goals_for"))
    found = owned(rows, "fixture_id", "team_id", "is_home", n.alias("n"), total.alias("total"))
    joined = found.join(league_context(contests).select("fixture_id", "league_mean"), "fixture_id")
    rate = F.when(F.col("league_mean").isNull() & (F.col("n") == 0), None).otherwise(
        (F.col("total") + k * F.coalesce("league_mean", F.lit(0.0))) / (F.col("n") + k)
    )
    return per_contest(joined.withColumn("strength", rate), ["strength"])


def dense_round(contests: DataFrame) -> DataFrame:
    """The kickoff's dense rank within the season."""
    return contests.select(
        "fixture_id", F.dense_rank().over(W.partitionBy("competition_id", "season_id").orderBy("unix")).alias("season_match_num")
    )


def padded_mean(contests: DataFrame, n: int = 5, prior: float = 1.25) -> DataFrame:
    """Mean xG of the last n contests, missing ones filled with the prior."""
    frame = W.partitionBy("team_id").orderBy("unix", "fixture_id").rowsBetween(-n, -1)
    xg = F.coalesce(F.col("xg_for"), F.lit(prior))
    return team_rows(contests).select(
        "fixture_id", "team_id", ((F.coalesce(F.sum(xg).over(frame), F.lit(0.0)) + (n - F.count(xg).over(frame)) * prior) / n).alias("xg_padded")
    )


def newest(value: Column, n: int, order) -> Column:
    """The last n values before a row, oldest first."""
    return F.collect_list(value).over(order.rowsBetween(-n, -1))


def ewma(past: Column, half_life: float, n: int, prior: float) -> Column:
    """Exponentially weighted mean by match index of the n newest of `past`, which holds the oldest first.

    past is to be a column of its own, as its elements are read one by one, without lambdas.
    """
    decay = 0.6931471805599453 / half_life
    weights = [math.exp(-decay * i) for i in range(n)]
    size = F.size(past)
    top = reduce(lambda x, y: x + y, (F.coalesce(F.when(size > i, F.get(past, size - 1 - i)), F.lit(0.0)) * w for i, w in enumerate(weights)))
    bottom = F.get(F.array(*map(F.lit, accumulate(weights))), F.least(size, F.lit(n)) - 1)
    return F.when(size > 0, top / bottom).otherwise(F.lit(prior))


def trends(contests: DataFrame) -> DataFrame:
    """Short and long weighted means of xG, their difference, and the finishing residual."""
    rows = team_rows(contests).withColumns({"x": F.coalesce("xg_for", F.lit(1.25)), "g": F.coalesce(F.col("goals_for").cast("double"), F.lit(0.0))})
    home = F.col("is_home")
    rows = in_blocks(rows.select("fixture_id", "team_id", "season_id", "unix", "is_home", "x", "g"), [(F.lit(True), 20), (home, 10), (~home, 10)])
    order = W.partitionBy("team_id", "block").orderBy("unix", "fixture_id")
    there = W.partitionBy("team_id", "block", "is_home").orderBy("unix", "fixture_id")
    x, luck, venue = newest(F.col("x"), 20, order), newest(F.col("g") - F.col("x"), 10, order), newest(F.col("x"), 10, there)
    past = owned(rows, "fixture_id", "team_id", x.alias("x"), luck.alias("luck"), venue.alias("venue"))
    return past.select(
        "fixture_id", "team_id", ewma(F.col("x"), 3, 5, 1.25).alias("xg_short"), ewma(F.col("x"), 10, 20, 1.25).alias("xg_long"),
        ewma(F.col("luck"), 5, 10, 0.0).alias("finishing"), ewma(F.col("venue"), 5, 10, 1.25).alias("xg_venue"),
    ).withColumn("momentum", F.col("xg_short") - F.col("xg_long"))


def matchup_trends(contests: DataFrame) -> DataFrame:
    """Per contest, home less away: finishing, defensive and net residuals, and momentum of xG for less against.

    Residuals are weighted means of goals less xG, for and against, over the last ten; a trend is the short
    weighted mean less the long one. Missing goals count 0, missing xG 1.25, as in trends.
    """
    fill = lambda c, v: F.coalesce(F.col(c).cast("double"), F.lit(v))
    rows = team_rows(contests).withColumns({"x": fill("xg_for", 1.25), "y": fill("xg_against", 1.25), "g": fill("goals_for", 0.0), "h": fill("goals_against", 0.0)})
    rows = in_blocks(rows.select("fixture_id", "team_id", "season_id", "unix", "is_home", *"xygh"), [(F.lit(True), 20)])
    order = W.partitionBy("team_id", "block").orderBy("unix", "fixture_id")
    series = {"f": newest(F.col("g") - F.col("x"), 10, order), "d": newest(F.col("h") - F.col("y"), 10, order), "x": newest(F.col("x"), 20, order), "y": newest(F.col("y"), 20, order)}
    past = owned(rows, "fixture_id", "is_home", *(c.alias(k) for k, c in series.items()))
    trend, against = (ewma(F.col(c), 3, 5, 1.25) - ewma(F.col(c), 10, 20, 1.25) for c in "xy")
    values = past.select("fixture_id", "is_home", ewma(F.col("f"), 5, 10, 0.0).alias("finishing"), ewma(F.col("d"), 5, 10, 0.0).alias("defensive"), (trend - against).alias("momentum"))
    values = values.withColumn("net_luck", F.col("finishing") - F.col("defensive"))
    side = lambda c, here: F.max(F.when(F.col("is_home") == here, F.col(c)))
    return values.groupBy("fixture_id").agg(*((side(c, True) - side(c, False)).alias(f"{c}_gap") for c in ("finishing", "defensive", "net_luck", "momentum")))


def rest(contests: DataFrame) -> DataFrame:
    """Days since the team's last contest in [2, 21] (14 without one), and contests in the last 7 and 14 days."""
    rows = team_rows(contests)
    order = W.partitionBy("team_id").orderBy("unix", "fixture_id")
    days = (F.col("unix") - F.lag("unix").over(order)) / 86400.0
    by_time = W.partitionBy("team_id").orderBy("unix")
    return rows.select(
        "fixture_id",
        "team_id",
        F.coalesce(F.least(F.greatest(days, F.lit(2.0)), F.lit(21.0)), F.lit(14.0)).alias("rest_days"),
        F.count("*").over(by_time.rangeBetween(-7 * 86400, -1)).alias("matches_7d"),
        F.count("*").over(by_time.rangeBetween(-14 * 86400, -1)).alias("matches_14d"),
    )


def recent_league_mean(contests: DataFrame, last: int = 200, floor: float = 0.5) -> DataFrame:
    """Mean goals of the competition's last contests, not under a floor.

    Contests are summed by month and the months' sums carried on, so that each contest knows its place and the sums
    before it; the contest `last` places back tells what to take off again. No task sorts a competition.
    """
    goals, group = F.col("home_goals") + F.col("away_goals"), "competition_id"
    rows = contests.select("fixture_id", group, "unix", goals.cast("long").alias("goals"), F.date_format(F.timestamp_seconds("unix"), "yyyy-MM").alias("month"))
    months = rows.groupBy(group, "month").agg(F.count("*").alias("n"), F.sum("goals").alias("total"), F.count("goals").alias("known"))
    earlier = W.partitionBy(group).orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    before = months.select(group, "month", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "total", "known")))
    inside = W.partitionBy(group, "month").orderBy("unix", "fixture_id")
    past = inside.rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(before, [group, "month"]).select(
        "fixture_id", group, (F.col("n_before") + F.row_number().over(inside)).alias("place"),
        (F.col("total_before") + F.coalesce(F.sum("goals").over(past), F.lit(0))).alias("total"), (F.col("known_before") + F.count("goals").over(past)).alias("known"),
    )
    back = placed.select(F.col(group).alias("of"), (F.col("place") + last).alias("at"), F.col("total").alias("total_back"), F.col("known").alias("known_back"))
    found = placed.join(back, (F.col(group) == F.col("of")) & (F.col("place") == F.col("at")), "left")
    total, known = (F.col(c) - F.coalesce(f"{c}_back", F.lit(0)) for c in ("total", "known"))
    mean = F.when(known > 0, total / known)
    return found.select("fixture_id", F.greatest(F.coalesce(mean, F.lit(floor)), F.lit(floor)).alias("league_recent"))


def tie_leakage(contests: DataFrame) -> DataFrame:
    """How far contests at the same kickoff leak into the league mean: row order against strict order."""
    row, strict = league_context(contests), league_context(contests, "strict")
    both = row.select("fixture_id", "league_matches", F.col("league_mean").alias("m_row")).join(
        strict.select("fixture_id", F.col("league_matches").alias("n_strict"), F.col("league_mean").alias("m_strict")), "fixture_id"
    )
    gap = F.abs(F.col("m_row") - F.col("m_strict"))
    return both.agg(
        F.count("*").alias("contests"),
        F.count_if(F.col("league_matches") != F.col("n_strict")).alias("affected"),
        F.avg(gap).alias("mean_gap"),
        F.max(gap).alias("max_gap"),
    )
