"""Features of a pairing: home advantage, turnaround, expectations and recency terms; statuses of ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from matchweave.operators.history import gated, league_context, owned, per_contest, rolling_features, team_rows, with_position


def home_advantage(contests: DataFrame, least: int = 2) -> DataFrame:
    """Goal difference of the home team at home and of the away team away, with their n, and the league's."""
    values = {name: F.when(F.col("is_home") == here, F.col("goals_for") - F.col("goals_against")) for here, name in ((True, "home"), (False, "away"))}
    rows = with_position(team_rows(contests), reach=1, values=values)
    sides = [(name, name == "home", *gated(name, value, "season", least)) for name, value in values.items()]
    wide = owned(rows, "fixture_id", "is_home", *(c.alias(f"{name}_{k}") for name, _, gd, n in sides for k, c in (("gd", gd), ("n", n))))
    pair = wide.groupBy("fixture_id").agg(
        *(F.max(F.when(F.col("is_home") == here, F.col(f"{name}_{k}"))).alias(f"{name}_{k}") for name, here, _, _ in sides for k in ("gd", "n"))
    )
    league = league_context(contests).select("fixture_id", F.col("league_home_advantage").alias("league_gd"), F.col("league_matches").alias("league_n"))
    return pair.join(league, "fixture_id")


def turnaround(contests: DataFrame, days: float = 4.0) -> DataFrame:
    """Whether the team's last contest lies under so many days back; false without one."""
    order = W.partitionBy("team_id").orderBy("unix", "fixture_id")
    gap = (F.col("unix") - F.lag("unix").over(order)) / 86400.0
    return team_rows(contests).select("fixture_id", "team_id", F.coalesce(gap < days, F.lit(False)).alias("short_turnaround"))


def expectations(contests: DataFrame, prior: float = 1.25, home: float = 1.12, away: float = 0.88, width: float = 0.45) -> DataFrame:
    """Expected xG of both sides from attack and defence over the last ten, their sum, difference and parity.

    A side without enough covered contests counts at the prior, which is the league's mean as well.
    """
    pair = per_contest(rolling_features(contests, stats=("goals", "xg"), windows=("last10",)), ["xg_for_last10", "xg_against_last10"])
    base = {k: F.coalesce(F.col(f"{k}_last10"), F.lit(prior)) for k in ("home_xg_for", "home_xg_against", "away_xg_for", "away_xg_against")}
    return pair.select(
        "fixture_id",
        (base["home_xg_for"] * base["away_xg_against"] / prior * home).alias("home_expected"),
        (base["away_xg_for"] * base["home_xg_against"] / prior * away).alias("away_expected"),
    ).select(
        "*",
        (F.col("home_expected") + F.col("away_expected")).alias("total_expected"),
        (F.col("home_expected") - F.col("away_expected")).alias("gap_expected"),
        F.exp(-F.pow(F.col("home_expected") - F.col("away_expected"), F.lit(2)) / (2 * width**2)).alias("parity"),
    )


def recency_terms(features: DataFrame, families: list[str]) -> DataFrame:
    """season, last10 - season and last5 - last10 of every family; all null unless all three are known."""
    out = []
    for f in families:
        season, ten, five = (F.col(f"{f}_{w}") for w in ("season", "last10", "last5"))
        whole = season.isNotNull() & ten.isNotNull() & five.isNotNull()
        terms = {"level": season, "medium": ten - season, "recent": five - ten}
        out += [F.when(whole, c).alias(f"{f}_{name}") for name, c in terms.items()]
    return features.select("fixture_id", "team_id", *out)


def row_status(status: Column, goals: Column, kickoff: Column, as_of: Column | int) -> Column:
    """ft, upcoming, postponed or error of a ledger row joined to its result."""
    return (
        F.when(status.isin("FT", "AWARDED") & goals.isNotNull(), "ft")
        .when(status.isin("POSTP", "ABANDONED", "CANC", "SUSP"), "postponed")
        .when((status == "NS") & (kickoff > as_of), "upcoming")
        .otherwise("error")
    )


def selected_model(summary: DataFrame, groups: list[str], margin: float = 0.005) -> DataFrame:
    """summary(groups, model, log_loss, brier) -> the model of least log loss, or of least Brier score where
    the two best lie within the margin."""
    order = W.partitionBy(*groups).orderBy("log_loss", "model")
    ranked = summary.withColumn("place", F.row_number().over(order))
    best = ranked.groupBy(*groups).agg(
        F.min_by("model", "place").alias("by_loss"),
        F.min_by("model", F.struct("brier", "model")).alias("by_brier"),
        (F.max(F.when(F.col("place") == 2, F.col("log_loss"))) - F.min("log_loss")).alias("lead"),
    )
    tie = F.coalesce(F.col("lead") <= margin, F.lit(False))
    return best.select(*groups, F.when(tie, F.col("by_brier")).otherwise(F.col("by_loss")).alias("selected"), tie.alias("tie_break"), "lead")
