"""Feature tables of what is known before kickoff, for models of risk, reliability, status and regime."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.functions.probability import entropy, js_divergence
from matchweave.operators import history

P = ("p_home", "p_draw", "p_away")
Q = ("q_home", "q_draw", "q_away")
_SHARED = ["total_lam", "lambda_ratio", "abs_elo_diff", "season_match_num", "min_team_samples", "is_promoted_sparse", "is_early_3", "is_early_5"]
_MODEL = ["p_home", "p_draw", "p_away", "entropy", "max_prob", "margin_p1_p2", "js_divergence", "mean_abs_prob_diff", "home_elo", "away_elo"]
#: Columns of each family; forecast status is learnt from the reliability columns.
FAMILIES = {
    "risk": [*_SHARED, *_MODEL],
    "reliability": [*_SHARED, *_MODEL, "min_prob", "prob_spread", "norm_entropy", "prob_concentration", "signed_elo_diff", "elo_parity_tight", "elo_parity_wide"],
    "regime": [
        "season_match_num", "min_team_samples", "is_promoted_sparse", "is_developing", "is_established", "abs_elo_diff", "parity_tight", "parity_close", "parity_moderate", "parity_wide",
        "total_lam", "env_low_goals", "env_med_goals", "env_high_goals", "is_early_3", "is_early_5", "is_early_10", "is_late_season",
    ],
}


def maturity(contests: DataFrame) -> DataFrame:
    """(fixture_id, season_match_num, min_team_samples): the kickoff's place in its season, and how many contests the
    less seasoned of both teams had played before."""
    fewest = history.sample_size(contests).groupBy("fixture_id").agg(F.min("seen").alias("min_team_samples"))
    return history.dense_round(contests).join(fewest, "fixture_id")


def clipped(p: list[Column], eps: float = 1e-12) -> list[Column]:
    """Probabilities kept within [eps, 1] and scaled to sum to one."""
    kept = [F.least(F.greatest(x, F.lit(eps)), F.lit(1.0)) for x in p]
    total = sum(kept[1:], kept[0])
    return [x / total for x in kept]


def within(value: Column, low: float | None, high: float | None) -> Column:
    """1 where low < value <= high, else 0; None leaves a side open."""
    holds = F.lit(True)
    if low is not None:
        holds = holds & (value > low)
    if high is not None:
        holds = holds & (value <= high)
    return F.coalesce(holds.cast("int"), F.lit(0))


def with_maturity(rows: DataFrame, contests: DataFrame) -> DataFrame:
    """rows with season_match_num and min_team_samples; a contest that the history lacks counts as the season's tenth
    kickoff, between teams never seen."""
    found = rows.join(maturity(contests), "fixture_id", "left")
    return found.withColumns(
        {"season_match_num": F.coalesce("season_match_num", F.lit(10)), "min_team_samples": F.coalesce("min_team_samples", F.lit(0).cast("long"))}
    )


def features(rows: DataFrame, contests: DataFrame, family: str, p=P, q=Q, advantage: float = 100.0) -> DataFrame:
    """fixture_id and the columns of one family, nothing of them known only after kickoff.

    rows needs fixture_id, home_elo, away_elo, lambda_home, lambda_away and the probabilities of two models; contests is
    the whole history. Geometry and disagreement read clipped, renormalised probabilities. The advantage is added to the
    home side's rating, but for regimes, whose parity tiers take the ratings as they are. Null ratings or rates give null
    measures and flags of 0.
    """
    base = with_maturity(rows, contests)
    low, high = F.least("lambda_home", "lambda_away"), F.greatest("lambda_home", "lambda_away")
    edge = 0.0 if family == "regime" else advantage
    base = base.withColumns(
        {
            **{f"__p{k}": x for k, x in enumerate(clipped([F.col(c) for c in p]))},
            **{f"__q{k}": x for k, x in enumerate(clipped([F.col(c) for c in q]))},
            "total_lam": F.col("lambda_home") + F.col("lambda_away"),
            "lambda_ratio": high / F.greatest(low, F.lit(0.1)),
            "signed_elo_diff": F.col("home_elo") + edge - F.col("away_elo"),
        }
    )
    ps, qs = ([F.col(f"__{side}{k}") for k in range(3)] for side in "pq")
    gap, number, seen, goals = F.abs("signed_elo_diff"), F.col("season_match_num"), F.col("min_team_samples"), F.col("total_lam")
    ranked = F.array_sort(F.array(*ps))
    least, second, most = (F.get(ranked, F.lit(k)) for k in range(3))
    spread = [F.abs(x - y) for x, y in zip(ps, qs, strict=True)]
    measures = {
        "p_home": ps[0], "p_draw": ps[1], "p_away": ps[2], "entropy": entropy(*ps), "norm_entropy": entropy(*ps) / log(3),
        "max_prob": most, "min_prob": least, "margin_p1_p2": most - second, "prob_spread": most - least,
        "prob_concentration": ps[0] * ps[0] + ps[1] * ps[1] + ps[2] * ps[2],
        "js_divergence": js_divergence(ps, qs), "mean_abs_prob_diff": (spread[0] + spread[1] + spread[2]) / 3,
        "abs_elo_diff": gap, "elo_parity_tight": within(gap, None, 25), "elo_parity_wide": within(gap, 100, None),
        "parity_tight": within(gap, None, 25), "parity_close": within(gap, 25, 50), "parity_moderate": within(gap, 50, 100), "parity_wide": within(gap, 100, None),
        "is_promoted_sparse": within(seen, None, 4), "is_developing": within(seen, 4, 10), "is_established": within(seen, 10, None),
        "env_low_goals": F.coalesce((goals < 2.4).cast("int"), F.lit(0)), "env_med_goals": F.coalesce(((goals >= 2.4) & (goals <= 3.0)).cast("int"), F.lit(0)), "env_high_goals": within(goals, 3.0, None),
        "is_early_3": within(number, None, 3), "is_early_5": within(number, 3, 5), "is_early_10": within(number, 5, 10), "is_late_season": within(number, 10, None),
    }
    return base.select("fixture_id", *(measures.get(c, F.col(c)).alias(c) for c in FAMILIES[family]))
