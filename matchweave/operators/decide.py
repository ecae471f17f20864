"""Row-wise decision rules over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchweave.functions.probability import argmax, entropy, margin, sigmoid

P = ("p_home", "p_draw", "p_away")


def best(p=P) -> Column:
    return argmax(*(F.col(c) for c in p))


def policies(p=P, threshold: float = 0.3, gap: float = 0.05, gain: float = 1.3) -> dict[str, Column]:
    """argmax, draw above a threshold, draw close to the winner, and draw by weighted utility."""
    h, d, a = (F.col(c) for c in p)
    top = best(p)
    return {
        "argmax": top,
        "threshold": F.when(d >= threshold, "D").otherwise(top),
        "margin": F.when(F.greatest(h, a) - d <= gap, "D").otherwise(top),
        "utility": F.when((gain * d > h) & (gain * d > a), "D").otherwise(top),
    }


def confidence_tier(p=P) -> Column:
    top = F.greatest(*(F.col(c) for c in p))
    return F.when(top >= 0.5, "HIGH").when(top >= 0.35, "MEDIUM").otherwise("LOW")


def override_gate(draw: float = 0.26, gap: float = 0.12, winner: float = 0.45, rating: float = 120.0, goals: float = 3.2) -> Column:
    """Whether every condition for overriding to a draw holds."""
    h, d, a = (F.col(c) for c in P)
    return (
        (d >= draw) & (F.greatest(h, a) - d <= gap) & (F.greatest(h, a) <= winner) & (F.abs(F.col("elo_diff")) <= rating) & (F.col("lambda_home") + F.col("lambda_away") <= goals)
    )


def linear_decision(weights: dict[str, float], bias: float, threshold: float) -> tuple[Column, Column]:
    """Sigmoid of a weighted sum, and whether it reaches the threshold."""
    terms = [F.col(c) * w for c, w in weights.items()]
    score = sigmoid(sum(terms[1:], terms[0]) + bias)
    return score, score >= threshold


def draw_risk() -> dict[str, Column]:
    """A composite draw-risk score in [0, 100], its tier, and the reasons."""
    h, d, a = (F.col(c) for c in P)
    close, even, low = F.abs(h - a) <= 0.1, F.abs(F.col("elo_diff")) <= 50, F.col("lambda_home") + F.col("lambda_away") <= 2.5
    score = F.least(F.lit(100.0), 100 * d + 15 * close.cast("int") + 10 * even.cast("int") + 10 * low.cast("int"))
    tier = F.when(score >= 60, "VERY_HIGH").when(score >= 45, "HIGH").when(score >= 30, "MODERATE").otherwise("LOW")
    reasons = F.array_join(F.array_compact(F.array(F.when(close, "close"), F.when(even, "even"), F.when(low, "low_scoring"))), ",")
    return {"risk": score, "tier": tier, "reasons": reasons}


def advisory() -> Column:
    """STRONG, LEAN or AVOID from entropy and margin."""
    p = [F.col(c) for c in P]
    return F.when((entropy(*p) < 0.95) & (margin(*p) > 0.2), "STRONG").when(margin(*p) > 0.08, "LEAN").otherwise("AVOID")
