"""Column functions over outcome probabilities, goal rates and odds."""

from __future__ import annotations

from functools import reduce
from math import lgamma

import numpy as np
import pandas as pd
from numpy.polynomial.hermite import hermgauss
from pyspark.sql import Column
from pyspark.sql import functions as F

THIRD = 1.0 / 3.0


def normalized(*p: Column) -> list[Column]:
    """Clipped at zero and divided by their sum; all zero: equal shares."""
    clipped = [F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)) for x in p]
    total = sum(clipped[1:], clipped[0])
    return [F.when(total == 0, F.lit(1.0 / len(p))).otherwise(x / total) for x in clipped]


def argmax(h: Column, d: Column, a: Column, ties: str = "HDA") -> Column:
    """The likeliest outcome; the first in the order of `ties` wins among equals."""
    p = dict(zip("HDA", (h, d, a), strict=True))
    top = F.greatest(h, d, a)
    expr = F.when(p[ties[0]] == top, ties[0])
    for o in ties[1:]:
        expr = expr.when(p[o] == top, o)
    return expr


def logit(p: Column, clip: float = 1e-12) -> Column:
    x = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(x / (1 - x))


def sigmoid(z: Column, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-bound)), F.lit(bound))))


def softmax(*z: Column) -> list[Column]:
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def temperature(p: list[Column], t: Column | float, eps: float = 1e-15) -> list[Column]:
    """softmax(ln p / T): a higher temperature flattens."""
    return softmax(*(F.log(F.greatest(x, F.lit(eps))) / t for x in p))


def blend(p: list[Column], q: list[Column], w: Column | float) -> list[Column]:
    """Log-linear blend, renormalised."""
    w = w if isinstance(w, Column) else F.lit(w)
    raw = [F.exp(w * F.log(x) + (1 - w) * F.log(y)) for x, y in zip(p, q, strict=True)]
    total = sum(raw[1:], raw[0])
    return [x / total for x in raw]


def log_factorials(k: int) -> Column:
    return F.array(*(F.lit(lgamma(i + 1.0)) for i in range(k + 1)))


def poisson_pmf(rate: Column, k: int) -> Column:
    """P(0), ..., P(k) as an array, in log space."""
    lf = log_factorials(k)
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.exp(i * F.log(rate) - rate - F.get(lf, i)))


def likeliest_scores(home: Column, away: Column, k: int, n: int) -> Column:
    """The n likeliest scores of 0..k goals a side as an array of structs place, score, p; of equal ones, to nine digits,
    those with fewer goals.

    home and away are columns of the sides' P(0), ..., P(k), to be selected under names before. A cell is one long, its
    probability in units of 1e-9 before its place in the grid, so that longs are sorted.
    """
    cells = (k + 1) ** 2
    keys = [
        F.coalesce(-F.floor(F.get(home, F.lit(i)) * F.get(away, F.lit(j)) * 1e9 + 0.5) * cells, F.lit(0).cast("long")) + (i * (k + 1) + j) for i in range(k + 1) for j in range(k + 1)
    ]
    known = F.get(home, F.lit(0)).isNotNull() & F.get(away, F.lit(0)).isNotNull()

    def told(key: Column, place: Column) -> Column:
        at = F.pmod(key, F.lit(cells))
        text = F.concat_ws("-", F.floor(at / (k + 1)).cast("string"), (at % (k + 1)).cast("string"))
        return F.struct((place + 1).alias("place"), text.alias("score"), F.when(known, (at - key) / cells / 1e9).alias("p"))

    return F.transform(F.slice(F.sort_array(F.array(*keys)), 1, n), told)


def pmf_values(rate: Column, k: int) -> Column:
    """poisson_pmf for a small k, its terms written out."""
    return F.array(*(F.exp(i * F.log(rate) - rate - lgamma(i + 1)) for i in range(k + 1)))


def score_sums(home: Column, away: Column, k: int) -> Column:
    """struct(win, draw, loss): the mass of 0..k goals a side in which home leads, nobody, or away.

    One pass over the goal counts carries both pmfs and their running sums. Select it once under a
    name before its fields are read, as every mention of a lambda expression is worked out anew.
    """
    zero = F.lit(0.0)
    start = F.struct(
        home.cast("double").alias("x"), away.cast("double").alias("y"), F.exp(-home).alias("p"), F.exp(-away).alias("q"),
        zero.alias("below_p"), zero.alias("below_q"), zero.alias("win"), zero.alias("draw"), zero.alias("loss"),
    )

    def step(s, i):
        return F.struct(
            s["x"].alias("x"), s["y"].alias("y"), (s["p"] * s["x"] / i).alias("p"), (s["q"] * s["y"] / i).alias("q"),
            (s["below_p"] + s["p"]).alias("below_p"), (s["below_q"] + s["q"]).alias("below_q"),
            (s["win"] + s["p"] * s["below_q"]).alias("win"), (s["draw"] + s["p"] * s["q"]).alias("draw"), (s["loss"] + s["q"] * s["below_p"]).alias("loss"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(k + 1)), start, step, lambda s: F.struct(s["win"].alias("win"), s["draw"].alias("draw"), s["loss"].alias("loss"))
    )


def poisson_outcomes(sums: Column) -> tuple[Column, Column, Column]:
    """Home, draw and away probability from score_sums; what lies beyond its k goals counts for the away side."""
    return sums["win"], sums["draw"], 1 - sums["win"] - sums["draw"]


def tail_safe_sums(home: Column, away: Column, tail: float = 1e-15) -> Column:
    """struct(goals, win, draw, loss, seen_home, seen_away, top_home, top_away) over 0..goals, a length of each row's own.

    goals is the smallest number at which less than `tail` of either side's goals is left, by its forward CDF; the grid
    stops growing there. A bound from the larger rate (its deviation taken ten times, and 30 more) ends the sequence
    where rounding keeps the CDF below 1 - tail. Each term follows from the one before; above a rate of 600, where the
    first would underflow, terms are taken in log space. seen_* are the sides' masses, top_* their largest
    terms. Null where a rate is null, not finite or not above zero. Select it once under a name before its fields are
    read.
    """
    x, y = home.cast("double"), away.cast("double")
    larger, zero = F.greatest(x, y), F.lit(0.0)
    open_until = F.lit(1 - tail)
    bound = F.ceil(larger + 10 * F.sqrt(larger) + 30).cast("int")

    def added(s, i, p, q, *more):
        return F.struct(
            i.alias("goals"), p.alias("p"), q.alias("q"), (s["seen_p"] + p).alias("seen_p"), (s["seen_q"] + q).alias("seen_q"),
            (s["win"] + p * s["seen_q"]).alias("win"), (s["draw"] + p * q).alias("draw"), (s["loss"] + q * s["seen_p"]).alias("loss"),
            F.greatest(s["top_p"], p).alias("top_p"), F.greatest(s["top_q"], q).alias("top_q"), *more,
        )

    def grown(start, term):
        fields = ("goals", "win", "draw", "loss")
        return F.aggregate(
            F.sequence(F.lit(1), bound), start,
            lambda s, i: F.when((s["seen_p"] < open_until) | (s["seen_q"] < open_until), term(s, i)).otherwise(s),
            lambda s: F.struct(*(s[f].alias(f) for f in fields), s["seen_p"].alias("seen_home"), s["seen_q"].alias("seen_away"), s["top_p"].alias("top_home"), s["top_q"].alias("top_away")),
        )

    none = {k: zero for k in ("seen_p", "seen_q", "win", "draw", "loss", "top_p", "top_q")}
    first = added(none, F.lit(0), F.exp(-x), F.exp(-y))
    plain = grown(first, lambda s, i: added(s, i, s["p"] * x / i, s["q"] * y / i))
    logs = F.lit(0.0).alias("logs")
    high = grown(
        added(none, F.lit(0), F.exp(-x), F.exp(-y), logs),
        lambda s, i: added(s, i, F.exp(i * F.log(x) - x - s["logs"] - F.log(i)), F.exp(i * F.log(y) - y - s["logs"] - F.log(i)), (s["logs"] + F.log(i)).alias("logs")),
    )
    valid = (x > 0) & (y > 0) & (larger < float("inf")) & ~F.isnan(larger)
    return F.when(valid & (larger <= 600), plain).when(valid, high)


def poisson_table(sums: Column, home: Column, away: Column) -> dict[str, Column]:
    """The whole prediction of a contest from tail_safe_sums: probabilities, likeliest score, and the grid's controls.

    win and draw are summed, loss is their complement. residual is the larger mass that a side's grid leaves out, control
    the gap between the complement and the summed loss. safe tells whether residual <= 1e-12, control <= 1e-10, the
    probabilities sum to one within 1e-9 and each lies in 0..1; false for rates that give no table.
    """
    win, draw = sums["win"], sums["draw"]
    loss = 1 - win - draw
    residual = F.greatest(F.abs(1 - sums["seen_home"]), F.abs(1 - sums["seen_away"]))
    control = F.abs(loss - sums["loss"])
    inside = win.between(0, 1) & draw.between(0, 1) & loss.between(0, 1)
    safe = (residual <= 1e-12) & (control <= 1e-10) & (F.abs(win + draw + loss - 1) <= 1e-9) & inside
    return {
        "goals": sums["goals"], "win": win, "draw": draw, "loss": loss, "pick": argmax(win, draw, loss), "modal": modal_score(home, away),
        "modal_p": sums["top_home"] * sums["top_away"], "residual": residual, "control": control, "safe": F.coalesce(safe, F.lit(False)),
    }


def modal_score(home: Column, away: Column) -> Column:
    """The pair of the likeliest goal counts, as "h-a"; the lower one where two are equally likely.

    A count k is likelier than k - 1 exactly if k is below the rate.
    """
    def mode(rate: Column) -> Column:
        return F.greatest(F.ceil(rate) - 1, F.lit(0)).cast("string")

    return F.when(home.isNotNull() & away.isNotNull(), F.concat_ws("-", mode(home), mode(away)))


def low_score_factor(i: int, j: int, home: Column, away: Column, rho: Column | float) -> Column:
    """The correction of the four lowest scores for dependence rho; 1 elsewhere."""
    rho = rho if isinstance(rho, Column) else F.lit(rho)
    return {(0, 0): 1 - home * away * rho, (0, 1): 1 + home * rho, (1, 0): 1 + away * rho, (1, 1): 1 - rho}.get((i, j), F.lit(1.0))


def corrected_outcomes(sums: Column, home: Column, away: Column, rho: Column | float) -> list[Column]:
    """Home, draw and away probability of the corrected grid, renormalised, from the grid's score_sums."""
    none = F.exp(-home - away)

    def gained(i: int, j: int) -> Column:
        cell = none * (home if i else F.lit(1.0)) * (away if j else F.lit(1.0))
        return cell * (F.greatest(low_score_factor(i, j, home, away, rho), F.lit(0.0)) - 1)

    win, draw, loss = sums["win"] + gained(1, 0), sums["draw"] + gained(0, 0) + gained(1, 1), sums["loss"] + gained(0, 1)
    mass = win + draw + loss
    return [win / mass, draw / mass, loss / mass]


def uncertain_outcomes(home: Column, away: Column, var_home: Column, var_away: Column, rho: float, k: int = 15) -> Column:
    """struct(win, draw, loss): corrected outcomes averaged over log-normal rates at 5 x 5 quadrature nodes.

    A pandas UDF: a row's 25 grids of k + 1 goals a side are products of its ten marginals, which array functions would
    interpret cell by cell (ten times slower). Deviations are held to 0.01..0.35. Null where an input is null.
    """
    nodes = quadrature()
    at, weight = np.array([x for x, _ in nodes]), np.array([w for _, w in nodes])

    def marginals(rate, variance):
        sd = np.clip(np.sqrt(np.maximum(variance, 1e-4)), 0.01, 0.35)[:, None]
        rates = rate[:, None] * np.exp(sd * at - sd * sd / 2)
        terms = np.empty((*rates.shape, k + 1))
        terms[:, :, 0] = np.exp(-rates)
        for i in range(1, k + 1):
            terms[:, :, i] = terms[:, :, i - 1] * rates / i
        return rates, terms, terms.cumsum(axis=2)

    @F.pandas_udf("win double, draw double, loss double")
    def averaged(h: pd.Series, a: pd.Series, vh: pd.Series, va: pd.Series) -> pd.DataFrame:
        x, p, p_upto = marginals(h.to_numpy(float), vh.to_numpy(float))
        y, q, q_upto = marginals(a.to_numpy(float), va.to_numpy(float))
        win, draw = p[:, :, 1:] @ q_upto[:, :, :-1].transpose(0, 2, 1), p @ q.transpose(0, 2, 1)
        loss = p_upto[:, :, :-1] @ q[:, :, 1:].transpose(0, 2, 1)
        x, y = x[:, :, None], y[:, None, :]
        none = np.exp(-x - y)
        win = win + none * x * (np.maximum(1 + y * rho, 0) - 1)
        draw = draw + none * (np.maximum(1 - x * y * rho, 0) - 1) + none * x * y * (max(1 - rho, 0) - 1)
        loss = loss + none * y * (np.maximum(1 + x * rho, 0) - 1)
        w = np.outer(weight, weight) / (win + draw + loss)
        return pd.DataFrame({c: (w * v).sum(axis=(1, 2)) for c, v in (("win", win), ("draw", draw), ("loss", loss))})

    found = averaged(*(c.cast("double") for c in (home, away, var_home, var_away)))
    return F.when(home.isNotNull() & away.isNotNull() & var_home.isNotNull() & var_away.isNotNull(), found)


def draw_with_dependence(home: Column, away: Column, rho: float, k: int = 15) -> Column:
    """Draw probability alone: independent draws plus the corrections of 0-0 and 1-1, clipped."""
    ph, pa = poisson_pmf(home, k), poisson_pmf(away, k)
    base = F.aggregate(F.zip_with(ph, pa, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    p00, p11 = F.exp(-home - away), home * away * F.exp(-home - away)
    return F.least(F.greatest(base - p00 * home * away * rho - p11 * rho, F.lit(1e-6)), F.lit(1 - 1e-6))


def redistribute(p_home: Column, p_away: Column, draw: Column) -> list[Column]:
    """A new draw probability; home and away keep their ratio."""
    rest = p_home + p_away
    return [
        F.when(rest > 0, (1 - draw) * p_home / rest).otherwise((1 - draw) / 2),
        draw,
        F.when(rest > 0, (1 - draw) * p_away / rest).otherwise((1 - draw) / 2),
    ]


def entropy(*p: Column) -> Column:
    """Shannon entropy in nats; zero terms add nothing."""
    terms = [F.when(x > 0, -x * F.log(x)).otherwise(0.0) for x in p]
    return sum(terms[1:], terms[0])


def margin(*p: Column) -> Column:
    """Largest minus second largest."""
    s = F.array_sort(F.array(*p))
    return F.get(s, F.lit(len(p) - 1)) - F.get(s, F.lit(len(p) - 2))


def js_divergence(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon divergence in nats."""
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]

    def kl(a, b):
        terms = [F.when(x > 0, x * F.log(x / y)).otherwise(0.0) for x, y in zip(a, b, strict=True)]
        return sum(terms[1:], terms[0])

    return (kl(p, m) + kl(q, m)) / 2


def implied(*odds: Column) -> tuple[list[Column], Column]:
    """Probabilities in proportion to 1 / odds, and the overround."""
    raw = [1 / o for o in odds]
    total = sum(raw[1:], raw[0])
    return [x / total for x in raw], total


def power_exponent(*odds: Column, steps: int = 16) -> Column:
    """The k with which the (1 / odds) ** k sum to one; null where an odd is not above 1.

    Newton's method: the sum is convex and falls in k, so that the steps from zero on never pass the root.
    """
    valid = odds[0] > 1
    for o in odds[1:]:
        valid = valid & (o > 1)

    def step(k, _):
        parts = [(F.exp(-k * F.log(o)), F.log(o)) for o in odds]
        over = sum((p for p, _ in parts[1:]), parts[0][0]) - 1
        slope = sum((p * l for p, l in parts[1:]), parts[0][0] * parts[0][1])
        return k + over / slope

    return F.when(F.coalesce(valid, F.lit(False)), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step))


def power_devig(*odds: Column) -> tuple[list[Column], Column]:
    """Probabilities (1 / odds) ** k that sum to one, and k; null where an odd is not above 1.

    Select power_exponent under a name first where many rows are worked on.
    """
    k = power_exponent(*odds)
    return [F.pow(1 / o, k) for o in odds], k


def elo_expected(home: Column, away: Column, advantage: float = 100.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (away - home - advantage) / 400))


def goal_multiplier(diff: Column) -> Column:
    """1 up to one goal, 1.5 for two, then (11 + d) / 8."""
    d = F.abs(diff)
    return F.when(d <= 1, 1.0).when(d == 2, 1.5).otherwise((11 + d) / 8)


def elo_draw(gap: Column, base: float = 0.28, scale: float = 0.0006) -> Column:
    """Draw probability falling with the rating gap."""
    return base * F.exp(-scale * F.abs(gap))


def decay_weight(unix: Column, reference: Column | int, xi: float) -> Column:
    """exp(-xi * days) for the age at the reference time; never above one."""
    ref = reference if isinstance(reference, Column) else F.lit(reference)
    return F.exp(-xi * F.greatest(ref - unix, F.lit(0)) / 86400)


def causal(unix: Column, reference: Column | int) -> Column:
    """Whether a row lies before the reference time, as every row that is weighted must."""
    return unix < (reference if isinstance(reference, Column) else F.lit(reference))


def ranking_preserved(p: list[Column], q: list[Column]) -> Column:
    """Whether both triples put their classes in the same order, equal ones by position."""
    pairs = [(p[i] <= p[j]) == (q[i] <= q[j]) for i in range(len(p)) for j in range(i + 1, len(p))]
    return reduce(Column.__and__, pairs)


def shrinkage(n: Column, m0: float) -> Column:
    return n / (n + m0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share; null without observations."""
    p = hits / F.when(n > 0, n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def inflated(home: Column, draw: Column, away: Column, share: float) -> list[Column]:
    """The given share of all mass moved onto the draw."""
    return [(1 - share) * home, (1 - share) * draw + share, (1 - share) * away]


def bounded_rate(rate: Column, shift: Column, bound: float) -> Column:
    """rate * exp(shift), the shift clipped to +-bound."""
    return rate * F.exp(F.greatest(F.least(shift, F.lit(bound)), F.lit(-bound)))


def quadrature(points: int = 5) -> list[tuple[float, float]]:
    """Gauss-Hermite (node, weight) pairs for a standard normal variable; the weights add up to 1."""
    nodes, weights = hermgauss(points)
    return [(float(x * 2**0.5), float(w / weights.sum())) for x, w in zip(nodes, weights, strict=True)]


def vector_scaled(p: list[Column], scale: list[float], shift: list[float], eps: float = 1e-15) -> list[Column]:
    """softmax(scale * ln p + shift), class by class."""
    return softmax(*(s * F.log(F.greatest(x, F.lit(eps))) + b for x, s, b in zip(p, scale, shift, strict=True)))


def platt_draw(p: list[Column], slope: float, shift: float) -> list[Column]:
    """The draw through a logistic curve of its logit; home and away share the rest as before."""
    return redistribute(p[0], p[2], sigmoid(slope * logit(p[1]) + shift))


def beta_draw(p: list[Column], a: float, b: float, c: float, eps: float = 1e-12) -> list[Column]:
    """The draw through a beta curve, sigmoid(a ln p - b ln(1 - p) + c); home and away share the rest as before."""
    x = F.least(F.greatest(p[1], F.lit(eps)), F.lit(1 - eps))
    return redistribute(p[0], p[2], sigmoid(a * F.log(x) - b * F.log(1 - x) + c))


def nearest_rates(p: list[Column], grid: Column) -> Column:
    """The struct (gap, home, away) of a grid of structs (home, away, h, d, a) whose outcome probabilities lie
    nearest; of equal gaps the smallest rates."""
    return F.array_min(
        F.transform(
            grid,
            lambda g: F.struct(
                F.round(F.pow(g["h"] - p[0], F.lit(2)) + F.pow(g["d"] - p[1], F.lit(2)) + F.pow(g["a"] - p[2], F.lit(2)), 9).alias("gap"),
                g["home"].alias("home"),
                g["away"].alias("away"),
            ),
        )
    )
