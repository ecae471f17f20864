"""The tail-safe Poisson table against long sums."""

from math import exp, floor, lgamma, log

import pytest
from pyspark.sql import functions as F

from matchweave.functions import probability as fn

RATES = [(0.1, 0.1), (0.1, 60.0), (1.3, 1.1), (2.0, 2.0), (12.0, 3.0), (30.0, 28.0), (59.5, 60.0), (0.7, 0.2), (900.0, 880.0), (5.0, 4.0)]


def long_sum(home, away, top):
    p, q = ([exp(i * log(x) - x - lgamma(i + 1)) for i in range(top)] for x in (home, away))
    below_p, below_q, win, draw, loss = 0.0, 0.0, 0.0, 0.0, 0.0
    for a, b in zip(p, q):
        win, draw, loss = win + a * below_q, draw + a * b, loss + b * below_p
        below_p, below_q = below_p + a, below_q + b
    return win, draw, loss, max(p) * max(q)


@pytest.fixture(scope="module")
def found(spark):
    rates = spark.createDataFrame([*RATES, (None, 1.0), (0.0, 1.0), (float("inf"), 1.0), (float("nan"), 2.0)], "h double, a double")
    table = fn.poisson_table(F.col("sums"), F.col("h"), F.col("a"))
    rows = rates.withColumn("sums", fn.tail_safe_sums(F.col("h"), F.col("a"))).select("h", "a", *(c.alias(k) for k, c in table.items())).collect()
    return rows


def test_equals_a_long_sum(found):
    for r, (home, away) in zip(found, RATES):
        win, draw, loss, top = long_sum(home, away, 400 if home < 100 else 2000)
        exact = 1e-12 if home < 100 else 1e-10
        assert abs(r.win - win) < exact and abs(r.draw - draw) < exact and abs(r.loss - loss) < exact and abs(r.modal_p - top) < exact
        assert r.safe and r.residual < 1e-12 or home > 100


def test_grid_ends_where_the_tail_does(found):
    for r, rates in zip(found, RATES):
        rate = max(rates)
        left = sum(exp(k * log(rate) - rate - lgamma(k + 1)) for k in range(r.goals + 1, r.goals + 400))
        assert left < 1e-15 * 1.5
        assert r.goals <= rate + 10 * rate**0.5 + 31
    small = {(r.h, r.a): r.goals for r in found}
    assert small[0.1, 0.1] < 12 < small[1.3, 1.1] < small[5.0, 4.0] < small[12.0, 3.0]


def test_likeliest_score(found):
    for r, rates in zip(found, RATES):
        assert r.modal == "-".join(str(int(x) - 1 if x == floor(x) else floor(x)) for x in rates)


def test_rates_without_a_table(found):
    for r in found[len(RATES):]:
        assert r.win is None and r.safe is False


def test_likeliest_scores_are_keyed_by_longs_and_keep_the_order_of_ties(spark):
    """Cells were sorted as structs by a comparator; equal ones come by goals."""
    from matchweave.functions import probability as fn

    rows = spark.createDataFrame([(1, [0.5, 0.25, 0.25], [0.5, 0.5, 0.0]), (2, [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), (3, [None] * 3, [0.5, 0.5, 0.0])], "k int, p array<double>, q array<double>")
    got = {r.k: [tuple(c) for c in r.c] for r in rows.select("k", fn.likeliest_scores(F.col("p"), F.col("q"), 2, 3).alias("c")).collect()}
    assert got[1] == [(1, "0-0", 0.25), (2, "0-1", 0.25), (3, "1-0", 0.125)]
    assert got[2] == [(1, "0-0", 1.0), (2, "0-1", 0.0), (3, "0-2", 0.0)]
    assert [c[1:] for c in got[3]] == [("0-0", None), ("0-1", None), ("0-2", None)]


def test_typed_values_are_read_once(spark):
    """Every mention of the array's filter was worked out anew."""
    from matchweave.operators import contracts

    rows = spark.sql("select array(named_struct('type_id', 237, 'values', map('home', 30d, 'draw', -1d, 'away', 10d)), named_struct('type_id', 237, 'values', map('home', 1d))) as p")
    found = rows.select(contracts.typed_values(F.col("p"), 237).alias("f"))
    assert tuple(found.select(*contracts.typed_percentages(F.col("f"))).first()) == (0.75, 0.0, 0.25)
