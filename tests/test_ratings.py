import pickle
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchweave.operators import ratings
from matchweave.plans import catalog
from matchweave.sources.bindings import contests
from matchweave.streaming import prospective

SF = "/root/testdata/sf0.001"


def frame(rows):
    names = ["fixture_id", "unix", "home_id", "away_id", "home_goals", "away_goals", "status", "season_id"]
    return pd.DataFrame(rows, columns=names)


def test_elo_by_hand():
    out = ratings.replay(frame([(1, 10, 1, 2, 2, 0, "FT", 1), (2, 20, 2, 1, None, None, "NS", 1), (3, 30, 1, 3, 0, 0, "FT", 1)]), ratings.Elo)
    expected = 1 / (1 + 10 ** (-100 / 400))
    gain = 20 * 1.5 * (1 - expected)
    assert out.home_rating[0] == 1500 and out.home_rating[1] == pytest.approx(1500 - gain) and out.away_rating[1] == pytest.approx(1500 + gain)
    assert out.home_rating[2] == pytest.approx(1500 + gain)


def test_ties_read_before_they_write():
    rows = [(1, 10, 1, 2, 3, 0, "FT", 1), (2, 10, 1, 3, 3, 0, "FT", 1), (3, 20, 1, 2, 0, 0, "FT", 1)]
    out = ratings.replay(frame(rows), ratings.Elo)
    assert out.home_rating.tolist()[:2] == [1500, 1500] and out.home_rating[2] > 1500


def test_no_learning_stays_at_zero():
    out = ratings.replay(frame([(k, k, 1, 2, 4, 0, "FT", 1) for k in range(9)]), lambda: ratings.AttackDefence(rate=0.0))
    assert (out.drop(columns="fixture_id") == 0).all().all()
    clipped = ratings.replay(frame([(k, k, 1, 2, 9, 0, "FT", 1) for k in range(300)]), lambda: ratings.AttackDefence(rate=0.5))
    assert clipped.drop(columns="fixture_id").abs().max().max() <= 1.5


def test_dynamic_states_by_hand():
    out = ratings.replay(frame([(1, 10, 1, 2, 2, 0, "FT", 1), (2, 20, 1, 2, None, None, "NS", 1)]), ratings.DynamicAttackDefence)
    miss_home, miss_away, step = 2 - 1.5348, 0 - 1.2740, 0.025 * (1 + 2 * 0.255)
    after = out.iloc[1]
    assert out.iloc[0].home_attack_variance == 0.25 and out.iloc[0].home_rate == pytest.approx(1.5348)
    assert after.home_attack == pytest.approx(step * miss_home) and after.away_defence == pytest.approx(-step * miss_home)
    assert after.home_defence == pytest.approx(-step * miss_away) and after.away_attack == pytest.approx(step * miss_away)
    assert after.home_attack_variance == pytest.approx(0.255 * 0.92) and after.home_seen == 1
    assert after.home_venue_attack == pytest.approx(0.03 * miss_home) and after.away_venue_defence == pytest.approx(-0.03 * miss_home)
    assert after.home_rate_variance == pytest.approx(2 * 0.255 * 0.92)
    assert after.home_rate == pytest.approx(1.5348 * 2.718281828459045 ** (after.home_attack - after.away_defence))


def test_groups_and_competitions_agree(spark):
    c = contests(spark, SF)
    show = lambda df: sorted(map(tuple, df.collect()))
    assert show(ratings.rated(c, key=None)) == show(ratings.rated(c))


def test_stream_equals_batch(spark):
    show = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()))
    assert show("r5_online_ratings") == show("q1_elo")


KERNELS = [ratings.Elo, partial(ratings.Elo, gamma=0.3, decay=1.0), ratings.DynamicElo, ratings.AttackDefence, ratings.DynamicAttackDefence]


@pytest.mark.parametrize("make", KERNELS)
def test_batches_carry_the_whole_state(make):
    rng = np.random.default_rng(5)
    rows = [(k, k // 3, int(a), int(b), int(g), int(h), "FT" if g else "NS", 1 + k // 100) for k, (a, b, g, h) in enumerate(rng.integers(0, 6, (300, 4))) if a != b]
    whole = ratings.replay(frame(rows), make)
    going, parts = ratings.Replay(make()), []
    for k in range(0, len(rows), 7):
        parts.append(going.feed(frame(rows[k : k + 7])))
        going = pickle.loads(pickle.dumps(going))
    assert pd.concat(parts, ignore_index=True).equals(whole)


@pytest.mark.parametrize("make", [partial(ratings.Elo, gamma=0.3, openings=(760000000, 800000000)), ratings.DynamicElo, ratings.AttackDefence, ratings.DynamicAttackDefence])
def test_shuffled_arrival_within_the_watermark_equals_one_batch(spark, make, tmp_path):
    """Contests arrive up to 300 days out of order, in four batches."""
    c = contests(spark, SF)
    arrival = F.col("unix") + F.pmod(F.xxhash64("fixture_id"), F.lit(300 * 86400))
    edges = [0, 740000000, 800000000, 860000000, 2**40]
    for k in range(4):
        c.where(arrival.between(edges[k], edges[k + 1] - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = c.agg(F.max("unix").alias("last")).first()["last"]
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    show = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    found = prospective.drained(prospective.online_ratings(stream, "competition_id", make, delay="300 days", closed_at=last))
    assert show(found) == show(ratings.rated(c, make))


def test_rows_behind_the_watermark_are_dropped_not_replayed(spark, tmp_path):
    c = contests(spark, SF).where("competition_id = 1")
    late = c.orderBy("unix", "fixture_id").limit(5).select("fixture_id")
    late = [r.fixture_id for r in late.collect()]
    last = c.agg(F.max("unix").alias("last")).first()["last"]
    late_rows = F.col("fixture_id").isin(late)
    for rows in (c.where(~late_rows & (F.col("unix") < last - 30 * 86400)), c.where(~late_rows & F.col("unix").between(last - 30 * 86400, last - 1)), c.where(late_rows), c.where(F.col("unix") == last)):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    show = lambda df: sorted(map(tuple, df.collect()))
    found = prospective.drained(prospective.online_ratings(stream, "competition_id", closed_at=last))
    assert show(found) == show(ratings.rated(c.where(~F.col("fixture_id").isin(late))))


def test_long_chains_are_one_group(spark):
    pairs = [(k, k + 1) for k in range(500)] + [(k, k + 1) for k in range(1000, 1003)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, ratings.group_labels(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(501), 0), **dict.fromkeys(range(1000, 1004), 1000)}


def test_dynamic_elo_by_hand():
    rows = [(1, 10, 1, 2, 3, 0, "FT", 1), (2, 20, 2, 1, 1, 1, "FT", 1), (3, 30, 1, 2, None, None, "NS", 2)]
    out = ratings.replay(frame(rows), ratings.DynamicElo)
    step = 20 * 2.5
    gain = step * 14 / 8 * (1 - 1 / (1 + 10 ** (-100 / 400)))
    assert out.home_step[0] == step and out.away_rating[1] == pytest.approx(1500 + gain) and out.away_attack[1] == pytest.approx(1500 + 5 * (3 - np.exp(0.15)))
    after = out.away_rating[1] + 20 * (1 + 1.5 / 2**0.5) * -(0.5 - 1 / (1 + 10 ** ((out.away_rating[1] - out.home_rating[1] - 100) / 400)))
    assert out.home_rating[2] == pytest.approx(1500 + 0.85 * (after - 1500)) and out.home_step[2] == pytest.approx(20 * (1 + 1.5 / 3**0.5))
