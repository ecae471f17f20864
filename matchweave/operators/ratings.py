"""Sequential ratings: one kernel per rule, run on each connected group of teams.

A contest changes the ratings that later contests read, so order matters within a group of teams
that ever meet, and nowhere else. Groups are the parallel unit. Contests at one kickoff all read
before any of them writes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from math import exp

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.sources.storage import shared_folder

PLAYED = ("FT", "AWARDED")


@dataclass
class Elo:
    """Elo with home advantage and margin multiplier; gamma pulls all known ratings to the start on a new season.

    `openings` are the kickoffs at which seasons begin anywhere, in order: every one pulls every team. A team's pulls
    are made up for when it is met again, as its distance to the start times (1 - gamma) for each opening since, so that
    groups of teams need no state in common. decay > 0 lets the step shrink with a team's number of contests: k * (1 + decay / sqrt(n + 1)).
    """

    start: float = 1500.0
    k: float = 20.0
    advantage: float = 100.0
    margin: bool = True
    gamma: float = 0.0
    decay: float = 0.0
    openings: tuple = ()
    rating: dict = field(default_factory=dict)
    played: dict = field(default_factory=dict)
    pulled: dict = field(default_factory=dict)
    columns = ("home_rating", "away_rating")

    def enter(self, key, home, away, unix) -> None:
        if not self.gamma:
            return
        opened = bisect_right(self.openings, unix)
        for team in (home, away):
            before = self.pulled.get(team, opened)
            if team in self.rating and opened > before:
                self.rating[team] = self.start + (1 - self.gamma) ** (opened - before) * (self.rating[team] - self.start)
            self.pulled[team] = opened

    def read(self, home, away) -> tuple[float, ...]:
        return self.rating.get(home, self.start), self.rating.get(away, self.start)

    def write(self, home, away, goals_home: float, goals_away: float, seen: tuple[float, ...]) -> None:
        expected = 1 / (1 + 10 ** ((seen[1] - seen[0] - self.advantage) / 400))
        actual = 1.0 if goals_home > goals_away else 0.5 if goals_home == goals_away else 0.0
        gap = abs(goals_home - goals_away)
        times = 1.0 if gap <= 1 or not self.margin else 1.5 if gap == 2 else (11 + gap) / 8
        for team, sign in ((home, 1), (away, -1)):
            n = self.played.get(team, 0)
            step = self.k * (1 + self.decay / (n + 1) ** 0.5) if self.decay else self.k
            self.rating[team] = self.rating.get(team, self.start) + sign * step * times * (actual - expected)
            self.played[team] = n + 1


@dataclass
class AttackDefence:
    """Attack and defence per team, moved along the gradient of the Poisson error and clipped."""

    rate: float = 0.05
    base_home: float = 1.5
    base_away: float = 1.2
    clip: float = 1.5
    state: dict = field(default_factory=dict)
    columns = ("home_attack", "home_defence", "away_attack", "away_defence")

    def enter(self, key, home, away, unix) -> None:
        pass

    def read(self, home, away) -> tuple[float, ...]:
        return (*self.state.get(home, (0.0, 0.0)), *self.state.get(away, (0.0, 0.0)))

    def write(self, home, away, goals_home: float, goals_away: float, seen: tuple[float, ...]) -> None:
        ah, dh, aa, da = seen
        bound = lambda x: max(-3.0, min(3.0, x))
        miss_home = goals_home - self.base_home * exp(bound(ah - da))
        miss_away = goals_away - self.base_away * exp(bound(aa - dh))
        cut = lambda x: max(-self.clip, min(self.clip, x))
        for team, attack, defence in ((home, miss_home, miss_away), (away, miss_away, miss_home)):
            a, d = self.state.get(team, (0.0, 0.0))
            self.state[team] = (cut(a + self.rate * attack), cut(d - self.rate * defence))


@dataclass
class DynamicAttackDefence:
    """Attack and defence with a variance each, and states for home and away contests apart.

    A contest first pulls both teams' states towards zero and adds noise to their variances. The Poisson
    error then moves a state by a step that grows with its variance, and the variance shrinks, down to a
    floor. Venue states follow the same errors at a fixed step, without pull or variance.
    """

    rate: float = 0.025
    noise: float = 0.005
    reversion: float = 0.015
    learned: float = 0.08
    floor: float = 0.01
    start_variance: float = 0.25
    venue_rate: float = 0.03
    base_home: float = 1.5348
    base_away: float = 1.2740
    clip: float = 1.5
    state: dict = field(default_factory=dict)
    at_venue: dict = field(default_factory=dict)
    played: dict = field(default_factory=dict)
    columns = (
        "home_attack", "home_defence", "home_attack_variance", "home_defence_variance", "home_seen", "home_venue_attack", "home_venue_defence",
        "away_attack", "away_defence", "away_attack_variance", "away_defence_variance", "away_seen", "away_venue_attack", "away_venue_defence",
        "home_rate", "away_rate", "home_rate_variance", "away_rate_variance",
    )

    def enter(self, key, home, away, unix) -> None:
        pass

    def _of(self, team) -> tuple[float, ...]:
        return self.state.get(team, (0.0, 0.0, self.start_variance, self.start_variance))

    def _cut(self, x: float) -> float:
        return max(-self.clip, min(self.clip, x))

    def _rates(self, home: tuple[float, ...], away: tuple[float, ...]) -> tuple[float, float]:
        return self.base_home * exp(self._cut(home[0] - away[1])), self.base_away * exp(self._cut(away[0] - home[1]))

    def read(self, home, away) -> tuple[float, ...]:
        sides = [(self._of(t), float(self.played.get(t, 0)), self.at_venue.get((t, v), (0.0, 0.0))) for t, v in ((home, "home"), (away, "away"))]
        (h, _, _), (a, _, _) = sides
        flat = [x for s, n, v in sides for x in (*s, n, *v)]
        return (*flat, *self._rates(h, a), h[2] + a[3], a[2] + h[3])

    def write(self, home, away, goals_home: float, goals_away: float, seen: tuple[float, ...]) -> None:
        keep = 1 - self.reversion
        h, a = (tuple(x * keep for x in s[:2]) + tuple(v + self.noise for v in s[2:]) for s in (self._of(home), self._of(away)))
        rate_home, rate_away = self._rates(h, a)
        miss_home, miss_away = goals_home - rate_home, goals_away - rate_away
        for team, venue, (attack, defence, va, vd), scored, conceded in ((home, "home", h, miss_home, miss_away), (away, "away", a, miss_away, miss_home)):
            self.state[team] = (
                self._cut(attack + self.rate * (1 + 2 * va) * scored),
                self._cut(defence - self.rate * (1 + 2 * vd) * conceded),
                max(va * (1 - self.learned), self.floor),
                max(vd * (1 - self.learned), self.floor),
            )
            x, y = self.at_venue.get((team, venue), (0.0, 0.0))
            self.at_venue[team, venue] = (self._cut(x + self.venue_rate * scored), self._cut(y - self.venue_rate * conceded))
            self.played[team] = self.played.get(team, 0) + 1


@dataclass
class DynamicElo:
    """Elo whose step shrinks with a team's contests, and attack and defence ratings beside it.

    A team that enters a season other than its last one keeps `keep` of its distance to the start.
    """

    start: float = 1500.0
    k: float = 20.0
    decay: float = 1.5
    keep: float = 0.85
    advantage: float = 100.0
    goal_step: float = 5.0
    venue: float = 0.15
    rating: dict = field(default_factory=dict)
    attack: dict = field(default_factory=dict)
    defence: dict = field(default_factory=dict)
    played: dict = field(default_factory=dict)
    last: dict = field(default_factory=dict)
    columns = ("home_rating", "away_rating", "home_step", "away_step", "home_attack", "home_defence", "away_attack", "away_defence")

    def enter(self, key, home, away, unix) -> None:
        for team in (home, away):
            if self.last.setdefault(team, key) != key:
                self.last[team] = key
                for table in (self.rating, self.attack, self.defence):
                    table[team] = self.start + self.keep * (table.get(team, self.start) - self.start)

    def _step(self, team) -> float:
        return self.k * (1 + self.decay / (self.played.get(team, 0) + 1) ** 0.5)

    def read(self, home, away) -> tuple[float, ...]:
        of = lambda table, team: table.get(team, self.start)
        rest = [of(table, team) for team in (home, away) for table in (self.attack, self.defence)]
        return (of(self.rating, home), of(self.rating, away), self._step(home), self._step(away), *rest)

    def write(self, home, away, goals_home: float, goals_away: float, seen: tuple[float, ...]) -> None:
        expected = 1 / (1 + 10 ** ((seen[1] - seen[0] - self.advantage) / 400))
        actual = 1.0 if goals_home > goals_away else 0.5 if goals_home == goals_away else 0.0
        gap = abs(goals_home - goals_away)
        times = 1.0 if gap <= 1 else 1.5 if gap == 2 else (11 + gap) / 8
        miss = (
            goals_home - exp(self.venue + (seen[4] - seen[7]) / 400),
            goals_away - exp(-self.venue + (seen[6] - seen[5]) / 400),
        )
        for team, sign, mine, theirs in ((home, 1, 0, 1), (away, -1, 1, 0)):
            self.rating[team] = self.rating.get(team, self.start) + sign * self._step(team) * times * (actual - expected)
            self.attack[team] = self.attack.get(team, self.start) + self.goal_step * miss[mine]
            self.defence[team] = self.defence.get(team, self.start) - self.goal_step * miss[theirs]
            self.played[team] = self.played.get(team, 0) + 1


CONTEST = ["fixture_id", "unix", "home_id", "away_id", "home_goals", "away_goals", "status", "season_id"]


class Replay:
    """A kernel on its way through contests in kickoff order, however they are cut into batches.

    The results of one kickoff are written when a later one begins, so that all its contests read
    before any of them writes. The whole object is the state to keep between batches.
    """

    def __init__(self, kernel):
        self.kernel, self.waiting, self.at = kernel, [], None

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Ratings before each contest of rows, which are in order, whatever their status."""
        out = []
        for fixture, unix, home, away, gh, ga, status, season in rows[CONTEST].itertuples(index=False):
            if unix != self.at:
                self.settle()
                self.at = unix
            self.kernel.enter(season, home, away, unix)
            seen = self.kernel.read(home, away)
            out.append((fixture, *seen))
            if status in PLAYED and gh == gh and ga == ga and gh is not None and ga is not None:
                self.waiting.append((home, away, float(gh), float(ga), seen))
        return pd.DataFrame(out, columns=["fixture_id", *self.kernel.columns])

    def settle(self) -> None:
        """Write the results that wait."""
        for w in self.waiting:
            self.kernel.write(*w)
        self.waiting = []


def replay(pdf: pd.DataFrame, make: Callable) -> pd.DataFrame:
    """Ratings before each contest of one group."""
    return Replay(make()).feed(pdf.sort_values(["unix", "fixture_id"], kind="stable"))


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def team_groups(contests: DataFrame, key: str | None = None) -> DataFrame:
    """contests with `team_group`: teams that meet, directly or through others, share one.

    With a key (such as the competition) that no team leaves, groups are its values.
    """
    if key:
        return contests.withColumn("team_group", F.col(key).cast("long"))
    groups = group_labels(contests.select(F.col("home_id").alias("a"), F.col("away_id").alias("b")).distinct())
    return contests.join(groups, contests.home_id == groups.team, "left").withColumn("team_group", F.coalesce("label", "home_id").cast("long")).drop("team", "label")


def group_labels(pairs: DataFrame) -> DataFrame:
    """(team, label): the smallest team reachable.

    Minima spread along pairs, and every team then takes over its label's own label, so that a
    label's reach doubles in a round; rounds go on until none changes, however long a chain is.
    """
    both = cut(pairs.select("a", "b").unionAll(pairs.select(F.col("b"), F.col("a"))).where("a is not null and b is not null").distinct())
    labels = both.select(F.col("a").alias("team")).distinct().withColumn("label", F.col("team"))
    changed = 1
    while changed:
        near = both.join(labels, both.b == labels.team).groupBy(F.col("a").alias("near")).agg(F.min("label").alias("least"))
        nearer = labels.join(near, labels.team == near.near).select("team", F.least("label", "least").alias("reached"), "label")
        further = nearer.select(F.col("team").alias("of"), F.col("reached").alias("jump"))
        moved = cut(
            nearer.join(further, nearer.reached == further.of).select("team", F.least("reached", "jump").alias("label"), F.col("label").alias("before"))
        )
        changed = moved.where("label != before").limit(1).count()
        labels = moved.select("team", "label")
    return labels


def rated(contests: DataFrame, make: Callable = Elo, key: str | None = "competition_id") -> DataFrame:
    """(fixture_id, ratings before the contest) for every contest.

    `make` builds a kernel with enter, read and write. Rows are dealt by group and sorted by kickoff
    on Spark; a task streams them in batches, one group after the other, and keeps only the
    kernel's state, however many contests a group has.
    """
    columns = ", ".join(f"{c} double" for c in make().columns)

    def run(batches):
        group = going = None
        for pdf in batches:
            edges = [0, *(pdf["team_group"].ne(pdf["team_group"].shift()).to_numpy().nonzero()[0][1:]), len(pdf)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = pdf.iloc[a:b]
                if len(part) and (going is None or part["team_group"].iloc[0] != group):
                    group, going = part["team_group"].iloc[0], Replay(make())
                if len(part):
                    yield going.feed(part)

    rows = team_groups(contests, key).select("team_group", *CONTEST)
    dealt = rows.repartition("team_group").sortWithinPartitions("team_group", "unix", "fixture_id")
    return dealt.mapInPandas(run, f"fixture_id long, {columns}")


def season_openings(contests: DataFrame, season: str = "season_id") -> tuple[int, ...]:
    """The first kickoff of every season, in order; a short list, as long as there are seasons."""
    return tuple(r.first for r in contests.groupBy(season).agg(F.min("unix").alias("first")).where("first is not null").orderBy("first").collect())


def diagnostics(ratings: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population deviation, range and finiteness of every rating column."""
    parts = [
        ratings.agg(
            F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.min(c).alias("low"), F.max(c).alias("high"),
            F.count_if(F.isnan(c) | F.col(c).isNull()).alias("broken"),
        )
        for c in columns
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cold_start(targets: DataFrame, latest: DataFrame, bridge: DataFrame, default: float = 1500.0) -> DataFrame:
    """Each team's state: its latest, else its bridge from an earlier season, else the default, with the method."""
    found = targets.join(latest.select("team_id", F.col("state").alias("own"), "rows"), "team_id", "left").join(
        bridge.select("team_id", F.col("state").alias("prior")), "team_id", "left"
    )
    return found.select(
        "team_id",
        F.coalesce("own", "prior", F.lit(default)).alias("state"),
        F.when(F.col("own").isNotNull(), "history").when(F.col("prior").isNotNull(), "bridge").otherwise("default").alias("method"),
        F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
    )
