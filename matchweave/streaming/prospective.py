"""Structured Streaming: locks, reconciliation, rolling signals, sticky states and online ratings."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from matchweave.operators.ratings import CONTEST, Elo, Replay
from matchweave.sources.storage import shared_folder


def drained(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Run a stream over all available input into Parquet and return the table.

    complete mode rewrites the table with every batch; the other modes add to it. With the same
    checkpoint and target, a later call takes up where the last one ended.
    """
    spark = stream.sparkSession
    target = target or shared_folder(spark)
    checkpoint = checkpoint or shared_folder(spark)
    schema = stream.schema

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(target)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).parquet(target)


class BucketTable:
    """Sums by bucket of a stream's batches, in a folder for each batch id.

    A batch that is run again overwrites its own folder only, so that replays change nothing. `tumbling` buckets are
    lengths of event time; `counted` ones are so many results of a group each, in the order of batches and, within
    one, of the given columns.
    """

    def __init__(self, path: str):
        self.path = path

    def _write(self, rows: DataFrame, batch_id: int, keys: list[str], value: str) -> None:
        sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.count(value).alias("known"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def _batches(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The sums of all batches, or of those before one."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            return None
        table = spark.read.parquet(self.path)
        return table if before is None else table.where(F.col("batch") < before)

    def tumbling(self, batch: DataFrame, batch_id: int, stamp: str, seconds: int, groups: list[str], value: str) -> None:
        start = F.floor(F.unix_micros(stamp) / (seconds * 1_000_000)) * seconds
        self._write(batch.withColumn("bucket", start), batch_id, ["bucket", *groups], value)

    def counted(self, batch: DataFrame, batch_id: int, size: int, groups: list[str], order: list[str], value: str) -> None:
        earlier = self._batches(batch.sparkSession, batch_id)
        place = F.row_number().over(W.partitionBy(*groups).orderBy(*order)) - 1
        rows = batch.withColumn("place", place)
        if earlier is not None:
            seen = earlier.groupBy(*groups).agg(F.sum("n").alias("seen"))
            rows = rows.join(seen, groups, "left").withColumn("place", F.col("place") + F.coalesce("seen", F.lit(0)))
        self._write(rows.withColumn("bucket", F.floor(F.col("place") / size)), batch_id, ["bucket", *groups], value)

    def table(self, spark: SparkSession, groups: list[str]) -> DataFrame:
        """(bucket, groups, n, mean) over all batches."""
        sums = self._batches(spark).groupBy("bucket", *groups).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("known").alias("known"))
        return sums.select("bucket", *groups, "n", F.when(F.col("known") > 0, F.col("total") / F.col("known")).alias("mean"))


def bucketed(stream: DataFrame, path: str, keep: Callable[[BucketTable, DataFrame, int], None], checkpoint: str | None = None) -> BucketTable:
    """Run a stream over all available input, each batch kept in the bucket table at path."""
    table = BucketTable(path)
    writer = stream.writeStream.option("checkpointLocation", checkpoint or shared_folder(stream.sparkSession)).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, batch_id: keep(table, batch, batch_id)).start().awaitTermination()
    return table


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder, or a single file in a folder, as a stream with the schema of what is there.

    Timestamps without a zone are read as the session's.
    """
    table = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    files = table.inputFiles()
    reader = spark.readStream.schema(table.schema)
    single = len(files) == 1 and files[0].endswith(f"/{name}")
    stream = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in table.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def locks(stream: DataFrame, key: list[str], stamp: str, deadline: str, delay: str = "1 day") -> DataFrame:
    """The first lock of each key before its deadline; repeats within the delay and late ones are left out."""
    return stream.withWatermark(stamp, delay).where(F.col(stamp) < F.col(deadline)).dropDuplicatesWithinWatermark(key)


def reconciled(locked: DataFrame, outcomes: DataFrame, within: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Locks joined with outcomes of the same key that follow within the given time.

    locked(key, locked_at, ...), outcomes(okey, settled_at, ...); the time range bounds the state.
    """
    left, right = locked.withWatermark("locked_at", delay), outcomes.withWatermark("settled_at", delay)
    return left.join(right, F.expr(f"key = okey and settled_at >= locked_at and settled_at <= locked_at + interval {within}"))


def rolling_signal(stream: DataFrame, stamp: str, groups: list[str], value: str, length: str, slide: str, delay: str = "1 day") -> DataFrame:
    """Count and mean of a value over sliding windows of event time."""
    return (
        stream.withWatermark(stamp, delay)
        .groupBy(F.window(stamp, length, slide).alias("w"), *groups)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
        .select("w.start", *groups, "n", "mean")
    )


def sessions(stream: DataFrame, stamp: str, key: str, gap: str, delay: str = "1 day") -> DataFrame:
    """Clusters of one key's events less than the gap apart."""
    return (
        stream.withWatermark(stamp, delay)
        .groupBy(F.session_window(stamp, gap).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(key, "w.start", "n")
    )


def sticky_states(stream: DataFrame, key: str, state: str, stamp: str, final: tuple[str, ...]) -> DataFrame:
    """Each key's state after a batch: a final state stays, whatever comes later; else the newest one."""

    def step(name, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        current, at, version = kept.get if kept.exists else ("", -1, 0)
        rows = pd.concat(list(batches)).sort_values(stamp, kind="stable")
        for value, t in zip(rows[state], rows[stamp], strict=True):
            if current not in final and t >= at:
                current, at = value, int(t)
        kept.update((current, at, version + 1))
        yield pd.DataFrame({key: [name[0]], state: [current], "version": [version + 1]})

    return stream.select(key, state, stamp).groupBy(key).applyInPandasWithState(
        step, f"{key} long, {state} string, version long", "current string, at long, version long", "update", GroupStateTimeout.NoTimeout
    )


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KickoffRatings(StatefulProcessor):
    """Rates one group's contests kickoff by kickoff, once the watermark has passed a kickoff.

    State is a map of waiting kickoffs with their contests, the set of those kickoffs, and a map of teams with what the kernel knows of each;
    a released kickoff reads and writes its own teams only. All contests of a kickoff read before any of them writes.
    """

    def __init__(self, make: Callable):
        self.make = make

    def init(self, handle) -> None:
        self.handle, self.kernel = handle, self.make()
        self.tables = [f.name for f in fields(self.kernel) if isinstance(getattr(self.kernel, f.name), dict)]
        self.waiting = handle.getMapState("waiting", "unix long", "contests binary")
        self.teams = handle.getMapState("teams", "team long", "known binary")
        self.pending = handle.getValueState("pending", "kickoffs binary")
        self.released = handle.getValueState("released", "unix long")

    def handleInputRows(self, key, rows, timerValues):
        held: dict[int, list] = {}
        released = self.released.get()[0] if self.released.exists() else None
        for pdf in rows:
            for contest in pdf[CONTEST].itertuples(index=False, name=None):
                if released is None or contest[1] > released:
                    held.setdefault(int(contest[1]), []).append(contest)
        pending = self._pending()
        for unix, contests in held.items():
            if unix in pending:
                contests = pickle.loads(self.waiting.getValue((unix,))[0]) + contests
            else:
                self.handle.registerTimer(unix * 1000)
            self.waiting.updateValue((unix,), (pickle.dumps(contests),))
        if held:
            self.pending.update((pickle.dumps(pending | held.keys()),))
        return iter(())

    def _pending(self) -> set[int]:
        """The waiting kickoffs, kept as one value, as a walk over the map's keys for each timer would be quadratic."""
        return pickle.loads(self.pending.get()[0]) if self.pending.exists() else set()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        known: set[int] = set()
        out = []
        pending = self._pending()
        due = sorted(unix for unix in pending if unix <= now)
        if due:
            self.pending.update((pickle.dumps(pending.difference(due)),))
        for unix in due:
            contests = sorted(pickle.loads(self.waiting.getValue((unix,))[0]))
            self.waiting.removeKey((unix,))
            self.released.update((unix,))
            for team in {c[k] for c in contests for k in (2, 3)} - known:
                self._load(team)
                known.add(team)
            rows = pd.DataFrame(contests, columns=CONTEST)
            going = Replay(self.kernel)
            out.append(going.feed(rows))
            going.settle()
        for team in known:
            self._keep(team)
        if out:
            yield pd.concat(out, ignore_index=True)

    def _load(self, team: int) -> None:
        if self.teams.containsKey((team,)):
            for table, k, value in pickle.loads(self.teams.getValue((team,))[0]):
                getattr(self.kernel, table)[k] = value

    def _keep(self, team: int) -> None:
        """Store and forget what the kernel knows of a team, under its id or a tuple that begins with it."""
        found = []
        for name in self.tables:
            table = getattr(self.kernel, name)
            for k in [k for k in (team, (team, "home"), (team, "away")) if k in table]:
                found.append((name, k, table.pop(k)))
        self.teams.updateValue((team,), (pickle.dumps(found),))

    def close(self) -> None:
        pass


def online_ratings(stream: DataFrame, group: str, make: Callable = Elo, delay: str = "7 days", closed_at: int | None = None) -> DataFrame:
    """Ratings before each contest of a stream, per group of teams, for contests that arrive in any order within the delay.

    Event-time timers release a kickoff when the watermark, the latest kickoff seen less the delay, has passed it: its
    contests are complete then. A contest that comes after its kickoff or a later one of its group was released is
    dropped, as its ratings would no longer be those of its kickoff. closed_at is the last kickoff of a bounded backlog: a marker behind it closes the stream, so
    that its last kickoffs are released as well. State lives in RocksDB, one entry for each team and waiting kickoff;
    the session is set to it.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.select(F.col(group).cast("long").alias("team_group"), *CONTEST)
    if closed_at is not None:
        marker = F.struct(F.lit(None).cast("long").alias("team_group"), *(F.lit(closed_at + 4_000_000_000 if c == "unix" else None).cast(rows.schema[c].dataType).alias(c) for c in CONTEST))
        same = F.struct("team_group", *CONTEST)
        rows = rows.select(F.explode(F.when(F.col("unix") == closed_at, F.array(same, marker)).otherwise(F.array(same))).alias("c")).select("c.*")
    columns = ", ".join(f"{c} double" for c in make().columns)
    timed = rows.withColumn("kickoff", F.timestamp_seconds("unix")).withWatermark("kickoff", delay)
    found = timed.groupBy("team_group").transformWithStateInPandas(KickoffRatings(make), f"fixture_id long, {columns}", "append", "eventTime")
    return found.where("fixture_id is not null")


def funnel(batch: DataFrame, locked: DataFrame, history: DataFrame, now: int, buffer: int = 900) -> DataFrame:
    """One micro-batch's rows with the first reason that applies: duplicate, historical, late, missing, eligible."""
    known = locked.select(F.col("fixture_id").alias("l")).distinct()
    past = history.select(F.col("fixture_id").alias("h")).distinct()
    return batch.join(known, batch.fixture_id == F.col("l"), "left").join(past, batch.fixture_id == F.col("h"), "left").withColumn(
        "reason",
        F.when(F.col("l").isNotNull(), "duplicate")
        .when(F.col("h").isNotNull(), "historical")
        .when(F.lit(now) > F.col("unix") - buffer, "late")
        .when(F.col("home_xg").isNull(), "missing_features")
        .otherwise("eligible"),
    ).drop("l", "h")
