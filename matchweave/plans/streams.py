"""Streaming queries over the event table and the contests."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchweave.plans.base import query, r
from matchweave.plans.ratings import Q1_SQL, four_digits
from matchweave.sources import bindings
from matchweave.sources.bindings import CONTESTS, contests
from matchweave.streaming import prospective as st


def events(spark, sf):
    return st.read_stream(spark, f"{sf}/events.parquet")


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view' AND hour(ts) < 18")
def r1_prediction_locks(spark, sf):
    """One lock per user and day, before the day's deadline at 18:00."""
    rows = events(spark, sf).where("event_type = 'view'").select("user_id", "ts", F.to_date("ts").alias("day"))
    rows = rows.withColumn("deadline", F.expr("cast(day as timestamp) + interval 18 hours"))
    return st.drained(st.locks(rows, ["user_id", "day"], "ts", "deadline")).select("user_id", "day")


@query(
    """SELECT a.event_id AS lock_id, b.event_id AS outcome_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR"""
)
def r2_reconciliation(spark, sf):
    """Stream-stream join of locks with outcomes that follow within an hour."""
    e = events(spark, sf)
    locked = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("locked_at"), F.col("event_id").alias("lock_id"))
    outcomes = events(spark, sf).where("event_type = 'purchase'").select(F.col("user_id").alias("okey"), F.col("ts").alias("settled_at"), F.col("event_id").alias("outcome_id"))
    return st.drained(st.reconciled(locked, outcomes)).select("lock_id", "outcome_id")


@query(
    f"""WITH x AS (SELECT event_type, value, (CAST(floor(epoch(ts)) AS BIGINT) // 21600 - k) * 21600 AS start FROM events, (SELECT unnest(range(4)) AS k))
SELECT CAST(start AS BIGINT) AS start, event_type, count(*) AS n, {r('avg(value)', 'mean')} FROM x GROUP BY 1, 2"""
)
def r3_rolling_signal(spark, sf):
    """Sliding day windows every six hours."""
    out = st.drained(st.rolling_signal(events(spark, sf), "ts", ["event_type"], "value", "24 hours", "6 hours"), "complete")
    return out.withColumn("start", F.unix_timestamp("start"))


@query(
    f"""SELECT CAST(floor(epoch(ts)) AS BIGINT) // 21600 * 21600 AS bucket, event_type, count(*) AS n, {r('avg(value)', 'mean')} FROM events GROUP BY 1, 2"""
)
def r6_tumbling_buckets(spark, sf):
    """Tumbling six-hour buckets, kept by batch so that a replayed batch changes nothing."""
    keep = lambda table, batch, k: table.tumbling(batch, k, "ts", 21600, ["event_type"], "value")
    return st.bucketed(events(spark, sf), st.shared_folder(spark), keep).table(spark, ["event_type"])


@query(
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events)
SELECT CAST(place // 5 AS BIGINT) AS bucket, user_id, count(*) AS n, {r('avg(value)', 'mean')} FROM k GROUP BY 1, 2"""
)
def r6_count_buckets(spark, sf):
    """Buckets of five results of each user, in order."""
    keep = lambda table, batch, k: table.counted(batch, k, 5, ["user_id"], ["ts", "event_id"], "value")
    return st.bucketed(events(spark, sf), st.shared_folder(spark), keep).table(spark, ["user_id"])


@query(
    """SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'error' ELSE arg_max(event_type, ts) END AS event_type FROM events GROUP BY user_id"""
)
def r4_sticky_state(spark, sf):
    """A final state stays; the table holds every version, the newest one counts."""
    rows = events(spark, sf).select("user_id", "event_type", F.unix_micros("ts").alias("at"))
    versions = st.drained(st.sticky_states(rows, "user_id", "event_type", "at", ("error",)), "update")
    return versions.groupBy("user_id").agg(F.max_by("event_type", "version").alias("event_type"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def r7_sessions(spark, sf):
    """Session clusters of each user."""
    out = st.drained(st.sessions(events(spark, sf), "ts", "user_id", "3 hours"), "complete")
    return out.withColumn("start", F.floor(F.unix_micros("start") / 1000000))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def r8_incremental_ingest(spark, sf):
    """The second run over the same checkpoint finds nothing new."""
    target, checkpoint = st.shared_folder(spark), st.shared_folder(spark)
    for _ in range(2):
        table = st.drained(events(spark, sf).select("event_id", "event_type"), checkpoint=checkpoint, target=target)
    return table.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query(
    f"""WITH {CONTESTS} SELECT CASE WHEN fixture_id % 10 = 3 THEN 'duplicate' WHEN season_year < 1994 THEN 'historical' WHEN 820454400 > unix - 900 THEN 'late' WHEN home_xg IS NULL THEN 'missing_features' ELSE 'eligible' END AS reason, count(*) AS n FROM contests GROUP BY 1"""
)
def r9_eligibility_funnel(spark, sf):
    """The first reason that applies to each row, counted."""
    c = contests(spark, sf)
    return st.funnel(c, c.where("fixture_id % 10 = 3"), c.where("season_year < 1994"), 820454400).groupBy("reason").agg(F.count("*").alias("n"))


@query(Q1_SQL)
def r5_online_ratings(spark, sf):
    """Ratings from a stream of contests, kickoffs released by event-time timers; equal to q1_elo."""
    columns = bindings._contest_columns("unix_timestamp(o_orderdate)")
    stream = st.read_stream(spark, f"{sf}/orders.parquet").select(*(F.expr(e).alias(c) for c, e in columns.items()))
    last = contests(spark, sf).agg(F.max("unix").alias("last")).first()["last"]
    return four_digits(st.drained(st.online_ratings(stream, "competition_id", closed_at=last)))
