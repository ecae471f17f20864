"""Queries of sources, ledgers, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchweave.functions import text
from matchweave.plans.base import query, r
from matchweave.sources import ledger
from matchweave.sources.bindings import CONTESTS, ODDS, PREDS, contests, odds, predictions
from matchweave.sources.storage import shared_folder


@query(
    "WITH " + CONTESTS + """, p AS (SELECT *, fixture_id // 1000 AS page FROM contests)
SELECT page, CASE WHEN page % 7 = 3 THEN 0 ELSE count(*) END AS records, CASE WHEN page % 7 = 3 THEN 0 ELSE sum(coalesce(home_goals, 0)) END::BIGINT AS home_goals, page % 7 = 3 AS broken FROM p GROUP BY page"""
)
def s1_raw_pages(spark, sf):
    """Saved raw pages read in the order of their files, pages that don't parse kept aside; every seventh is cut short."""
    rows = contests(spark, sf).select("fixture_id", "unix", "home_goals", "away_goals")
    path, cut = shared_folder(spark), F.expr("left(value, length(value) div 2)")
    texts = ledger.page_texts(rows, F.floor(F.col("fixture_id") / 1000), "fixture_id")
    ledger.write_pages(texts.withColumn("value", F.when(F.col("page") % 7 == 3, cut).otherwise(F.col("value"))), path)
    found = ledger.read_pages(spark, path, rows.schema)
    page = F.regexp_extract("file", r"page=(\d+)", 1).cast("long")
    goals = F.aggregate("data", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["home_goals"], F.lit(0)))
    return found.select(page.alias("page"), F.coalesce(F.size("data"), F.lit(0)).cast("long").alias("records"), F.coalesce(goals, F.lit(0)).alias("home_goals"), "broken")


@query(
    "WITH " + CONTESTS + """, m AS (SELECT fixture_id, list_sort(list_filter([CASE WHEN home_goals IS NULL THEN 'home_goals' END, CASE WHEN home_xg IS NULL THEN 'home_xg' END, CASE WHEN home_shots IS NULL THEN 'home_shots' END, CASE WHEN home_shots IS NULL AND home_goals IS NULL THEN 'stats' END], lambda x: x IS NOT NULL)) AS f FROM contests)
SELECT fixture_id, array_to_string(f, ',') AS missing, len(f) AS missing_field_count, len(f) = 0 AS is_complete FROM m"""
)
def s2_missing_fields(spark, sf):
    """Sorted names of missing fields, a missing block counted once more."""
    rows = ledger.with_missing(contests(spark, sf), ["home_goals", "home_xg", "home_shots"], F.col("home_shots").isNull() & F.col("home_goals").isNull())
    return rows.select("fixture_id", F.array_join("missing_fields", ",").alias("missing"), "missing_field_count", "is_complete")


@query("WITH " + CONTESTS + """, k AS (SELECT CASE WHEN fixture_id % 11 = 0 THEN NULL ELSE fixture_id END AS id FROM contests) SELECT id IS NOT NULL AS accepted, count(*) AS n FROM k GROUP BY 1""")
def s3_reject_without_key(spark, sf):
    rows = contests(spark, sf).select(F.when(F.col("fixture_id") % 11 != 0, F.col("fixture_id")).alias("id"))
    good, bad = ledger.split_rejects(rows, "id")
    return good.agg(F.count("*").alias("n")).withColumn("accepted", F.lit(True)).unionByName(bad.agg(F.count("*").alias("n")).withColumn("accepted", F.lit(False)))


@query("SELECT page_id, regexp_replace(url || '&API_token=abc' || page_id || '&z=1', '([Aa][Pp][Ii]_token=)[^&\\s]+', '\\1REDACTED') AS url FROM pages")
def s4_redact(spark, sf):
    url = F.concat("url", F.lit("&API_token=abc"), "page_id", F.lit("&z=1"))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", text.redact(url).alias("url"))


@query(
    "WITH " + CONTESTS + """, a AS (SELECT fixture_id, status, home_goals, unix AS updated, unix AS ingested FROM contests UNION ALL SELECT fixture_id, 'FT', coalesce(home_goals, 0) + 1, unix + 10, unix + 10 FROM contests WHERE fixture_id % 3 = 0)
SELECT fixture_id, arg_max(status, updated) AS status, max_by(struct_pack(g := home_goals), updated).g AS home_goals, max(updated) AS updated, min(ingested) AS ingested FROM a GROUP BY fixture_id"""
)
def s5_upsert(spark, sf):
    """Newest row of each key, first ingestion time kept."""
    old = contests(spark, sf).select("fixture_id", "status", "home_goals", F.col("unix").alias("updated"), F.col("unix").alias("ingested"))
    new = old.where("fixture_id % 3 = 0").select("fixture_id", F.lit("FT").alias("status"), (F.coalesce("home_goals", F.lit(0)) + 1).alias("home_goals"), (F.col("updated") + 10).alias("updated"), (F.col("updated") + 10).alias("ingested"))
    return ledger.upserted(old, new, "fixture_id", "updated", "ingested")


@query("WITH " + CONTESTS + " SELECT fixture_id, unix, home_id, away_id, home_goals, away_goals, status FROM contests WHERE status = 'FT' AND unix >= 852076800")
def s8_pruned_scan(spark, sf):
    """Seven columns of played contests from a day on."""
    return contests(spark, sf).where("status = 'FT' and unix >= 852076800").select("fixture_id", "unix", "home_id", "away_id", "home_goals", "away_goals", "status")


@query(f"WITH {PREDS} SELECT y_true, count(*) AS n, 1 AS version FROM preds WHERE y_true IN ('H', 'D', 'A') GROUP BY y_true")
def s9_single_version(spark, sf):
    """Labelled scan that fails on mixed versions."""
    rows = ledger.one_version(predictions(spark, sf).withColumn("version", F.lit(1)), "version")
    return rows.where(F.col("y_true").isin("H", "D", "A")).groupBy("y_true").agg(F.count("*").alias("n"), F.max("version").alias("version"))


@query("""WITH l AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'view'), seen AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id % 2 = 0)
SELECT user_id, min(event_id) AS event_id FROM l WHERE user_id NOT IN (SELECT user_id FROM seen) GROUP BY user_id""")
def s13_first_write_wins(spark, sf):
    """The first row of every key that the ledger doesn't hold yet."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    seen = e.where("event_type = 'error' and user_id % 2 = 0").select("user_id").distinct()
    return ledger.append_new(seen, e.where("event_type = 'view'").select("user_id", "event_id"), "user_id", "event_id")


@query(
    f"""WITH {PREDS}, a AS (SELECT fixture_id, p_home, CAST(NULL AS VARCHAR) AS outcome FROM preds WHERE fixture_id % 5 <> 0), b AS (SELECT fixture_id, y_true AS outcome FROM preds WHERE fixture_id % 2 = 0)
SELECT coalesce(a.fixture_id, b.fixture_id) AS fixture_id, {r('p_home', 'p_home')}, coalesce(b.outcome, a.outcome) AS outcome FROM a FULL JOIN b ON a.fixture_id = b.fixture_id"""
)
def s15_consolidate(spark, sf):
    """Snapshots patched and completed by outcomes."""
    p = predictions(spark, sf)
    snapshots = p.where("fixture_id % 5 != 0").select("fixture_id", "p_home", F.lit(None).cast("string").alias("outcome"))
    return ledger.consolidated(snapshots, p.where("fixture_id % 2 = 0").select("fixture_id", F.col("y_true").alias("outcome")), "fixture_id", ["outcome"])


@query(
    f"""WITH {ODDS}, g AS (SELECT fixture_id, bookmaker_id, count(closing) AS k, max(closing) FILTER (outcome = 'home') AS home, max(closing) FILTER (outcome = 'draw') AS draw, max(closing) FILTER (outcome = 'away') AS away FROM odds GROUP BY ALL)
SELECT fixture_id, bookmaker_id, {r('home', 'home')}, {r('draw', 'draw')}, {r('away', 'away')} FROM g WHERE k = 3 QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY bookmaker_id <> 1, bookmaker_id) = 1"""
)
def s16_wide_odds(spark, sf):
    """The preferred, else first, complete market of each contest, one row each."""
    wide = odds(spark, sf).groupBy("fixture_id", "bookmaker_id").pivot("outcome", ["home", "draw", "away"]).agg(F.first("closing", ignorenulls=True))
    whole = wide.where("home is not null and draw is not null and away is not null")
    order = F.struct((F.col("bookmaker_id") != 1).alias("other"), "bookmaker_id")
    return whole.groupBy("fixture_id").agg(F.min_by(F.struct("bookmaker_id", "home", "draw", "away"), order).alias("b")).select("fixture_id", "b.*")


@query(
    "WITH " + CONTESTS + f""", b AS (SELECT fixture_id, coalesce(home_xg, 0.1188e0 * coalesce(home_shots_on, 4) + 0.0703e0 * greatest(coalesce(home_shots, 0) - coalesce(home_shots_on, 0), 0)) AS h,
 coalesce(away_xg, 0.0954e0 * coalesce(away_shots_on, 3) + 0.0849e0 * greatest(coalesce(away_shots, 0) - coalesce(away_shots_on, 0), 0)) AS a, CASE WHEN home_xg IS NOT NULL AND away_xg IS NOT NULL THEN 'vendor' ELSE 'model' END AS xg_source FROM contests)
SELECT fixture_id, {r('h', 'xg_home')}, {r('a', 'xg_away')}, {r('greatest(h - 0.087, 0.05)', 'npxg_home')}, {r('greatest(a - 0.087, 0.05)', 'npxg_away')}, xg_source FROM b"""
)
def s17_xg_backfill(spark, sf):
    return ledger.xg_backfill(contests(spark, sf)).select("fixture_id", "xg_home", "xg_away", "npxg_home", "npxg_away", "xg_source")


@query(
    f"""WITH {PREDS}, f AS (SELECT fixture_id, p_home + p_draw + p_away AS s, p_home, fixture_id % 97 = 0 AS broken FROM preds)
SELECT broken, count(*) AS n, count(*) FILTER (abs(s + broken::INT * 0.1 - 1) > 1e-6) AS bad_sum, count(*) FILTER (p_home < 0.1) AS low FROM f GROUP BY broken"""
)
def p13_probability_validity(spark, sf):
    """Row flags on probabilities, counted."""
    rows = predictions(spark, sf).withColumn("broken", F.col("fixture_id") % 97 == 0)
    total = F.col("p_home") + F.col("p_draw") + F.col("p_away") + F.col("broken").cast("int") * 0.1
    return rows.groupBy("broken").agg(F.count("*").alias("n"), F.count_if(F.abs(total - 1) > 1e-6).alias("bad_sum"), F.count_if(F.col("p_home") < 0.1).alias("low"))


@query(
    """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)
SELECT event_id, k, CASE WHEN k % 4 = 0 THEN k % 7 END AS home, CASE WHEN k % 4 = 0 THEN k % 3 END AS away, t, CASE k % 5 WHEN 0 THEN 'FT' WHEN 1 THEN 'LIVE' WHEN 2 THEN 'POSTPONED' ELSE 'OTHER' END AS state FROM e"""
)
def f2_parse_events(spark, sf):
    """JSON fields, scores, timestamps and status names from text."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = text.safe_number(F.get_json_object("props", "$.k")).cast("long")
    rows = e.select("event_id", "ts", k.alias("k"))
    score = F.when(F.col("k") % 4 == 0, F.concat((F.col("k") % 7).cast("string"), F.lit(" - "), (F.col("k") % 3).cast("string"))).otherwise(F.lit("n/a"))
    stamp = text.to_utc(F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss"))
    state = F.when(F.col("k") % 5 == 0, "FT").when(F.col("k") % 5 == 1, "LIVE").when(F.col("k") % 5 == 2, "POSTPONED").otherwise("OTHER")
    return rows.select(
        "event_id", "k", text.score_part(score, 0).cast("long").alias("home"), text.score_part(score, 1).cast("long").alias("away"), F.unix_timestamp(stamp).alias("t"), state.alias("state")
    )


@query("WITH " + CONTESTS + """ SELECT fixture_id, sha256('away_id=' || away_id || ';fixture_id=' || fixture_id || ';home_goals=' || coalesce(home_goals::VARCHAR, 'null')) AS hash FROM contests""")
def f7_record_hash(spark, sf):
    """canonical hash of a record."""
    return contests(spark, sf).select("fixture_id", text.record_hash("home_goals", "fixture_id", "away_id").alias("hash"))


@query("WITH " + CONTESTS + """ SELECT DISTINCT season_year, CAST(epoch(make_date(season_year::INT, 7, 1)::TIMESTAMP) AS BIGINT) AS opens, CAST(epoch(make_date(season_year::INT + 1, 8, 15)::TIMESTAMP) AS BIGINT) AS closes FROM contests""")
def f6_season_bracket(spark, sf):
    """a season's epoch bracket."""
    y = F.col("season_year").cast("int")
    day = lambda year, month, d: F.unix_timestamp(F.make_date(year, F.lit(month), F.lit(d)).cast("timestamp"))
    return contests(spark, sf).select("season_year").distinct().select("season_year", day(y, 7, 1).alias("opens"), day(y + 1, 8, 15).alias("closes"))


@query("WITH " + CONTESTS + """ SELECT competition_id, count(*) FILTER (status = 'FT') AS completed, count(*) FILTER (status = 'NS') AS upcoming, count(*) FILTER (status = 'NS' AND unix > 900000000 + 900) AS open FROM contests WHERE season_year >= 1997 GROUP BY competition_id""")
def p11_cohort_partition(spark, sf):
    """Completed, upcoming and still open contests of a cohort."""
    s = F.col("status")
    return contests(spark, sf).where("season_year >= 1997").groupBy("competition_id").agg(
        F.count_if(s == "FT").alias("completed"), F.count_if(s == "NS").alias("upcoming"), F.count_if((s == "NS") & (F.col("unix") > 900000000 + 900)).alias("open")
    )
