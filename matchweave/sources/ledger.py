"""Reading raw pages, normalising records, upserting and consolidating ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.functions.text import redact


def read_pages(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Raw JSON pages {data: [...], info: {...}} with their file name; secrets in *_url fields are redacted.

    Each file is one page, on as many lines as it likes. `broken` tells of a page that doesn't parse: it has no data,
    and its text is kept in `raw`, with secrets redacted in it as well.
    """
    info = T.StructType([T.StructField("page", T.LongType()), T.StructField("next_page_url", T.StringType())])
    schema = T.StructType([T.StructField("data", T.ArrayType(record)), T.StructField("info", info), T.StructField("_raw", T.StringType())])
    pages = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_raw").option("recursiveFileLookup", True).json(path, multiLine=True)
    broken = F.col("_raw").isNotNull()
    kept = {"data": F.col("data"), "page": F.col("info.page"), "next_page_url": redact(F.col("info.next_page_url"))}
    return pages.select(
        *(F.when(~broken, c).alias(n) for n, c in kept.items()), F.input_file_name().alias("file"), broken.alias("broken"), redact(F.col("_raw")).alias("raw")
    )


def page_texts(rows: DataFrame, page: Column, order: str) -> DataFrame:
    """(page, value): rows as the JSON texts of raw pages, each page's records in order."""
    cells = F.array_sort(F.collect_list(F.struct(order, *(c for c in rows.columns if c != order))))
    pages = rows.groupBy(page.alias("page")).agg(cells.alias("data"))
    return pages.select("page", F.to_json(F.struct("data", F.struct("page").alias("info"))).alias("value"))


def write_pages(texts: DataFrame, path: str) -> None:
    """Write page_texts, one file for each page."""
    texts.repartition("page").write.partitionBy("page").text(path)


def records(pages: DataFrame) -> DataFrame:
    """One row per record of every page."""
    return pages.select("file", F.explode("data").alias("record")).select("file", "record.*")


#: A live record under all the names its vendors use; numbers may come as texts.
LIVE = (
    "id string, fixture_id string, status string, home_goals string, home_score string, away_goals string, away_score string, "
    "scores struct<home: string, away: string>, elapsed string, time_added string"
)


def live_records(rows: DataFrame, text: str) -> DataFrame:
    """The columns of rows but text, and from its JSON fixture_id, status, home_goals, away_goals, elapsed and time_added.

    Each comes from the first of its names that has a value: id, else fixture_id (an id of 0 is none); home_goals, else
    home_score, else scores.home. A missing status is NS. What isn't a number, or not JSON, is null.
    """
    names = {
        "fixture_id": ("id", "fixture_id"), "home_goals": ("home_goals", "home_score", "scores.home"), "away_goals": ("away_goals", "away_score", "scores.away"),
        "elapsed": ("elapsed",), "time_added": ("time_added",),
    }
    raw = rows.withColumn("__raw", F.from_json(text, LIVE))
    own, other = (F.col(f"__raw.{n}").try_cast("long") for n in names["fixture_id"])
    numbers = {k: F.coalesce(*(F.col(f"__raw.{n}") for n in found)).try_cast("int") for k, found in names.items() if k != "fixture_id"}
    kept = [c for c in rows.columns if c not in {text, "status", *names}]
    return raw.select(*kept, F.coalesce(F.nullif(own, F.lit(0).cast("long")), other).alias("fixture_id"), F.upper(F.coalesce("__raw.status", F.lit("NS"))).alias("status"), *(c.alias(k) for k, c in numbers.items()))


def with_missing(rows: DataFrame, fields: list[str], block: Column | None = None, name: str = "stats") -> DataFrame:
    """Adds missing_fields (sorted), missing_field_count and is_complete; a missing block is one more entry."""
    checks = [F.when(F.col(f).isNull(), F.lit(f)) for f in fields]
    if block is not None:
        checks.append(F.when(block, F.lit(name)))
    return rows.withColumn("missing_fields", F.array_sort(F.array_compact(F.array(*checks)))).withColumns(
        {"missing_field_count": F.size("missing_fields").cast("long"), "is_complete": F.size("missing_fields") == 0}
    )


def split_rejects(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the key, rows without it)."""
    return rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())


def upserted(existing: DataFrame, incoming: DataFrame, key: str, order: str, first_seen: str | None = None) -> DataFrame:
    """The newest row of each key; first_seen keeps its earliest value."""
    rows = existing.unionByName(incoming)
    newest = W.partitionBy(key).orderBy(F.desc(order))
    found = rows.withColumn("__n", F.row_number().over(newest))
    if first_seen:
        found = found.withColumn(first_seen, F.min(first_seen).over(W.partitionBy(key)))
    return found.where("__n = 1").drop("__n")


def append_new(ledger: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: the first one of each key that the ledger doesn't hold."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), order).alias("r")).select("r.*")
    return first.join(ledger.select(key), key, "left_anti").select(*incoming.columns)


def consolidated(snapshots: DataFrame, outcomes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Snapshots patched by outcomes; outcomes without a snapshot are inserted."""
    right = outcomes.select(F.col(key).alias("__key"), *(F.col(v).alias(f"__{v}") for v in values))
    both = snapshots.join(right, snapshots[key] == F.col("__key"), "full_outer")
    keep = [c for c in snapshots.columns if c not in (*values, key)]
    return both.select(
        F.coalesce(F.col(key), F.col("__key")).alias(key), *keep, *(F.coalesce(F.col(f"__{v}"), F.col(v) if v in snapshots.columns else F.lit(None)).alias(v) for v in values)
    )


def one_version(rows: DataFrame, column: str) -> DataFrame:
    """rows, failing at run time if the column holds more than one value."""
    seen = rows.agg(F.collect_set(column).alias("versions"))
    return rows.crossJoin(F.broadcast(seen)).where(
        F.when(F.size("versions") <= 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than one {column}")).cast("boolean"))
    ).drop("versions")


def write_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    """Parquet in one folder for each value; rows are dealt by value first, so that files stay few."""
    rows.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def xg_backfill(rows: DataFrame) -> DataFrame:
    """Vendor xG, else a shot model, with non-penalty xG and provenance."""
    off = lambda side: F.greatest(F.coalesce(F.col(f"{side}_shots"), F.lit(0)) - F.coalesce(F.col(f"{side}_shots_on"), F.lit(0)), F.lit(0))
    #: Fixed values of the shot model: goals per shot on and off target, home and away.
    home = 0.1188 * F.coalesce("home_shots_on", F.lit(4)) + 0.0703 * off("home")
    away = 0.0954 * F.coalesce("away_shots_on", F.lit(3)) + 0.0849 * off("away")
    filled = rows.withColumns(
        {"xg_home": F.coalesce("home_xg", home), "xg_away": F.coalesce("away_xg", away), "xg_source": F.when(F.col("home_xg").isNotNull() & F.col("away_xg").isNotNull(), "vendor").otherwise("model")}
    )
    return filled.withColumns({f"npxg_{s}": F.greatest(F.col(f"xg_{s}") - 0.087, F.lit(0.05)) for s in ("home", "away")})
