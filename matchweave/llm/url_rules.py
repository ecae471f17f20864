"""URL filtering by a sorted sweep over reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchweave.llm.common import written

RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Sorts before every character of a host, and its successor.
SEPARATOR, SUCCESSOR = "\x01", "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a DataFrame (verdict, rule_host, rule_path)."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by the separator: a domain's key is a prefix of its subdomains' keys."""
    return F.concat(F.concat_ws(SEPARATOR, F.reverse(F.split(host, r"\.", -1))), F.lit(SEPARATOR))


def segments(rules: DataFrame) -> DataFrame:
    """Flatten the rules' nested key intervals: (start, stack) from each interval boundary on.

    Every rule host is the interval [key, successor). A boundary's stack holds all rules whose
    interval covers it: those of the host itself and of its parents, which the key's own prefixes
    name, so that the nesting is resolved by an equi-join on prefixes instead of a pairwise test.
    """
    hosts = (
        rules.where("rule_host is not null and rule_path is not null and verdict is not null")
        .select(
            host_key(F.col("rule_host")).alias("key"),
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                F.length("rule_host").alias("host_size"),
                "rule_host",
                "rule_path",
                "verdict",
            ).alias("one"),
        )
        .groupBy("key")
        .agg(F.collect_set("one").alias("own"))
    )
    ends = hosts.select(
        "key", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit(SUCCESSOR)).alias("start"), F.lit(1).alias("closed")
    )
    marks = hosts.select("key", F.col("key").alias("start"), F.lit(0).alias("closed")).unionAll(ends)
    labels = F.split("key", SEPARATOR, -1)
    depth = F.size(labels) - 1 - F.col("closed")
    prefixes = marks.where(depth > 0).select(
        "start",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), depth),
                lambda k: F.concat(F.array_join(F.slice(labels, 1, k), SEPARATOR), F.lit(SEPARATOR)),
            )
        ).alias("prefix"),
    )
    active = (
        prefixes.join(hosts.withColumnRenamed("key", "prefix"), "prefix")
        .groupBy("start")
        .agg(F.flatten(F.collect_set("own")).alias("stack"))
    )
    return marks.select("start").distinct().join(active, "start", "left")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """pages(page_id, url) -> (page_id, host, path, rule, verdict); the longest fitting rule decides.

    A sort-merge range join: URLs and segment starts are range-partitioned together on the key (and
    on page_id, so that one very common host spreads over several partitions), each partition is
    swept in key order, and the last segment start at or before a URL gives its stack of active
    rules. A partition without an earlier start inherits the last one of the partitions before it;
    those heads are one row for each partition. Equally long rules: the longer host wins, then the
    larger strings.

    Null urls, and urls without ://, have an empty host and path, fit no rule and get `otherwise`.
    Repeated rows are judged one by one. With no rules every verdict is `otherwise`.
    """
    urls = pages.select(
        F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    ).select("page_id", "host", "path", host_key(F.col("host")).alias("key"))
    starts = segments(rules)
    none = F.lit(None)
    stack_type = starts.schema["stack"].dataType
    kind = F.struct(F.col("start"), F.coalesce("stack", F.array().cast(stack_type)).alias("stack"))
    merged = urls.select("page_id", "host", "path", "key", F.lit(1).alias("is_url"), none.cast("string").alias("start"), none.cast(stack_type).alias("stack")).unionAll(
        starts.select(none.cast(pages.schema["page_id"].dataType), none.cast("string"), none.cast("string"), F.col("start"), F.lit(0), "start", "stack")
    )
    dealt = written(merged.repartitionByRange("key", "is_url", "page_id").withColumn("cell", F.spark_partition_id()))
    sweep = W.partitionBy("cell").orderBy("key", "is_url", "page_id")
    carried = (
        dealt.groupBy("cell")
        .agg(F.max_by(F.when(F.col("is_url") == 0, kind), F.when(F.col("is_url") == 0, F.col("start"))).alias("last"))
        .select("cell", F.last("last", ignorenulls=True).over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)).alias("tail"))
    )
    swept = dealt.withColumn(
        "segment", F.last(F.when(F.col("is_url") == 0, kind), ignorenulls=True).over(sweep)
    ).where("is_url = 1")
    found = swept.join(F.broadcast(carried), "cell", "left").withColumn("active", F.coalesce("segment.stack", "tail.stack"))
    fits = F.filter(
        "active",
        lambda r: ((F.col("host") == r["rule_host"]) | F.col("host").endswith(F.concat(F.lit("."), r["rule_host"])))
        & F.col("path").startswith(r["rule_path"]),
    )
    best = F.array_max(fits)
    return found.select("page_id", "host", "path", best.alias("best")).select(
        "page_id",
        "host",
        "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, deciding rule and verdict of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP5_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), f AS (
  SELECT h.page_id, r.*, row_number() OVER (PARTITION BY h.page_id ORDER BY length(rule_host || rule_path) DESC) AS k
  FROM h JOIN r ON (h.host = r.rule_host OR suffix(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)
)
SELECT h.page_id, h.host, h.path, f.rule_host || f.rule_path AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM h LEFT JOIN f ON f.page_id = h.page_id AND f.k = 1
"""
