"""Benchmark decontamination by a prefix-filtered join of word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: everything in ASCII but a-z, A-Z and 0-9. lowered() is applied to the words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    ascii_only = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def pieces(text: Column) -> Column:
    """The words of a text in order, not lower-cased, with an empty string for a gap at either end."""
    return F.split(F.coalesce(text, F.lit("")), GAP, -1)


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, window) for every run of `size` words of an item; a shorter item is one window."""
    found = items.select("item_id", F.transform(F.filter(pieces(F.col("text")), lambda x: x != ""), lowered).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size) + 1, F.lit(1)))
    return found.select(
        "item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("window")
    ).distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = 13,
    share: int = 20,
    broadcast_windows: int = 50_000,
) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    Words are ordered by how often they occur in all documents; each window's rarest word is its
    necessary prefix token, so only the positions of those words are looked at. A position fixes
    where the window would have to start; it must fit into the document (length and position
    bound) and is then compared word for word. Up to broadcast_windows windows (counted first) go to
    every task, and positions of prefix tokens are picked within each row; more windows are joined
    by shuffles, on the token and then on the document.

    Null texts have no words. Rows sharing an id are judged by their own texts; null ids are kept.
    Returns doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, one row per row of docs.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn(
        "text_key", F.xxhash64(F.coalesce("text", F.lit("")))
    )
    patterns = windows(items, size)
    count = patterns.count()
    narrow = count <= broadcast_windows

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if narrow else df

    vocabulary = patterns.select(F.explode("window").alias("word")).distinct()
    seen = (
        rows.select(F.explode(pieces(F.col("text"))).alias("raw"))
        .select(lowered(F.col("raw")).alias("word"))
        .join(side(vocabulary), "word", "left_semi")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    rarest = written(
        patterns.select("item_id", "window", F.posexplode("window").alias("offset", "word"))
        .join(seen, "word", "left")
        .groupBy("item_id", "window")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("token"))
        .where("token.n > 0")
        .groupBy("window", "token.word", "token.offset")
        .agg(F.collect_set("item_id").alias("item_ids"))
    )
    empty = F.lit(0).cast("int")
    ends = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(empty) + F.when(
        (F.size("w") > 1) & (F.get("w", F.size("w") - 1) == ""), 1
    ).otherwise(empty)
    tokens = rows.select("doc_id", "text_key", pieces(F.col("text")).alias("w")).withColumn(
        "n_words", (F.size("w") - ends).cast("long")
    )
    start, length = F.col("pos") - F.col("offset"), F.size("window")
    fits = (start >= 0) & (start + length <= F.col("n"))
    if narrow:
        prefix = [r.word for r in rarest.select("word").distinct().collect()]
        first = lambda i: F.greatest(i - F.lit(size - 1), F.lit(0))
        picked = F.filter(
            F.sequence(F.lit(0), F.size("w") - 1), lambda i: lowered(F.get("w", i)).isin(prefix) if prefix else F.lit(False)
        )
        scanned = written(
            tokens.select(
                "doc_id",
                "text_key",
                "n_words",
                F.size("w").alias("n"),
                F.transform(
                    picked,
                    lambda i: F.struct(
                        i.alias("pos"),
                        lowered(F.get("w", i)).alias("word"),
                        first(i).alias("first"),
                        F.transform(F.slice("w", first(i) + 1, 2 * size - 1), lowered).alias("near"),
                    ),
                ).alias("at"),
            )
        )
        counted = scanned.select("doc_id", "text_key", "n_words").alias("d")
        around = scanned.select("doc_id", "text_key", "n", F.explode("at").alias("at")).select(
            "doc_id", "text_key", "n", "at.*"
        )
        hits = around.join(F.broadcast(rarest), "word").where(
            fits & (F.slice("near", start - F.col("first") + 1, length) == F.col("window"))
        )
    else:
        ids = ["doc_id", "text_key"]
        candidates = (
            tokens.select(*ids, F.posexplode("w").alias("pos", "raw"))
            .withColumn("word", lowered(F.col("raw")))
            .join(rarest, "word")
            .drop("word", "raw")
            .alias("c")
        )
        counted = tokens.select("doc_id", "text_key", "n_words").alias("d")
        whole = tokens.dropDuplicates(ids).alias("t")
        hits = (
            candidates.join(whole, F.expr("c.doc_id <=> t.doc_id and c.text_key = t.text_key"))
            .select("c.*", "t.w", F.size("t.w").alias("n"))
            .where(fits & (F.transform(F.slice("w", start + 1, length), lowered) == F.col("window")))
        )
    spans = (
        hits.select("doc_id", "text_key", F.struct(start.alias("s"), (start + length).alias("e")).alias("span"), "item_ids")
        .groupBy("doc_id", "text_key")
        .agg(
            F.array_sort(F.collect_set("span")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("ids"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], x["e"]).alias("end"),
        ),
    )
    found = spans.select(
        "doc_id",
        "text_key",
        covered["n"].cast("long").alias("n_hit"),
        F.transform("ids", lambda i: i.cast("string")).alias("ids"),
    ).alias("h")
    joined = counted.join(found, F.expr("d.doc_id <=> h.doc_id and d.text_key = h.text_key"), "left")
    n_hit, ids = F.coalesce("h.n_hit", F.lit(0).cast("long")), F.coalesce("h.ids", F.array().cast("array<string>"))
    return joined.select(
        "d.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination figures of every document against the whole benchmark."""
    return contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


#: The verdict query, for any relation named documents (doc_id, text).
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + 12), ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), occ AS (
  SELECT p.doc_id, p.s, win.n, win.item_id
  FROM (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS key
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)) p
  JOIN win ON win.key = p.key AND win.n = p.n
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT doc_id, s, n FROM occ)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
