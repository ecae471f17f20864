"""Repeated passages of lines, found by winnowing and deleted after their first occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchweave.llm.common import written

BLANKS = r"[\x20\x09-\x0D]+"


def line_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """docs(doc, text) -> (doc, start, stop, content, mark, mark_at): for every line, the shortest runs of lines with
    min_words words that begin with it and that end with it.

    Lines are compared without white space at their ends; blank lines are skipped. `content` holds
    two chains of independent hashes of the run's lines in the order they were taken (96 bits of each line), `mark` is the smallest line hash within it, the window minimum, and
    mark_at the position of its first line with it. A run holds at most min_words lines, as each
    line has a word at least.
    """
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        lambda x, i: F.struct(i.alias("pos"), F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("line")),
    )
    hashed = F.transform(
        F.filter("lines", lambda x: x["line"] != ""),
        lambda x: F.struct(
            x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("h"), F.hash(x["line"]).alias("g"), F.size(F.split(x["line"], BLANKS, -1)).alias("w")
        ),
    )

    def empty(way: int):
        return F.struct(
            F.lit(0).alias("words"),
            F.struct(F.lit(way).cast("long").alias("h"), F.lit(way).cast("long").alias("g")).alias("content"),
            F.struct(F.lit(2**63 - 1).alias("h"), F.lit(-1).alias("pos")).alias("least"),
            F.lit(-1).alias("end"),
        )

    def take(acc, x):
        more = F.struct(
            (acc["words"] + x["w"]).alias("words"),
            F.struct(F.xxhash64(acc["content"]["h"], x["h"]).alias("h"), F.xxhash64(acc["content"]["g"], x["g"]).alias("g")).alias("content"),
            F.least(acc["least"], F.struct(x["h"].alias("h"), x["pos"].alias("pos"))).alias("least"),
            x["pos"].alias("end"),
        )
        return F.when(acc["words"] >= min_words, acc).otherwise(more)

    def window(x, i):
        ahead = F.slice("hashed", i + 1, F.when(x["w"] >= min_words, F.lit(1)).otherwise(F.lit(min_words)))
        first = F.greatest(i - F.lit(min_words - 2), F.lit(1))
        behind = F.reverse(F.slice("hashed", F.when(x["w"] >= min_words, i + 1).otherwise(first), i + 2 - F.when(x["w"] >= min_words, i + 1).otherwise(first)))
        return F.array(
            F.struct(x["pos"].alias("pos"), F.aggregate(ahead, empty(0), take).alias("run")),
            F.struct(x["pos"].alias("pos"), F.aggregate(behind, empty(1), take).alias("run")),
        )

    return (
        docs.select("doc", lines.alias("lines"))
        .select("doc", hashed.alias("hashed"))
        .select("doc", F.explode(F.flatten(F.transform("hashed", window))).alias("x"))
        .where(F.col("x.run.words") >= min_words)
        .select(
            "doc",
            F.least("x.pos", "x.run.end").alias("start"),
            F.greatest("x.pos", "x.run.end").alias("stop"),
            F.col("x.run.content").alias("content"),
            F.col("x.run.least.h").alias("mark"),
            F.col("x.run.least.pos").alias("mark_at"),
        )
    )


def document_key(doc_id: Column, text: Column) -> Column:
    """What tells documents apart and orders them: the id, rows without one last, then the text's hash."""
    return F.struct(doc_id.isNull().alias("without"), doc_id.alias("id"), F.xxhash64(text).alias("text"))


def dedup_lines(docs: DataFrame, min_words: int = 50, salts: int = 8) -> DataFrame:
    """docs(doc_id, text, ...) -> the same rows with deduplicated text, n_lines and n_removed.

    A line goes if it lies in a run of consecutive lines of at least min_words words in all that
    already occurred: in a document with a smaller id, or further up in the same one. Winnowing
    finds those runs: every window of min_words words selects its minimal line hash, so that a
    repeated run shares a fingerprint with its first occurrence for certain. Fingerprints (document,
    position) without a second position fall away with their windows. At the positions left, a match
    reaches both ways: as far as the shortest windows that begin or end with a line are equal to earlier
    ones. Every line of a repeated run lies in such a window that the run holds; overlapping ones
    form the runs to delete.

    Null texts stay null with no lines. Rows that share an id but not their text are documents of their own, in the
    order of their texts' hashes; rows without an id come after all others. Rows equal in id and text are one document:
    what goes, goes in each of them. Blank lines inside a deleted
    run go with it. An empty text is one empty line. Extra columns are kept, whatever their names;
    text, n_lines and n_removed are replaced.
    """
    key = document_key(F.col("doc_id"), F.col("text").cast("string"))
    windows = written(line_windows(docs.select(key.alias("doc"), F.col("text").cast("string").alias("text")), min_words))
    marks = (
        windows.select("doc", "mark_at", "mark").distinct().groupBy("mark").agg(F.count("*").alias("n")).where("n > 1")
        .select("mark", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    shared = windows.withColumn("salt", F.pmod(F.hash("doc"), F.lit(salts))).join(marks, ["mark", "salt"], "left_semi")
    first = (
        shared.groupBy("content")
        .agg(F.min(F.struct("doc", "start")).alias("first"), F.max(F.struct("doc", "start")).alias("last"))
        .where("first < last")
        .select("content", "first")
    )
    later = shared.join(first, "content").where(F.struct("doc", "start") > F.col("first"))
    upto = F.max("stop").over(W.partitionBy("doc").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1))
    pieces = (
        later.select("doc", "start", "stop").distinct()
        .select("doc", F.greatest("start", F.coalesce(upto + 1, F.lit(0))).alias("start"), "stop")
        .where("start <= stop")
    )
    gone = pieces.groupBy(F.col("doc").alias("gone_doc")).agg(F.flatten(F.collect_list(F.sequence("start", "stop"))).alias("gone"))
    new = ["text", "n_lines", "n_removed"]
    others = {c: f"given_{k}" for k, c in enumerate(docs.columns) if c not in new}
    given = docs.select(key.alias("doc"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(k) for c, k in others.items()))
    found = given.join(gone, F.expr("doc = gone_doc"), "left").select("text", *others.values(), "gone", F.split("text", "\n", -1).alias("split"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "gone")
    text = F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("split", i)), "\n")
    )
    gaps = F.when(F.col("text").isNull(), F.lit(0))
    done = found.select(
        *others.values(),
        text.alias("text"),
        gaps.otherwise(F.size("split")).cast("long").alias("n_lines"),
        gaps.otherwise(F.coalesce(F.size("gone"), F.lit(0))).cast("long").alias("n_removed"),
    )
    return done.select(*(F.col(k).alias(c) for c, k in others.items()), *new)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, deduplicated text, n_lines and n_removed of every document."""
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


#: Every shortest run of 50 words, on from a line and back from it, against every earlier one by its lines; no winnowing.
OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, trim(line, E' \t\n\x0B\f\r') AS line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
), w AS (
  SELECT doc_id, pos, line, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, n,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM (SELECT *, len(string_split_regex(line, '[ \t\n\x0B\f\r]+')) AS n FROM l WHERE line <> '')
), span AS (
  SELECT 'on' AS way, a.doc_id, a.k, min(b.k) AS last FROM w a JOIN w b
    ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 AND b.upto >= a.upto - a.n + 50 GROUP BY a.doc_id, a.k
  UNION ALL
  SELECT 'back', b.doc_id, max(a.k), b.k FROM w a JOIN w b
    ON a.doc_id = b.doc_id AND a.k BETWEEN b.k - 49 AND b.k AND b.upto >= a.upto - a.n + 50 GROUP BY b.doc_id, b.k
), win AS (
  SELECT s.way, s.doc_id, min(w.pos) AS start, max(w.pos) AS stop, string_agg(w.line, chr(10) ORDER BY w.k) AS content
  FROM span s JOIN w ON w.doc_id = s.doc_id AND w.k BETWEEN s.k AND s.last GROUP BY s.way, s.doc_id, s.k, s.last
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY way, content ORDER BY doc_id, start) AS r FROM win) WHERE r > 1
), kept AS (
  SELECT r.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN r.raw END, chr(10) ORDER BY r.pos), '') AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) r
  LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.pos = r.pos GROUP BY r.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
