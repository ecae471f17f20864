"""Corpus pipeline: five stages over documents, each written as Parquet and read again.

toxicity -> line dedup -> SimHash near-dedup -> benchmark decontamination -> mixing to target weights
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from matchweave.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among docs, doesn't reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of lines that occurred before.

    n_chars follows the new text. A document of which nothing but blank lines is left goes.
    """
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    cut = F.col("n_removed") > 0
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return found.where(~cut | left).select(
        *(F.when(cut, F.char_length("text")).otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else c for c in COLUMNS)
    )


def with_row_key(docs: DataFrame) -> DataFrame:
    """The written columns of documents with row_key: a row's own key, whatever its id."""
    return written(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates one row stays: that with the smallest id, one without an id last.

    Rows are told apart by a key of their own, so that repeated rows and rows without an id are judged as well.
    """
    rows = with_row_key(docs)
    groups = simhash.near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text"))
    ids = rows.select("row_key", "doc_id").join(groups.select(F.col("doc_id").alias("row_key"), "component_id"), "row_key")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key")
    keep = ids.groupBy("component_id").agg(F.min(first).alias("first")).select("first.row_key")
    return rows.join(keep, "row_key", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text is not contaminated with benchmark items, whatever their ids."""
    rows = with_row_key(docs)
    found = decontaminate.contamination(rows.select(F.col("row_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("row_key"))
    return rows.join(bad, "row_key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix of sources: mix_block, mix_slot and mix_place."""
    return mixing.mixed(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]
#: A trained model, XXH64 and components are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
