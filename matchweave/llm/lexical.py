"""Ranked lexical search of many items at once, with what the items share worked out once for each document."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchweave.llm.common import by_bytes, discard, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMALL = str.maketrans(UPPER, LOWER)


def terms_of(text: str | None) -> list[str]:
    """All terms of a text in order, only A-Z lower-cased; none of a null text."""
    return [t.translate(SMALL) for t in re.findall(TERM, text or "")]


@dataclass
class SharingPlan:
    """How the scores of a block of items are put together from what they share.

    A term that an item holds r times stands in its set as (term, 1) to (term, r). Terms with the same items are one
    leaf, whose accumulator is the sum of their parts of the score. Each further node adds two earlier ones that stand
    side by side in several items; an item's score is the sum of its tops.
    """

    terms: dict[str, int]
    leaves: list[list[int]]
    n_leaves: int
    sums: list[tuple[int, int]]
    tops: list[list[int]]

    @classmethod
    def mine(cls, items: list[list[str]]) -> SharingPlan:
        """Mine the shared sets of items' terms.

        Leaves are ordered by the number of their items in each item's list; neighbours that several lists have in
        common become a node, the pair in most lists first, until no pair of neighbours is shared. A round is linear in
        the lists' length.
        """
        holders: dict[tuple[str, int], list[int]] = defaultdict(list)
        for k, terms in enumerate(items):
            for term, times in Counter(terms).items():
                for r in range(times):
                    holders[term, r].append(k)
        ids: dict[tuple[int, ...], int] = {}
        terms: dict[str, int] = {}
        leaves: list[list[int]] = []
        for (term, _), held in holders.items():
            at = terms.setdefault(term, len(terms))
            if at == len(leaves):
                leaves.append([])
            leaves[at].append(ids.setdefault(tuple(held), len(ids)))
        tops: list[list[int]] = [[] for _ in items]
        for held, leaf in sorted(ids.items(), key=lambda x: (-len(x[0]), x[1])):
            for k in held:
                tops[k].append(leaf)
        n, sums = len(ids), []
        while True:
            often = Counter(p for row in tops for p in zip(row, row[1:], strict=False))
            named: dict[tuple[int, int], int] = {}
            for row in tops:
                k = 0
                while k < len(row) - 1:
                    pair = (row[k], row[k + 1])
                    ahead = often[row[k + 1], row[k + 2]] if k + 2 < len(row) else 0
                    if often[pair] > 1 and often[pair] >= ahead:
                        if pair not in named:
                            named[pair] = n + len(sums)
                            sums.append(pair)
                        row[k : k + 2] = [named[pair]]
                    k += 1
            if not named:
                return cls(terms, leaves, n, sums, tops)

    def scores(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, n_docs: int) -> np.ndarray:
        """Scores of items (rows) for documents (columns), from each document's parts of the score by term."""
        nodes = np.zeros((self.n_leaves + len(self.sums), n_docs), dtype=np.int64)
        if not hasattr(self, "_flat"):
            self._sizes = np.array([len(x) for x in self.leaves], dtype=np.int64)
            self._starts = np.cumsum(self._sizes) - self._sizes
            self._flat = np.array([leaf for x in self.leaves for leaf in x], dtype=np.int64)
        times = self._sizes[term]
        at = np.repeat(np.arange(len(term)), times)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        np.add.at(nodes, (self._flat[self._starts[term[at]] + nth], doc[at]), part[at])
        for k, (a, b) in enumerate(self.sums, self.n_leaves):
            np.add(nodes[a], nodes[b], out=nodes[k])
        found = np.zeros((len(self.tops), n_docs), dtype=np.int64)
        for k, row in enumerate(self.tops):
            for node in row:
                found[k] += nodes[node]
        return found


def postings(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, terms, times): a document's number of terms and those of the vocabulary."""

    def run(batches):
        find = re.compile(TERM).findall
        for batch in by_bytes(batches, "text"):
            n, sizes, ids, times = [], [0], [], []
            for text in batch.column("text").to_pylist():
                counts = Counter(find(text or ""))
                mine: dict[int, int] = {}
                for term, tf in counts.items():
                    k = terms.get(term)
                    if k is None:
                        k = terms.get(term.translate(SMALL))
                    if k is not None:
                        mine[k] = mine.get(k, 0) + tf
                n.append(counts.total())
                ids.extend(mine)
                times.extend(mine.values())
                sizes.append(len(ids))
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "times"],
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Places of the top scores of each item, equal ones by ascending document."""
    order = np.lexsort((doc, -score, item))
    rank = np.arange(len(order)) - np.searchsorted(item[order], item[order], side="left")
    return order[rank < top]


def block_ranking(docs: DataFrame, items: list, top: int, cells: int) -> DataFrame | None:
    """(item_id, doc_id, score): candidates for the top of each item of a block, those of every task's documents."""
    spark = docs.sparkSession
    plan = SharingPlan.mine([terms_of(r.text) for r in items])
    if not plan.terms:
        return None
    found = written(postings(docs, plan.terms))
    total = found.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total.docs:
        discard(found)
        return None
    df = found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weight = np.zeros(len(plan.terms), dtype=np.int64)
    for r in df:
        weight[r.term] = floor(1000 * log((2 * total.docs + 2) / (2 * r["count"] + 1)))
    n_docs, n_terms = total.docs, total.terms
    width = max(16, cells // (plan.n_leaves + len(plan.sums) + len(items)))
    shared = spark.sparkContext.broadcast((plan, weight))

    def run(batches):
        plan, weight = shared.value
        item, score, doc = (np.empty(0, dtype=np.int64) for _ in range(3))
        floor_of = np.ones(len(plan.tops), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, width):
                rows = batch.slice(start, width)
                lists, ids = rows.column("terms"), rows.column("doc_id").to_numpy(zero_copy_only=False)
                size = np.diff(lists.offsets.to_numpy())
                term = lists.flatten().to_numpy().astype(np.int64)
                tf = rows.column("times").flatten().to_numpy()
                at = np.repeat(np.arange(rows.num_rows), size)
                m = 25 + (75 * n_docs * rows.column("n").to_numpy()) // n_terms
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
                scores = plan.scores(at, term, part, rows.num_rows)
                i, d = np.nonzero(scores >= floor_of[:, None])
                item = np.concatenate([item, i])
                score, doc = np.concatenate([score, scores[i, d]]), np.concatenate([doc, ids[d].astype(np.int64)])
                keep = best(item, score, doc, top)
                item, score, doc = item[keep], score[keep], doc[keep]
                full = np.bincount(item, minlength=len(floor_of)) >= top
                lowest = np.full(len(floor_of), np.iinfo(np.int64).max)
                np.minimum.at(lowest, item, score)
                floor_of = np.where(full, lowest, 1)
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc), pa.array(score)], names=["item", "doc_id", "score"])

    rows = found.where("doc_id is not null and size(terms) > 0").mapInArrow(run, "item long, doc_id long, score long")
    names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(items)], "item long, item_id long")
    return rows.join(F.broadcast(names), "item")


def ranked(docs: DataFrame, items: DataFrame, top: int = 10, block_terms: int = 50_000, cells: int = 8_000_000) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (item_id, rank, doc_id, score): each item's top documents by score.

    A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), of N documents with a term; a document of n terms, of L
    in all, scores w * ((10^9 tf) div (1000 tf + 8 m)) with m = 25 + (75 n N) div L, summed over an item's terms with
    their repeats. Documents scoring 0 aren't listed; equal scores come by ascending doc_id.

    Items are the stated query set: they are taken in blocks of about block_terms terms, and each block reads all
    documents. Its sharing plan, of a block's size, goes to every task; postings of the block's terms are written once,
    and a task holds the accumulators of so many documents that they stay below about `cells` numbers, and each item's
    best rows. Counts and statistics cover all documents. Every row counts as a document or an item of its own. A null or
    term-free text has no terms; rows without a doc_id count in the statistics but aren't listed.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = asked.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    keyed = asked.where("text is not null").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    parts = []
    for k in range(blocks):
        rows = keyed.where(F.col("block") == k).orderBy("item_id", "text").collect()
        part = block_ranking(docs, rows, top, cells) if rows else None
        if part is not None:
            parts.append(part.withColumn("block", F.lit(k)))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    place = F.row_number().over(W.partitionBy("block", "item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id and score of each benchmark item's 10 best documents."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms
  FROM documents WHERE text IS NOT NULL
), total AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM doc WHERE len(terms) > 0
), item AS (
  SELECT k, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
    FROM benchmark WHERE text IS NOT NULL) GROUP BY k, item_id, term
), posting AS (
  SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(terms) AS n, unnest(terms) AS term FROM doc)
  WHERE term IN (SELECT term FROM item) GROUP BY k, doc_id, n, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), total
), part AS (
  SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS part
  FROM posting JOIN weight USING (term), total
), scored AS (
  SELECT i.k AS item, i.item_id, p.k, p.doc_id, sum(i.times * p.part)::BIGINT AS score
  FROM item i JOIN part p USING (term) WHERE p.doc_id IS NOT NULL GROUP BY i.k, i.item_id, p.k, p.doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""
