"""Interleaving sources by target weight with Pfair scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchweave.llm.common import written


def shares(sizes: dict, period: int, power: float = 0.5, weights: dict | None = None) -> dict:
    """Whole slots per period for each source, by largest remainder, at least one each.

    Without given weights a source's weight is its size to the given power: between 0 (all sources
    alike) and 1 (in proportion to size).
    """
    weight = {s: (weights.get(s, 0) if weights else n**power) for s, n in sizes.items()}
    total = sum(weight.values())
    exact = {s: max(w * period / total if total else period / len(weight), 1.0) for s, w in weight.items()}
    scale = period / sum(exact.values()) if exact else 1
    exact = {s: max(x * scale, 1.0) for s, x in exact.items()}
    out = {s: int(x) for s, x in exact.items()}
    if not exact:
        return {}
    order = sorted(exact, key=lambda s: (-(exact[s] - out[s]), str(s)))
    short = period - sum(out.values())
    for k in range(max(short, 0)):
        out[order[k % len(order)]] += 1
    largest = [(-n, s) for s, n in out.items()] if short < 0 else []
    heapq.heapify(largest)
    for _ in range(-short):
        n, s = heapq.heappop(largest)
        out[s] = -n - 1
        heapq.heappush(largest, (n + 1, s))
    return out


def pfair_slots(slots: dict) -> Iterator[tuple[object, int, int]]:
    """(source, block, slot) over one period of sum(slots) slots, earliest deadline first.

    Block j of a source with share n of P slots may run from slot floor(j * P / n) on and must run
    before slot ceil((j + 1) * P / n). As the shares add up to P, every deadline is met and each
    source is always within one block of its ideal progress.
    """
    period = sum(slots.values())
    waiting = sorted((0, -(-period // n), str(s), 0, k) for k, (s, n) in enumerate(slots.items()))
    names, counts = list(slots), list(slots.values())
    ready: list = []
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, deadline, label, j, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, label, j, k))
        deadline, label, j, k = heapq.heappop(ready)
        yield names[k], j, slot
        if j + 1 < counts[k]:
            n = counts[k]
            heapq.heappush(waiting, ((j + 1) * period // n, -(-(j + 2) * period // n), label, j + 1, k))


def schedule(sizes: DataFrame, period: int, power: float, weights: dict | None) -> DataFrame:
    """sizes(source, n) -> (source, share, block, slot): one period's slots, share of them to each source.

    The list of sources, one row each, goes to one task, which yields the slots as it makes them.
    """
    def run(batches):
        frames = list(batches)
        if not frames:
            return
        listed = pd.concat(frames).sort_values("source")
        slots = shares(dict(zip(listed["source"], listed["n"].tolist(), strict=True)), max(period, 4 * len(listed)), power, weights)
        rows = ((s, slots[s], j, slot) for s, j, slot in pfair_slots(slots))
        while part := list(islice(rows, 100_000)):
            yield pd.DataFrame(part, columns=["source", "share", "block", "slot"])

    return written(sizes.repartition(1).mapInPandas(run, "source string, share long, block long, slot long"))


def ranked(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(source, doc_id, text, ...) -> all but these two, with rank: the row's place in its source by the MD5 of its id.

    Rows are counted per source and hash bucket; a running sum over the buckets plus the place
    within the bucket gives the rank, so that no source is ever sorted in one task. Rows without an
    id take the MD5 of their text, so that they spread as well.
    """
    others = [c for c in docs.columns if c not in ("source", "doc_id", "text")]
    keyed = docs.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")))).withColumn(
        "bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int")
    )
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("source", "bucket").agg(F.count("*").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "mark")
    placed = keyed.select("source", "bucket", "key", "doc_id", F.xxhash64("text").alias("mark"), *others).withColumn("place", F.row_number().over(within))
    return placed.join(offsets, ["source", "bucket"]).select("source", *others, (F.col("offset") + F.col("place") - 1).alias("rank"))


def mixed(
    docs: DataFrame, weights: dict | None = None, power: float = 0.5, block: int = 8, period: int = 1000, bucket_rows: int = 4096
) -> DataFrame:
    """docs(doc_id, text, source, ...) -> the same rows with mix_block, mix_slot and mix_place.

    Each source's rows, in the order of their ids' MD5, form blocks of `block` rows. Pfair
    scheduling gives every block a release time and a deadline from the source's target weight, and
    earliest-deadline-first lays out one period of slots; block j of a source with n slots a period
    takes the slot of block j mod n in period j div n. Sorting by (mix_slot, mix_place) is the mix.
    While all sources last, each is within one block of its weight at any point. A source that is
    used up leaves its slots empty; no row is dropped or repeated. The period grows to at least four
    slots for each source. There may be any number of sources: their list, one row each, is what one
    task lays out; the driver sees only the number of rows and of slots.

    Null sources are one source of their own; rows repeat and tie freely. Given weights, sources not
    named get one slot a period. Extra columns are kept, whatever their names; an empty table gives an empty table.
    """
    new = ["mix_block", "mix_slot", "mix_place"]
    others = {c: f"given_{k}" for k, c in enumerate(docs.columns) if c not in new}
    tagged = docs.select(
        F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null")).alias("source"),
        "doc_id",
        F.col("text").cast("string").alias("text"),
        *(F.col(f"`{c}`").alias(k) for c, k in others.items()),
    )
    named = {f"s:{k}" if k is not None else "null": v for k, v in weights.items()} if weights else None
    sizes = written(tagged.groupBy("source").agg(F.count("*").alias("n")))
    layout = schedule(sizes, period, power, named)
    total, length = sizes.agg(F.sum("n")).first()[0] or 0, layout.count() or 1
    rows = ranked(tagged, max(1, -(-total // bucket_rows))).withColumn("nth", F.floor(F.col("rank") / block).cast("long"))
    share = layout.where("block = 0").select("source", "share")
    found = rows.join(share, "source").withColumn("block", F.col("nth") % F.col("share")).join(layout.select("source", "block", "slot"), ["source", "block"])
    done = found.select(
        *others.values(),
        F.col("nth").alias("mix_block"),
        (F.floor(F.col("nth") / F.col("share")).cast("long") * length + F.col("slot")).alias("mix_slot"),
        (F.col("rank") % block).cast("long").alias("mix_place"),
    )
    return done.select(*(F.col(k).alias(c) for c, k in others.items()), *new)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, mix_block, mix_slot and mix_place of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_place")


#: Shares by largest remainder, then the earliest-deadline-first rule slot by slot.
OP9_SQL = r"""
WITH RECURSIVE src AS (
  SELECT coalesce('s:' || source, 'null') AS s, count(*) AS n FROM documents GROUP BY 1
), ex AS (
  SELECT s, sqrt(n) * 1000 / (SELECT sum(sqrt(n)) FROM src) AS x FROM src
), fl AS (
  SELECT s, floor(x)::BIGINT AS f, row_number() OVER (ORDER BY x - floor(x) DESC, s) AS r FROM ex
), sh AS (
  SELECT s, f + (r <= 1000 - (SELECT sum(f) FROM fl))::BIGINT AS n FROM fl
), edf AS (
  SELECT 0 AS slot, NULL::VARCHAR AS run, map_from_entries(list((s, 0::BIGINT))) AS done FROM sh
  UNION ALL
  SELECT e.slot + 1, p.s, map_from_entries(list_transform(map_entries(e.done), lambda q: (q.key, q.value + (q.key = p.s)::BIGINT)))
  FROM edf e, LATERAL (
    SELECT sh.s FROM sh WHERE e.done[sh.s] < sh.n AND (e.done[sh.s] * 1000) // sh.n <= e.slot
    ORDER BY ((e.done[sh.s] + 1) * 1000 + sh.n - 1) // sh.n, sh.s LIMIT 1) p
  WHERE e.slot < 1000
), lay AS (
  SELECT run AS s, slot - 1 AS slot, row_number() OVER (PARTITION BY run ORDER BY slot) - 1 AS j FROM edf WHERE run IS NOT NULL
), d AS (
  SELECT doc_id, source, coalesce('s:' || source, 'null') AS s,
         row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS k FROM documents
)
SELECT d.doc_id, d.source, d.k // 8 AS mix_block, ((d.k // 8) // sh.n) * 1000 + lay.slot AS mix_slot, d.k % 8 AS mix_place
FROM d JOIN sh ON sh.s = d.s JOIN lay ON lay.s = d.s AND lay.j = (d.k // 8) % sh.n
"""
