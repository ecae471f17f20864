"""SimHash near-duplicates by a self-join over binary tries."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.common import connected_components, union_pairs, written

BITS = 64
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_OFFSET = (256 * np.arange(8)).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: n - shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros((8, 256), dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k : k + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((part + _BYTE_OFFSET).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BYTE_BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row of docs; null texts count as empty."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t, shingle, seed) for t in pdf["text"]], np.int64)}
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        run, "doc_id long, fp long"
    )


def layouts(budget: int, blocks: int) -> list[tuple[list[int], int]]:
    """Bit orders for the tries, and how many leading bits of each must agree exactly.

    Of `blocks` runs of bits, a pair within the budget leaves blocks - budget runs untouched, so
    it meets under at least one of the returned orders.
    """
    edges = np.linspace(0, BITS, blocks + 1).round().astype(int)
    runs = [list(range(edges[k], edges[k + 1])) for k in range(blocks)]
    found = []
    for exact in combinations(range(blocks), blocks - budget):
        lead = [b for k in exact for b in runs[k]]
        found.append((lead + [b for k in range(blocks) if k not in exact for b in runs[k]], len(lead)))
    return found


def permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Each fingerprint with its bits rearranged: order[0] becomes the highest bit."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for k, bit in enumerate(order):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(BITS - 1 - k)
    return out


def trie_links(keys: np.ndarray, exact: int, budget: int, flush: int = 16):
    """Yield index arrays (i, j) of all pairs of sorted distinct keys that differ in <= budget bits
    and agree in the first `exact` bits.

    A trie node is a range of the sorted keys. Node pairs go down together, level by level, with
    the bits in which they differ so far; a pair over the budget ends there. Pairs of nodes with
    few leaves are compared leaf by leaf.
    """
    n = len(keys)
    if n < 2:
        return
    lead = keys >> np.uint64(BITS - exact)
    lo = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
    hi = np.r_[lo[1:], n]
    keep = hi - lo > 1
    a0, a1 = lo[keep], hi[keep]
    b0, b1, diff = a0, a1, np.zeros(len(a0), dtype=np.int8)
    for level in range(exact, BITS + 1):
        small = (a1 - a0) * (b1 - b0) <= flush if level < BITS else np.ones(len(a0), bool)
        yield from _leaf_pairs(keys, a0[small], a1[small], b0[small], b1[small], budget)
        a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            return
        ones = np.r_[0, np.cumsum((keys >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        down = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), (am, a1, b0, bm, diff + 1)]
        masks = [np.ones(len(a0), bool)] * 3 + [~own]
        a0, a1, b0, b1, diff = (np.concatenate([d[k][m] for d, m in zip(down, masks, strict=True)]) for k in range(5))
        lives = (diff <= budget) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, diff = (x[lives] for x in (a0, a1, b0, b1, diff))


def _leaf_pairs(keys, a0, a1, b0, b1, budget, chunk=1 << 20):
    sizes = (a1 - a0) * (b1 - b0)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), chunk)) + start)
        part = slice(start, stop)
        each = sizes[part]
        at = np.repeat(np.arange(len(each)), each)
        within = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        width = (b1 - b0)[part][at]
        i, j = a0[part][at] + within // width, b0[part][at] + within % width
        near = (i < j) | (a0[part][at] != b0[part][at])
        near &= np.bitwise_count(keys[i] ^ keys[j]) <= budget
        yield i[near], j[near]
        start = stop


def link_forest(nodes: np.ndarray, fps: np.ndarray, order: list[int], exact: int, budget: int):
    """(node, root) for the nodes linked within one trie; roots are the smallest nodes."""
    by_node = np.argsort(nodes, kind="stable")
    nodes, keys = nodes[by_node], permuted(fps[by_node].astype(np.int64).view(np.uint64), order)
    by_key = np.argsort(keys, kind="stable")
    label = np.arange(len(nodes))
    for i, j in trie_links(keys[by_key], exact, budget):
        label = union_pairs(label, by_key[i], by_key[j])
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def near_duplicates(
    docs: DataFrame, budget: int = 4, blocks: int | None = None, shingle: int = 4, seed: int = 42, group_rows: int = 20_000
) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, component_id): documents linked at <= budget differing bits.

    Rows with equal fingerprints are folded first, however many they are; the tries hold distinct
    fingerprints. Subtrees below the first bits of each bit order are the units of work. A unit of
    over group_rows fingerprints is split into sub-blocks, and one task takes each pair of them, so
    a task never holds more than two sub-blocks. Tasks return spanning forests instead of pairs.
    `blocks` sets the number of exact leading bits (budget + 1: one block of five); more blocks mean
    more copies and smaller subtrees, and never change the result. By default they follow the number
    of fingerprints, so that units of about group_rows suffice for all.

    Null and wordless texts have fingerprint 0 and link like any other; rows without an id get their
    fingerprint and no component; rows that share an id are one document for the links.
    """
    rows = written(fingerprints(docs, shingle, seed))
    nodes = written(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    n = nodes.count()
    blocks = blocks or next(b for b in range(budget + 1, 64) if b == 12 or n <= group_rows << (64 * (b - budget) // b))
    plans = layouts(budget, blocks)
    units = max(16, 1 << max(0, (n // 4096)).bit_length())

    def exact_hash(exact_bits: list[int]):
        mask = sum(1 << b for b in exact_bits)
        mask -= (mask >> 63) << 64
        return F.pmod(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask))), F.lit(units)).cast("int")

    placed = nodes.select(
        "node",
        "fp",
        F.posexplode(F.array(*(exact_hash(order[:exact]) for order, exact in plans))).alias("plan", "unit"),
    )
    sizes = placed.groupBy("plan", "unit").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("parts"))
    placed = placed.join(sizes, ["plan", "unit"]).withColumn(
        "part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    )
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "plan", "unit", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "node", "fp"
    )

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        order, exact = plans[int(pdf["plan"].iat[0])]
        node, root = link_forest(pdf["node"].to_numpy(), pdf["fp"].to_numpy(), order, exact, budget)
        return pd.DataFrame({"a": node, "b": root})

    edges = tasks.groupBy("plan", "unit", "p", "q").applyInPandas(forest, "a long, b long")
    groups = connected_components(edges)
    named = nodes.join(groups, nodes.node == groups.node, "left").select(
        "fp", F.coalesce("component", nodes.node).alias("component_id")
    )
    return rows.join(named, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
