"""Toxicity by subword-bag embeddings under a linear softmax."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
FOLDS = 5
#: An odd 64-bit multiplier for the hashes of n-grams.
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id's text mod FOLDS is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def subwords(words: list[str], buckets: int, low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash bucket) of every marked word, or piece of one, and of each of its character n-grams."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    powers = np.cumprod(np.full(int(lengths.max()), MIX, dtype=np.uint64))
    hashed, owners = [np.add.reduceat(codes * powers[place], starts)], [np.arange(len(words))]
    gram, left = codes * MIX, lengths[owner] - place
    for n in range(2, high + 1):
        gram = gram[:-1] if len(gram) == len(codes) - n + 2 else gram
        gram = (gram ^ codes[n - 1 :]) * MIX
        if n >= low:
            inside = np.flatnonzero(left[: len(gram)] >= n)
            hashed.append(gram[inside] + np.uint64(n))
            owners.append(owner[inside])
    x = np.concatenate(hashed)
    x = (x ^ (x >> np.uint64(29))) * MIX
    return np.concatenate(owners), ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def distinct_words(text: str | None, longest: int = 64, overlap: int = 4) -> list[str]:
    """The distinct words of a text, marked at both ends.

    A longer run, as of a script without spaces, comes in pieces that overlap by one character less
    than the longest n-gram, so that every n-gram of it lies in a piece.
    """
    out: dict[str, None] = {}
    for word in set(WORD.findall((text or "").lower())):
        marked = f"<{word}>"
        if len(word) <= longest:
            out[marked] = None
        else:
            out.update((marked[k : k + longest], None) for k in range(0, len(marked) - overlap, longest - overlap))
    return list(out)


@dataclass
class Model:
    """Per subword bucket, its embedding times the difference of the two softmax rows."""

    bucket_logits: np.ndarray
    bias: float

    def word_logits(self, words: list[str], block: int = 50_000) -> np.ndarray:
        """The mean over each word's subwords."""
        out = [np.zeros(0)]
        for k in range(0, len(words), block):
            owner, bucket = subwords(words[k : k + block], len(self.bucket_logits))
            out.append(np.bincount(owner, weights=self.bucket_logits[bucket]) / np.bincount(owner))
        return np.concatenate(out)

    def scores(self, texts) -> np.ndarray:
        """Probabilities of the texts; each different word of the batch is looked up once."""
        number: dict[str, int] = {}
        bags = [[number.setdefault(w, len(number)) for w in distinct_words(t)] for t in texts]
        logits = self.word_logits(list(number))
        size = np.array([len(b) for b in bags], dtype=np.int64)
        row = np.repeat(np.arange(len(bags)), size)
        at = np.fromiter((x for b in bags for x in b), dtype=np.int64, count=int(size.sum()))
        total = np.bincount(row, weights=logits[at], minlength=len(bags)) / np.sqrt(np.maximum(size, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(
    texts,
    labels,
    weights=None,
    buckets: int = 1 << 17,
    dim: int = 8,
    epochs: int = 10,
    batch: int = 64,
    rate: float = 0.02,
    min_texts: int = 3,
    drop: float = 0.5,
    seed: int = 42,
) -> Model:
    """Train subword embeddings and the softmax jointly, by minibatch Adam in numpy.

    A word is the mean of its n-grams' embeddings, a text the sum of its distinct words' vectors over
    the square root of their number: an average, scaled so that long texts don't drown a few words.
    Buckets seen in under min_texts texts are left out, and a share `drop` of each bag per step.
    """
    y = np.asarray(labels, dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(buckets), 0.0 if len(y) == 0 else (30.0 if y[0] else -30.0))
    weight = np.ones(len(y)) if weights is None else np.asarray(weights, dtype=np.float64)
    weight = weight / weight.mean()
    bags = []
    for text in texts:
        words = sorted(distinct_words(text))
        owner, bucket = subwords(words, buckets)
        share = 1 / np.bincount(owner, minlength=len(words))[owner] / max(len(words), 1) ** 0.5
        at, where = np.unique(bucket.astype(np.int32), return_inverse=True)
        bags.append((at, np.bincount(where, weights=share, minlength=len(at)).astype(np.float32)))
    spread = np.bincount(np.concatenate([at for at, _ in bags]), minlength=buckets)
    bags = [(at[spread[at] >= min_texts], share[spread[at] >= min_texts]) for at, share in bags]
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (buckets, dim)).astype(np.float32), rng.normal(0, 0.5, (dim, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            step += 1
            part = order[k : k + batch]
            emb, soft, bias = params
            at = np.concatenate([bags[i][0] for i in part])
            share = np.concatenate([bags[i][1] for i in part])
            if drop:
                share = share * (rng.random(len(share)) >= drop) / (1 - drop)
            row = np.repeat(np.arange(len(part)), [len(bags[i][0]) for i in part])
            spread = emb[at] * share[:, None]
            rows = np.stack([np.bincount(row, weights=spread[:, d], minlength=len(part)) for d in range(dim)], axis=1)
            logits = rows @ soft + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            back = p * weight[part][:, None] / len(part)
            d_rows = (back @ soft.T)[row] * share[:, None]
            d_emb = np.stack([np.bincount(at, weights=d_rows[:, d], minlength=buckets) for d in range(dim)], axis=1)
            pace = rate * (1 - (step - 1) / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for j, grad in enumerate((d_emb, rows.T @ back, back.sum(axis=0))):
                m, v = moments[j]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                params[j] -= pace * m / (np.sqrt(v) + 1e-8)
    emb, soft, bias = params
    seen = np.zeros(buckets, dtype=bool)
    for at, _ in bags:
        seen[at] = True
    return Model(np.where(seen, emb @ (soft[:, 1] - soft[:, 0]), 0.0), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, **options) -> Model:
    """Fit on labelled rows outside the held-out fold: at most per_class of each class.

    The sample (the bound is per_class) takes the rows whose hashed ids are smallest, picked from ids
    and labels alone; only its texts travel. Weights go half way back to the classes' shares among all training rows. Only text and label reach the model.
    """
    taught = (
        docs.where("doc_id is not null")
        .select("doc_id")
        .join(labels.where("toxic in (0, 1)").select("doc_id", "toxic").dropDuplicates(["doc_id"]), "doc_id")
        .where(~held_out(F.col("doc_id")))
    )
    counts = {r.toxic: r.n for r in taught.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [
        r
        for c in sorted(counts)
        for r in taught.where(F.col("toxic") == c).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    ]
    if not picked:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame(picked, taught.schema)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).toPandas()
    sample = sample.sort_values("doc_id")
    size = sample["toxic"].value_counts().to_dict()
    weights = [(counts[t] / size[t]) ** 0.5 for t in sample["toxic"]]
    return fit(list(sample["text"]), list(sample["toxic"]), weights, **options)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> all columns, with score and predicted.

    Null and empty texts get the score of no words. Every row is scored by its whole text.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        for pdf in batches:
            pdf["score"] = model.scores(list(pdf["text"]))
            pdf["predicted"] = (pdf["score"] >= 0.5).astype("int32")
            yield pdf

    kept = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(run, f"{schema}, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
