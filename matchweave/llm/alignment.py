"""How two tokenizers cut the same texts: aligned groups, and pairs counted by external runs."""

from __future__ import annotations

import json
import os
import re
from heapq import merge
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tiktoken import Encoding
from tokenizers import Tokenizer
from zstandard import ZstdCompressor, ZstdDecompressor

from matchweave.llm.common import by_bytes, discard, schema_with, written

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: A single space between two other characters: both tokenizers begin a token with it, whatever stands around.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Spaces at which a text may not be cut: beside other white space, or at an end.
UNCUT = re.compile(r"\s | \s|\A | \Z")
SHIFT = 26
#: Radix classes of the first tokenizer's ids.
RADIX = 64
DOC = "row_key long, n_a long, n_b long, n_groups long, n_links long, groups string"
RUN = "radix int, run long, records long, pairs binary, rows binary"


def byte_values() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


#: Characters whose classes all versions of Unicode agree on.
LATIN = re.compile(r"[ -~\n\t\u00a1-\u00ac\u00ae-\u024f]*")


def ranked(tool: Tokenizer, ids: dict[bytes, int]) -> Encoding | None:
    """The tokenizer's merges as ranks, if it is byte-level with the usual pattern and ids in the order of merges."""
    spec = json.loads(tool.to_str())
    before, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec["normalizer"]
    value = byte_values()
    merged = [bytes(value[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges", [])]
    if not plain or model.get("ignore_merges") or [ids.get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    return Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})


class Aligner:
    """Cuts texts with both tokenizers and groups their tokens by common ends.

    Texts are taken in parts between single spaces, at which both always begin a token, so that groups never reach
    across; a part's groups are kept for the next one, about `remembered` parts of at most 48 characters.
    """

    def __init__(self, first: str = BYTES, second: str = PIECES, remembered: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=second)
        value = byte_values()
        self.a_bytes = {k: bytes(value[c] for c in t) for t, k in self.a.get_vocab(with_added_tokens=False).items()}
        self.ranked = ranked(self.a, {v: k for k, v in self.a_bytes.items()})
        n = self.b.vocab_size()
        names = [self.b.id_to_piece(k) for k in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.a_size = np.array([len(self.a_bytes.get(k, b"")) for k in range(max(self.a_bytes) + 1)], dtype=np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), dtype=np.int64)
        self.known: dict[str, tuple | None] = {}
        self.remembered = remembered

    def groups(self, parts: list[str], a: list[list[int]], b: list[list[int]]) -> list[tuple | None]:
        """For each part: numbers of tokens, groups and links, the groups as text, linked pairs as int64 bytes, and how
        often each is linked where one is more than once.

        None where the joined tokens differ from the part. Ends of all parts are compared at once, as offsets in their
        concatenation; a group's links are listed, or counted by their ids where there are over 4,096.
        """
        def joined(names: dict | list, ids: list[list[int]]) -> list[bytes]:
            return [b"".join(map(names.__getitem__, x)) for x in ids]

        good = [k for k, (p, x, y) in enumerate(zip(parts, joined(self.a_bytes, a), joined(self.b_bytes, b), strict=True)) if x == y == p.encode()]
        out: list[tuple | None] = [None] * len(parts)
        if not good:
            return out
        n_a, n_b = (np.array([len(x[k]) for k in good], dtype=np.int64) for x in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x[k] for k in good), dtype=np.int64) for x in (a, b))
        end_a, end_b = self.a_size[flat_a].cumsum(), self.b_size[flat_b].cumsum()
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        held_a, held_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        start_a, start_b = held_a.cumsum() - held_a, held_b.cumsum() - held_b
        owner = np.searchsorted(end_a[n_a.cumsum() - 1], common)
        links = held_a * held_b
        width = np.where(links <= 4096, held_b, 0)[group_a]
        left = np.repeat(np.arange(len(flat_a)), width)
        nth = np.arange(len(left)) - np.repeat(width.cumsum() - width, width)
        pair = flat_a[left] << SHIFT | flat_b[start_b[group_a[left]] + nth]
        of, times = owner[group_a[left]], np.ones(len(pair), dtype=np.int64)
        for g in np.flatnonzero(links > 4096):
            x, p = np.unique(flat_a[start_a[g] : start_a[g] + held_a[g]], return_counts=True)
            y, q = np.unique(flat_b[start_b[g] : start_b[g] + held_b[g]], return_counts=True)
            pair = np.concatenate([pair, (x[:, None] << SHIFT | y).ravel()])
            times, of = np.concatenate([times, np.outer(p, q).ravel()]), np.concatenate([of, np.full(len(x) * len(y), owner[g])])
        order = np.argsort(of, kind="stable")
        pairs, often = pair[order].tobytes(), times[order]
        several = np.zeros(len(good), dtype=bool)
        several[of[times > 1]] = True
        to = np.bincount(of, minlength=len(good)).cumsum().tolist()
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        texts = [
            f"{text_a[i]}|{text_b[j]}" if p == q == 1 else f"{','.join(text_a[i : i + p])}|{','.join(text_b[j : j + q])}"
            for i, p, j, q in zip(start_a.tolist(), held_a.tolist(), start_b.tolist(), held_b.tolist(), strict=True)
        ]
        n_groups = np.bincount(owner, minlength=len(good))
        n_links = np.zeros(len(good), dtype=np.int64)
        np.add.at(n_links, owner, links)
        ends = n_groups.cumsum().tolist()
        from_pair = from_group = 0
        for k, x, y, g, n, end, upto, some in zip(good, n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), ends, to, several.tolist(), strict=True):
            out[k] = (x, y, g, n, ";".join(texts[from_group:end]), pairs[8 * from_pair : 8 * upto], often[from_pair:upto].copy() if some else None)
            from_group, from_pair = end, upto
        return out

    def cut(self, text: str | None) -> list[str]:
        """Parts of a space and the text, each without the space it begins with; none where no tokens are to be."""
        if not text or "▁" in text:
            return []
        return [p[1:] for p in CUT.split(" " + text)] if UNCUT.search(text) else text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Keep the groups of new parts."""
        for k in range(0, len(new), 8192):
            some = new[k : k + 8192]
            whole = [" " + p for p in some]
            self.known.update(zip(some, self.groups(whole, self.first_ids(whole), self.b.encode(some, num_threads=1)), strict=True))

    def first_ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of the first tokenizer. Parts of Latin letters and signs go through its merges as ranks, which is faster."""
        if self.ranked is None:
            return [x.ids for x in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        out = [self.ranked.encode_ordinary(p) if p.isascii() or LATIN.fullmatch(p) else None for p in parts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, x in zip(rest, self.a.encode_batch_fast([parts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def align(self, texts: list[str | None]):
        """Per text its numbers and groups; and per text and linked pair, in order of texts, how often.

        Returns (numbers int64[n, 4], groups list[str], text int64[], pair int64[], times int64[]).
        """
        if len(self.known) > self.remembered:
            self.known.clear()
        known, cut = self.known, [self.cut(t) for t in texts]
        parts = list(set(chain.from_iterable(cut)))
        new = [p for p in parts if p not in known]
        self.learn(new)
        bad = {p for p in parts if known[p] is None}
        if bad:
            cut = [row if bad.isdisjoint(row) else [] for row in cut]
            parts = [p for p in parts if p not in bad]
        place = dict(zip(parts, range(len(parts)), strict=True))
        sizes = np.array([len(row) for row in cut], dtype=np.int64)
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(sizes.sum()))
        found = [known[p] for p in parts]
        groups = [";".join([found[k][4] for k in row]) for row in np.split(at, sizes.cumsum()[:-1])]
        both, often = np.unique(np.repeat(np.arange(len(cut)) * max(len(parts), 1), sizes) + at, return_counts=True)
        text, at = both // max(len(parts), 1), both % max(len(parts), 1)
        table = np.array([f[:4] for f in found], dtype=np.int64).reshape(-1, 4)
        numbers = np.zeros((len(cut), 4), dtype=np.int64)
        np.add.at(numbers, text, table[at] * often[:, None])
        width = np.array([len(f[5]) for f in found], dtype=np.int64) // 8
        starts = width.cumsum() - width
        keys = np.frombuffer(b"".join([f[5] for f in found]), dtype=np.int64)
        times = np.ones(len(keys), dtype=np.int64)
        for k, f in enumerate(found):
            if f[6] is not None:
                times[starts[k] : starts[k] + width[k]] = f[6]
        per = width[at]
        where = np.repeat(starts[at] - (per.cumsum() - per), per) + np.arange(int(per.sum()))
        text, pair, times = np.repeat(text, per), keys[where], times[where] * np.repeat(often, per)
        order = np.argsort(text << 2 * SHIFT | pair) if len(cut) < 1 << 11 else np.lexsort((pair, text))
        text, pair, times = text[order], pair[order], times[order]
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])]) if len(text) else np.empty(0, dtype=np.int64)
        if len(first):
            text, pair, times = text[first], pair[first], np.add.reduceat(times, first)
        for p in new:
            if len(p) > 48:
                known.pop(p, None)
        return numbers, groups, text, pair, times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_at(first: str, second: str) -> Aligner:
    """The two tokenizers; a worker process loads them once."""
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays in one zstd frame, each in the smallest type that holds it."""
    out = [np.array([len(arrays)], dtype="<u4").tobytes()]
    for x in arrays:
        kind = next(k for k in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * k - (k == 8)))
        out += [np.array([kind, len(x)], dtype="<u4").tobytes(), x.astype(f"<u{kind}").tobytes()]
    return ZstdCompressor(level=3).compress(b"".join(out))


def unpacked(blob: bytes) -> list[np.ndarray]:
    data = ZstdDecompressor().decompress(blob)
    found, at = [], 4
    for _ in range(int.from_bytes(data[:4], "little")):
        kind, n = np.frombuffer(data, "<u4", 2, at).tolist()
        found.append(np.frombuffer(data, f"<u{kind}", n, at + 8).astype(np.int64))
        at += 8 + kind * n
    return found


def runs(row: np.ndarray, pair: np.ndarray, times: np.ndarray):
    """Records of a task as sorted runs, one for each radix class of the first id: by pair, then row.

    Yields (radix, first row, records, packed pairs with their numbers of rows, packed rows and times).
    """
    order = np.argsort((pair >> SHIFT) % RADIX << 2 * SHIFT | pair, kind="stable")
    row, pair, times = row[order], pair[order], times[order]
    radix = (pair >> SHIFT) % RADIX
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(radix)) + 1):
        if not len(part):
            continue
        keys, counts = np.unique(pair[part], return_counts=True)
        held, local = np.unique(row[part], return_inverse=True)
        yield int(radix[part[0]]), int(held[0]), len(part), packed(np.diff(keys, prepend=0), counts), packed(np.diff(held, prepend=0), local, times[part])


def aligned(docs: DataFrame, first: str = BYTES, second: str = PIECES, run_records: int = 1_000_000) -> DataFrame:
    """docs(text, ...) -> a row of its numbers and groups for each document, and rows of its task's runs.

    Rows with a null radix are documents: all columns but text, row_key, n_a, n_b, n_groups, n_links and groups. Others
    are runs: the task's (pair, document, times) records, spilled every run_records as zstd frames by radix class.
    A task holds the records of one run and one batch of about 2 MB of text.
    """
    given = {c: f"given_{k}" for k, c in enumerate(c for c in docs.columns if c != "text")}
    kept = docs.select(
        *(F.col(f"`{c}`").alias(k) for c, k in given.items()), F.monotonically_increasing_id().alias("row_key"), F.col("text").cast("string").alias("text")
    )
    schema = schema_with(kept.select(*given.values()), f"{DOC}, {RUN}")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(schema)
        tool, buffer, held = aligner_at(first, second), [], 0

        def spilled():
            rows = list(runs(*(np.concatenate(x) for x in zip(*buffer, strict=True))))
            columns = dict(zip(("radix", "run", "records", "pairs", "rows"), zip(*rows, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rows), f.type) for f in names], schema=names)

        for batch in by_bytes(batches, "text", 2 << 20):
            numbers, groups, text, pair, times = tool.align(batch.column("text").to_pylist())
            keys = batch.column("row_key").to_numpy()
            found = {k: pa.array(numbers[:, j]) for j, k in enumerate(("n_a", "n_b", "n_groups", "n_links"))} | {"groups": pa.array(groups, pa.string())}
            found |= {n: batch.column(n) for n in (*given.values(), "row_key")}
            yield pa.RecordBatch.from_arrays([found[f.name].cast(f.type) if f.name in found else pa.nulls(batch.num_rows, f.type) for f in names], schema=names)
            if len(text):
                buffer.append((keys[text], pair, times))
                held += len(text)
            if held >= run_records:
                yield spilled()
                buffer, held = [], 0
        if held:
            yield spilled()

    found = kept.mapInArrow(run, schema)
    found._given = given
    return found


def pairs_of(blob: bytes, block: int = 4096):
    """(pair, rows) of a run in order, a block at a time."""
    keys, counts = unpacked(blob)
    keys = np.cumsum(keys)
    for k in range(0, len(keys), block):
        yield from zip(keys[k : k + block].tolist(), counts[k : k + block].tolist(), strict=True)


def merged_counts(table: pa.Table) -> pa.Table:
    """Rows of each pair over the runs of one part of a radix class, by a heap merge of the runs."""
    keys, counts, last = [], [], None
    for key, n in merge(*(pairs_of(x.as_py()) for x in table.column("pairs"))):
        if key == last:
            counts[-1] += n
        else:
            keys.append(key)
            counts.append(n)
            last = key
    return pa.table({"pair": pa.array(keys, pa.int64()), "n": pa.array(counts, pa.int64())})


def contributions(runs_: pa.Table, counts: pa.Table) -> pa.Table:
    """What the records of one part of a radix class add to their rows, run by run in the order of pairs."""
    order = np.argsort(counts.column("pair").to_numpy())
    pair, n, best = (counts.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
    row, n_best, total = ([np.empty(0, dtype=np.int64)] for _ in range(3))
    for a, b in zip(runs_.column("pairs"), runs_.column("rows"), strict=True):
        keys, held = unpacked(a.as_py())
        rows, local, times = unpacked(b.as_py())
        at = np.searchsorted(pair, np.cumsum(keys))
        for out, value in ((total, n), (n_best, best.astype(np.int64))):
            summed = np.zeros(len(rows), dtype=np.int64)
            np.add.at(summed, local, np.repeat(value[at], held) * times)
            out.append(summed)
        row.append(np.cumsum(rows))
    return pa.table({k: pa.array(np.concatenate(v), pa.int64()) for k, v in (("row_key", row), ("n_best", n_best), ("count_sum", total))})


def counted(raw: DataFrame, part_records: int = 8_000_000) -> DataFrame:
    """aligned() -> its document rows with n_best and count_sum.

    The runs are written with the documents. Those of a radix class go to as many parts as keep a part below part_records
    and below twice the mean class; a part's runs are merged by a heap into partial numbers of documents by pair, which
    are added up; a first id's highest number follows from them. Then each part goes through its runs again, in
    the order of pairs, and sends back what they add to their documents. The numbers by pair are bounded by the
    vocabularies; a part by part_records, whatever the share of one pair or id.
    """
    spark, given = raw.sparkSession, raw._given
    table = written(raw)
    spilled = table.where("radix is not null")
    sizes = {r.radix: r.n for r in spilled.groupBy("radix").agg(F.sum("records").alias("n")).collect()}
    documents = table.where("radix is null").drop("radix", "run", "records", "pairs", "rows")
    if not sizes:
        found = documents.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    else:
        limit = max(1, min(part_records, 2 * sum(sizes.values()) // len(sizes)))
        parts = spark.createDataFrame([(k, -(-n // limit)) for k, n in sizes.items()], "radix int, parts int")
        dealt = spilled.join(F.broadcast(parts), "radix").withColumn("part", F.pmod(F.xxhash64("run"), "parts").cast("int"))
        partial = dealt.select("radix", "part", "pairs").groupBy("radix", "part").applyInArrow(merged_counts, "pair long, n long")
        counts = written(partial.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", SHIFT)))
        highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
        judged = (
            counts.join(highest, "a")
            .withColumn("radix", (F.col("a") % RADIX).cast("int"))
            .join(F.broadcast(parts), "radix")
            .select("radix", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pair", "n", (F.col("n") == F.col("highest")).alias("best"))
        )
        sent = (
            dealt.select("radix", "part", "pairs", "rows")
            .groupBy("radix", "part")
            .cogroup(judged.groupBy("radix", "part"))
            .applyInArrow(contributions, "row_key long, n_best long, count_sum long")
        )
        sums = written(sent.groupBy("row_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
        discard(counts)
        found = documents.join(sums, "row_key", "left").fillna(0, ["n_best", "count_sum"])
    added = [c for c in found.columns if c not in given.values() and c != "row_key"]
    return found.select(*(F.col(k).alias(c) for c, k in given.items() if c not in added), *added)


def alignment(docs: DataFrame, first: str = BYTES, second: str = PIECES, **options) -> DataFrame:
    """docs(text, ...) -> all columns but text, with n_a, n_b, n_groups, n_links, groups, n_best and count_sum.

    A space and the text are encoded by `first`, a byte-level vocabulary; the text by `second`, which adds the space.
    Offsets at which tokens of both end cut them into groups, written a1,a2|b1;a3|b2; all pairs of a group are links. A
    pair's count is the number of rows with it; n_best counts the links whose pair has the highest count of all pairs
    of its first id, ties included; count_sum adds up the links' counts. Null and empty texts, and those whose
    tokens don't join to the text, have no tokens: zeros and empty groups. Each row is a document of its own, whatever
    its id. Columns of these names are replaced.
    """
    return counted(aligned(docs, first, second), **options)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    raw = aligned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    hashed = raw.withColumn("groups_sha256", F.when(F.col("radix").isNull(), digest)).drop("groups")
    hashed._given = raw._given
    found = counted(hashed)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
