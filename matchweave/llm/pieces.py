"""SentencePiece encoding and decoding with an agenda of adjacent symbol pairs."""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from matchweave.llm.common import by_bytes, extended, schema_with

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"


class PieceModel:
    """A merge-type vocabulary with byte fallback, as the library loads it, and its own encoder.

    Texts are cut where no piece of the vocabulary reaches across: before spaces that follow another character, if no
    piece holds a space behind another character, and around line feeds, if no longer piece holds one. Merges on one
    side of such a cut never touch the other, so that a part's ids are the same in every text, and are kept for the next
    one: about `remembered` parts of at most 48 characters. A new part is cut further between characters that stand side
    by side in no piece.
    """

    def __init__(self, path: str = MODEL, remembered: int = 400_000):
        self.library = SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.vocab_size()
        bytes_of = {sp.id_to_piece(k): k for k in range(n) if sp.is_byte(k)}
        if len(bytes_of) != 256 or any(sp.is_unused(k) for k in range(n)):
            raise ValueError("only vocabularies with byte fallback and without unused pieces are encoded")
        self.byte_ids = [bytes_of[f"<0x{b:02X}>"] for b in range(256)]
        self.id_of = {sp.id_to_piece(k): k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))}
        self.cost = {p: -sp.get_score(k) for p, k in self.id_of.items()}
        self.prefixed = sp.normalize("a") == SPACE + "a"
        if sp.normalize(" a  b ") != (SPACE if self.prefixed else "") + f"{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only vocabularies that keep white space as it is are encoded")
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        by_space = not any(inner.search(p) for p in self.id_of)
        by_line = not any("\n" in p for p in self.id_of if len(p) > 1)
        line = "\n" if by_line else ""
        self.parts = re.compile(
            f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if by_line else "") if by_space else "[^\n]+|\n" if by_line else r"(?s:.+)"
        )
        self.by_line, self.remembered = by_line, remembered
        self.touching = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.differing: set[str] = set()

    def ids(self, part: str) -> tuple[int, ...]:
        """Ids of a new part, from those of its runs of characters that may touch within a piece."""
        touching, known, start, found = self.touching, self.known, 0, []
        for k in range(1, len(part) + 1):
            if part[k - 1 : k + 1] not in touching:
                run = part[start:k]
                got = known.get(run)
                if got is None:
                    got = self.merged(run)
                    if k - start <= 48:
                        known[run] = got
                found.extend(got)
                start = k
        return tuple(found)

    def merged(self, run: str) -> tuple[int, ...]:
        """Ids of a run: its best-scored adjacent pair is merged, the leftmost of equal ones, until none is a piece.

        Pairs wait in an agenda ordered by score and place. Up to 24 characters it is a list beside the symbols, of
        which the best is looked up; beyond, a heap, where a pair whose symbols have been merged since is passed over.
        """
        symbols, id_of = list(run), self.id_of
        merge = self.merge_few if len(symbols) <= 24 else self.merge_many
        ids: list[int] = []
        for s in merge(symbols):
            found = id_of.get(s)
            if found is None:
                ids.extend(self.byte_ids[b] for b in s.encode())
            else:
                ids.append(found)
        return tuple(ids)

    def merge_few(self, symbols: list[str]) -> list[str]:
        cost, none = self.cost.get, float("inf")
        agenda = [cost(p, none) for p in map(add, symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            k = agenda.index(best)
            both = symbols[k] = symbols[k] + symbols.pop(k + 1)
            del agenda[k]
            if k < len(agenda):
                agenda[k] = cost(both + symbols[k + 1], none)
            if k:
                agenda[k - 1] = cost(symbols[k - 1] + both, none)
        return symbols

    def merge_many(self, symbols: list[str]) -> list[str]:
        cost, n = self.cost.get, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, k, k + 1, 2) for k, c in enumerate(map(cost, map(add, symbols, symbols[1:]))) if c is not None]
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue
            symbols[left], symbols[right] = a + b, ""
            ahead, behind = after[right], before[left]
            after[left] = ahead
            if ahead < n:
                before[ahead] = left
            for i, j in ((left, ahead), (behind, left)):
                if i >= 0 and j < n:
                    both = symbols[i] + symbols[j]
                    c = cost(both)
                    if c is not None:
                        heappush(agenda, (c, i, j, len(both)))
        return [s for s in symbols if s]

    def cut(self, text: str) -> list[str]:
        """The parts of a text as the vocabulary sees it, with spaces as U+2581; none of an empty text."""
        return self.parts.findall((SPACE if self.prefixed else "") + text.replace(" ", SPACE)) if text else []

    def check(self, parts: list[str], found: list[tuple[int, ...]]) -> list[bool]:
        """Whether the library encodes each part to the same ids, in one call for all of them.

        Behind a line feed the library adds no space of its own, so a part stands behind one; where line feeds are no
        cut, the part's own leading space is the one that the library adds.
        """
        if self.by_line:
            lead = self.library.encode("\n")
            want = self.library.encode(["\n" + p for p in parts], num_threads=1)
            return [tuple(w) == (*lead, *f) for w, f in zip(want, found, strict=True)]
        want = self.library.encode([p[1:] if self.prefixed else p for p in parts], num_threads=1)
        return [tuple(w) == f or p == SPACE for w, f, p in zip(want, found, parts, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """For every text its ids, and whether the library agreed on each of its parts."""
        if len(self.known) > self.remembered:
            self.known.clear()
            self.differing.clear()
        known, cut = self.known, [self.cut(t) for t in texts]
        new = [p for p in set(chain.from_iterable(cut)) if p not in known]
        ids = [self.ids(p) for p in new]
        known.update(zip(new, ids, strict=True))
        self.differing.update(p for p, same in zip(new, self.check(new, ids) if new else (), strict=True) if not same)
        agrees = [not self.differing or self.differing.isdisjoint(parts) for parts in cut]
        out = [list(chain.from_iterable(map(known.__getitem__, parts))) for parts in cut]
        for p in new:
            if len(p) > 48:
                known.pop(p, None)
                self.differing.discard(p)
        return out, agrees

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The library's texts for lists of ids."""
        return self.library.decode(ids) if ids else []


_models: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    """The vocabulary at path; a worker process loads it once."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs(text, ...) -> all columns, with ids array<int>, decoded string and agrees boolean, one row for each row.

    ids are those of the whole text without begin or end ids; decoded is what they decode to; agrees tells whether the
    library gave the same ids for all parts of the text. A null text counts as an empty one: no ids, an empty decoded
    text. Columns of these names are replaced. path must lead to the vocabulary file on every executor. Batches are cut
    to about 4 MB of text, so that a task holds one of them at a time.
    """

    def run(batches):
        model = model_at(path)
        for batch in by_bytes(batches, "text"):
            ids, agrees = model.encode([t or "" for t in batch.column("text").to_pylist()])
            yield extended(batch, {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(model.decode(ids), pa.string()), "agrees": pa.array(agrees, pa.bool_())})

    kept = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded", "agrees")))
    return kept.mapInArrow(run, schema_with(kept, "ids array<int>, decoded string, agrees boolean"))


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """rows(ids array<int>, ...) -> all columns, with text: what the ids decode to. A null list gives an empty text."""

    def run(batches):
        model = model_at(path)
        for batch in batches:
            yield extended(batch, {"text": pa.array(model.decode([x or [] for x in batch.column("ids").to_pylist()]), pa.string())})

    kept = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != "text"))
    return kept.mapInArrow(run, schema_with(kept, "text string"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, with agrees."""
    found = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )
