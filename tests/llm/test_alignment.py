import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from matchweave.llm import alignment as op
from matchweave.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(op.BYTES)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=op.PIECES)


def brute(texts, tools):
    """Whole texts at once, every link listed; then counts over all texts."""
    a_tool, b_tool = tools
    value = op.byte_values()
    rows = []
    for text in texts:
        groups = []
        if text:
            plain = (" " + text).encode()
            a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
            left = [bytes(value[c] for c in a_tool.id_to_token(k)) for k in a]
            right = [bytes([int(p[3:5], 16)]) if b_tool.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [b_tool.id_to_piece(k)]]
            if b"".join(left) == plain == b"".join(right):
                ends_a, ends_b = np.cumsum([len(x) for x in left]), np.cumsum([len(x) for x in right])
                common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
                i = j = 0
                for end in common:
                    p, q = i, j
                    while i < len(a) and ends_a[i] <= end:
                        i += 1
                    while j < len(b) and ends_b[j] <= end:
                        j += 1
                    groups.append((a[p:i], b[q:j]))
        rows.append(groups)
    counts = Counter(p for g in rows for p in {(x, y) for l, r in g for x in l for y in r})
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for g in rows:
        links = [(x, y) for l, r in g for x in l for y in r]
        text = ";".join(f"{','.join(map(str, l))}|{','.join(map(str, r))}" for l, r in g)
        out.append((sum(len(l) for l, _ in g), sum(len(r) for _, r in g), len(g), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), text))
    return out


def odd_texts(n, seed=4):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "a", "b", "'s", "the ring", " and", "▁", "é", "梦", "😀", "\t", "\x00", ".", "1", "23", "　", "\r\n", "<|endoftext|>", "\xa0", "​", "---------", "=" * 40]
    return ["".join(rng.choices(bits, [9 if b.isascii() else 2 if b != "▁" else 0.2 for b in bits], k=rng.randint(0, 50))) for _ in range(n)]


def rows_of(found):
    return sorted((r.k, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in found.collect())


def test_equals_brute_force(spark, tools):
    texts = [None, "", "the", "the", *odd_texts(400), "-" * 3001, "x" + "=" * 999]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(6)
    want = [(k, *row) for k, row in enumerate(brute(texts, tools))]
    assert rows_of(op.alignment(docs)) == want


def test_small_runs_and_parts_change_nothing(spark, tools):
    texts = ["so it is"] * 60 + odd_texts(60, 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(7)
    found = op.counted(op.aligned(docs, run_records=50), part_records=40)
    assert rows_of(found) == [(k, *row) for k, row in enumerate(brute(texts, tools))]


def test_query_equals_brute_force(spark, tools):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op13_alignment"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, row in zip(docs, brute([d.text for d in docs], tools)):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == row[:6]
        assert r.groups_sha256 == (hashlib.sha256(row[6].encode()).hexdigest() if row[6] else "")


def test_large_groups_are_counted_without_listing_links():
    tool = op.Aligner()
    tool.a_bytes, tool.b_bytes = {1: b"ab", 2: b" "}, [b"a", b"ba", b" ", b"b"]
    tool.a_size, tool.b_size = np.array([0, 2, 1]), np.array([1, 2, 1, 1])
    n = 20_000
    part = " " + "ab" * n
    wrong, found = tool.groups([" ba", part], [[2, 1], [2] + [1] * n], [[2, 1], [2, 0] + [1] * (n - 1) + [3]])
    assert wrong is None
    assert found[:4] == (n + 1, n + 2, 2, 1 + n * (n + 1))
    assert dict(zip(np.frombuffer(found[5], dtype=np.int64).tolist(), found[6].tolist())) == {2 << op.SHIFT | 2: 1, 1 << op.SHIFT: n, 1 << op.SHIFT | 1: n * (n - 1), 1 << op.SHIFT | 3: n}


def test_ranks_give_the_same_ids(tools):
    tool = op.Aligner()
    rng = random.Random(8)
    parts = [" " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABC'sdtmé.,$1234-ñößñ\n\t ½²ªº", k=rng.randint(1, 20))) for _ in range(20_000)]
    assert tool.ranked is not None and any(map(op.LATIN.fullmatch, parts))
    assert tool.first_ids(parts) == [x.ids for x in tools[0].encode_batch(parts, add_special_tokens=False)]


def test_packed_arrays_come_back():
    arrays = [np.array(x, dtype=np.int64) for x in ([], [0], [255, 256], [2**40, 3], list(range(1000)))]
    assert [x.tolist() for x in op.unpacked(op.packed(*arrays))] == [x.tolist() for x in arrays]


def test_empty_tables_repeats_and_clashing_columns(spark, tools):
    docs = spark.createDataFrame([(1, "so it is", "p", 5), (1, "so it is", "q", 6), (None, None, None, 7)], "k int, text string, radix string, n_a int")
    found = op.alignment(docs)
    assert found.columns == ["k", "radix", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    want = brute(["so it is"] * 2 + [None], tools)
    assert sorted((r.radix or "", r.n_a, r.n_best, r.count_sum) for r in found.collect()) == sorted((c, w[0], w[4], w[5]) for c, w in zip(("p", "q", ""), want))
    assert op.alignment(docs.where("false")).count() == 0
    assert op.alignment(docs.where("text is null")).first().n_a == 0
