import hashlib
import random

import pytest

from matchweave.llm import pieces as op
from matchweave.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
BITS = [" ", "  ", "\n", "a", "b", "the", "▁", "é", "梦", "😀", "\t", "\x00", ".", "1", "23", "　", "\r\n", "ing", "<s>", "<0x41>", "ß", "Ä", "  \n"]


@pytest.fixture(scope="module")
def model():
    return op.model_at(op.MODEL)


def test_equals_the_library_on_odd_strings(model):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ids, agrees = model.encode(texts)
    assert ids == model.library.encode(texts, num_threads=1)
    assert all(agrees)


def test_long_runs_keep_their_agenda_in_a_heap(model):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghij梦夢") for _ in range(n)) for n in (23, 24, 25, 47, 48, 49, 5000)] + ["夢" * 100_000, " " * 10_001]
    assert model.encode(texts)[0] == model.library.encode(texts, num_threads=1)


def test_both_agendas_merge_alike(model):
    rng = random.Random(7)
    for _ in range(500):
        word = [rng.choice("▁theingaorscion") for _ in range(rng.randint(1, 24))]
        assert model.merge_few(list(word)) == model.merge_many(list(word))


def test_a_small_memory_changes_nothing():
    tight = op.PieceModel(remembered=3)
    texts = ["the ring and the thing", "nothing\nelse ", "", "the ring"] * 3
    assert [tight.encode([t])[0][0] for t in texts] == tight.library.encode(texts, num_threads=1)


def test_query_equals_the_library_on_every_document(spark, model):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_sentencepiece"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        ids = model.library.encode(text)
        assert got[k].n_tokens == len(ids) and got[k].agrees
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark, model):
    rows = [(1, None, "x"), (1, "", "y"), (2, "so it is", "z"), (2, "so it is", "z"), (None, " a▁b\n", None)]
    found = op.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.ids, r.decoded, r.agrees) for r in found) == sorted(
        (d or 0, t or "", model.library.encode(t or ""), model.library.decode(model.library.encode(t or "")), True) for d, t, _ in rows
    )
    assert op.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decoding_is_a_round_trip(spark):
    rows = spark.createDataFrame([(1, "one two  three"), (2, "naïve 梦 😀\n"), (3, None)], "k int, text string")
    back = op.decoded(op.encoded(rows).select("k", "ids"))
    assert {r.k: r.text for r in back.collect()} == {1: "one two  three", 2: "naïve 梦 😀\n", 3: ""}
