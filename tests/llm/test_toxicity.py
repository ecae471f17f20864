import numpy as np
from zlib import crc32

from matchweave.llm import toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op7_toxicity(spark, sf).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    truth = np.array([labels[r.doc_id] for r in test])
    guess = np.array([r.predicted for r in test])
    score = np.array([r.score for r in test])
    above = (score[truth == 1][:, None] > score[truth == 0][None, :]).mean()
    assert above > 0.85
    assert (guess == truth).mean() > 0.9


def test_unseen_misspellings_share_subwords():
    clean = ["good day to you", "the weather is fine", "a quiet walk home", "tea with milk"] * 10
    toxic = [f"you are a {w} here" for w in ("grumblefoot", "grumblefist", "grumblehead", "grumbletoe")] * 10
    model = toxicity.fit(clean + toxic, [0] * 40 + [1] * 40, epochs=30, batch=8, min_texts=1)
    scores = model.scores(["such a grumblenose", "such a fine milk"])
    assert scores[0] > scores[1]


def test_odd_rows(spark):
    assert toxicity.fit([], []).scores(["a", None, ""]).tolist() == [0.5] * 3
    assert toxicity.fit(["a"], [0]).scores(["a"])[0] < 0.01
    model = toxicity.fit(["bad thing", "fine thing", "", None], [1, 0, 0, 0], epochs=5, min_texts=1)
    docs = spark.createDataFrame(
        [(1, None, 5, 1), (2, "", 5, 1), (2, "bad " * 50_000, 5, 1), (None, "x" * 100_000, None, None)],
        "doc_id long, text string, score int, toxic int",
    )
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert toxicity.scored(docs.where("false"), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, empty).scores(["a"])[0] == 0.5


def test_words_late_in_a_long_run_are_read():
    long = "".join(chr(0x4E00 + k) for k in range(150))
    clean, toxic = [long] * 20, [long + "毒毒舌毒" + long[:40]] * 20
    model = toxicity.fit(clean + toxic, [0] * 20 + [1] * 20, epochs=20, batch=8, min_texts=1)
    scores = model.scores(["好" * 90 + "毒毒舌毒", "好" * 90])
    assert scores[0] > scores[1]
    for n in (1, 63, 64, 65, 66, 67, 124, 125, 126, 300):
        marked = f"<{long * 2}"[: n + 1] + ">"
        grams = {marked[k : k + m] for m in (3, 4, 5) for k in range(len(marked) - m + 1)}
        pieces = toxicity.distinct_words(marked[1:-1])
        assert grams == {p[k : k + m] for p in pieces for m in (3, 4, 5) for k in range(len(p) - m + 1)}
        assert all(len(p) <= 66 for p in pieces)
