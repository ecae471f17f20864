"""The pipeline's rows against plain Python versions of its stages, each on its own input."""

import corpus_pipeline
from helpers import sql_rows
from test_line_dedup import brute as brute_lines
from test_simhash import brute_components, plain_fingerprint

from matchweave.llm import decontaminate, mixing, toxicity


def plain_stages(spark, sf_dir):
    docs = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    model = toxicity.train(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )
    yield docs
    docs = {i: d for i, d in docs.items() if model.scores([d["text"]])[0] < 0.5}
    yield docs
    lines = brute_lines([(i, d["text"]) for i, d in docs.items()])
    docs = {
        i: docs[i] | ({"text": text, "n_chars": len(text)} if gone else {})
        for i, _, gone, text in lines
        if not gone or text.strip(" \t\n\x0b\x0c\r")
    }
    yield docs
    groups = brute_components({i: plain_fingerprint(d["text"]) for i, d in docs.items()})
    docs = {i: d for i, d in docs.items() if groups[i] == i}
    yield docs
    import pandas as pd

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    found = sql_rows(decontaminate.OP6_SQL, documents=pd.DataFrame(list(docs.values())), benchmark=bench)
    bad = {doc_id for contaminated, doc_id, *_ in found if contaminated}
    docs = {i: d for i, d in docs.items() if i not in bad}
    yield docs


def test_stages_and_run(spark):
    sf_dir = "/root/testdata/sf0.001"
    plain = list(plain_stages(spark, sf_dir))
    assert len({len(d) for d in plain}) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], plain[1:]):
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        assert {r.doc_id: r.asDict() for r in docs.collect()} == want
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: {c: r[c] for c in columns} for r in got} == plain[-1]
    sizes = {}
    for d in plain[-1].values():
        sizes[f"s:{d['source']}"] = sizes.get(f"s:{d['source']}", 0) + 1
    slots = mixing.shares(dict(sorted(sizes.items())), 1000)
    where = {(s, j): slot for s, j, slot in mixing.pfair_slots(slots)}
    for r in got:
        n = slots[f"s:{r.source}"]
        assert r.mix_slot == r.mix_block // n * 1000 + where[f"s:{r.source}", r.mix_block % n]


def test_empty_documents(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_ids_and_repeated_rows_are_judged(spark, tmp_path):
    item = " ".join(f"alpha{k}" for k in range(13))
    clean = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(1, clean[0]), (1, clean[0]), (None, clean[0]), (None, clean[1]), (None, clean[1]), (2, clean[2]), (None, item), (2, item)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, clean[0]), (0, clean[1]), (2, clean[2]), (2, item)])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text for r in left) == sorted(t for _, t in rows if t != item)
