import random
from collections import Counter
from math import floor, log

import numpy as np
import pandas as pd
import pytest
from helpers import sql_rows, table_rows

from matchweave.llm import lexical as op
from matchweave.llm.registry import ORACLES, QUERIES


def brute(docs, items, top=10):
    """Every item against every document, term by term."""
    terms = [(d, op.terms_of(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        rows = []
        for d, t in terms:
            if d is None or not t:
                continue
            tf, m, score = Counter(t), 25 + (75 * len(t) * n_docs) // n_terms, 0
            for x in op.terms_of(text):
                if tf[x]:
                    score += floor(1000 * log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m))
            if score > 0:
                rows.append((-score, d))
        out += [(item, k, d, -s) for k, (s, d) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def got(found):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect())


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["Été", "ñ", "42", "Ab"]
    docs = [(k // 2, " ".join(rng.choices(words, [1 / (j + 1) for j in range(44)], k=rng.randint(0, 60)))) for k in range(300)]
    docs += [(None, "w1 w2"), (7, None), (8, ""), (9, "-- ,"), (10, "w3 " * 5000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for k in range(30)]
    items += [(30, None), (31, ""), (32, "w1 w1 w1 Zebra"), (33, "w1 w1 w1 Zebra"), (33, "unknown"), (34, "éTÉ Été.AB")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark, tables):
    docs, items = tables
    assert got(op.ranked(*frames(spark, docs, items))) == brute(docs, items)


def test_blocks_of_items_and_narrow_accumulators_change_nothing(spark, tables):
    docs, items = tables
    found = op.ranked(*frames(spark, docs, items), top=3, block_terms=60, cells=1)
    assert got(found) == brute(docs, items, 3)


def test_oracle_equals_brute_force(tables):
    docs, items = tables
    rows = sql_rows(ORACLES["op12_lexical_search"], documents=pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}), benchmark=pd.DataFrame(items, columns=["item_id", "text"]))
    want = sorted((d, i, k, s) for i, k, d, s in brute(docs, items))
    assert sorted((r[0], r[1], r[2], r[3]) for r in rows) == want


def test_query_equals_oracle(spark):
    sf = "/root/testdata/sf0.01"
    assert table_rows(QUERIES["op12_lexical_search"](spark, sf)) == sql_rows(ORACLES["op12_lexical_search"], sf)


def test_shared_sets_are_summed_once():
    common = [f"c{k}" for k in range(20)]
    items = [[*common, f"own{k}", "twice", *["twice"] * (k % 2)] for k in range(8)]
    plan = op.SharingPlan.mine(items)
    assert plan.n_leaves == 8 + 1 + 1  # own terms, what all share, the second "twice"
    assert len(plan.sums) == 1 and sum(map(len, plan.tops)) < sum(len(set(x)) for x in items)
    rng = np.random.default_rng(0)
    part = rng.integers(0, 10**10, (len(plan.terms), 5))
    term, doc = (x.ravel() for x in np.meshgrid(np.arange(len(plan.terms)), np.arange(5), indexing="ij"))
    want = [[sum(int(part[plan.terms[t], d]) for t in row) for d in range(5)] for row in items]
    assert plan.scores(doc, term, part.ravel(), 5).tolist() == want


def test_empty_tables_and_extra_columns(spark, tables):
    docs, items = frames(spark, *tables)
    nothing = op.ranked(docs.where("false"), items)
    assert nothing.count() == 0 and nothing.columns == ["item_id", "rank", "doc_id", "score"]
    assert op.ranked(docs, items.where("false")).count() == 0
    more = op.ranked(docs.selectExpr("*", "1 as n", "2 as terms", "3 as score"), items.selectExpr("*", "1 as doc_id", "2 as rank"))
    assert got(more) == got(op.ranked(docs, items))
