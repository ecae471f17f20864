"""The similarity join against all pairs, and how much a task of it holds."""

from datetime import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from matchweave.operators import joins
from matchweave.plans import catalog


def table(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.array([4.0, 3.0, 3.5]) / spread, n).round(3)
    rates = rng.gamma(3.0, 0.5, (n, 2)).round(2)
    out = pd.DataFrame(p, columns=["p_home", "p_draw", "p_away"]).assign(lambda_home=rates[:, 0], lambda_away=rates[:, 1])
    out["fixture_id"], out["unix"], out["competition_id"] = np.arange(n), rng.integers(0, n // 3, n), rng.choice([1, 1, 1, 2], n)
    out["pick"], out["outcome"] = np.array(list("HDA"))[p.argmax(axis=1)], rng.choice(list("HDA"), n)
    return out


def brute(rows, asked, k=8, least=60.0):
    out = []
    for _, q in asked.iterrows():
        c = rows[(rows.competition_id == q.competition_id) & (rows.unix < q.unix)]
        if len(c):
            found = c.assign(similarity=joins._similarity(q.to_frame().T.infer_objects(), c)[0])
            found = found[found.similarity >= least].sort_values(["similarity", "unix", "fixture_id"], ascending=[False, False, True]).head(k)
            out += [(q.fixture_id, m, s, j) for j, (m, s) in enumerate(zip(found.fixture_id, found.similarity), 1)]
    return sorted(out)


@pytest.mark.parametrize("slice_rows,spread", [(20_000, 1.0), (7, 0.2), (40, 4.0)])
def test_equals_all_pairs(spark, slice_rows, spread):
    rows = table(900, 3, spread)
    asked = rows[rows.fixture_id % 10 == 0]
    found = joins.nearest_past(spark.createDataFrame(rows), spark.createDataFrame(asked), slice_rows=slice_rows).collect()
    assert sorted((r.query_id, r.match_id, r.similarity, r["rank"]) for r in found) == brute(rows, asked)


def test_far_cells_are_not_paired(spark, monkeypatch):
    rows = table(3000, 5)
    for name in joins.VECTOR:
        rows.loc[rows.fixture_id % 3 == 0, name] = rows.loc[1, name]
    df = spark.createDataFrame(rows)
    pairs = []

    def watched(asked, c, sizes, k, least, slice_rows, real=joins._compared):
        met = asked.groupBy("cell").count().toPandas().merge(sizes.select("cell", "n").toPandas(), on="cell")
        pairs.append(int((met["count"] * met["n"]).sum()))
        return real(asked, c, sizes, k, least, slice_rows)

    monkeypatch.setattr(joins, "_compared", watched)
    found = joins.nearest_past(df, df.where("fixture_id % 10 = 0"), slice_rows=100)
    assert found.count() > 0
    all_pairs = sum(rows[rows.competition_id == g].shape[0] * rows[(rows.competition_id == g) & (rows.fixture_id % 10 == 0)].shape[0] for g in (1, 2))
    assert 0 < sum(pairs) < 0.8 * all_pairs


def test_nulls_and_empty_tables(spark):
    rows = table(60, 1)
    rows.loc[::7, "p_home"] = None
    df = spark.createDataFrame(rows)
    whole = rows.dropna()
    found = joins.nearest_past(df, df).collect()
    assert sorted((r.query_id, r.match_id, r.similarity, r["rank"]) for r in found) == brute(whole, whole)
    assert joins.nearest_past(df.where("false"), df).count() == 0
    assert joins.nearest_past(df, df.where("false")).count() == 0


def test_names_by_brute_force_and_no_side_of_the_parts_is_broadcast(spark):
    rng = np.random.default_rng(3)
    words = ["ajax", "ajaxamsterdam", "amster", "dam", "real", "realmadrid", "madrid", "madridreal", "abcabcabc", "abca"]
    picks = lambda n: [(int(k), int(rng.integers(0, 2)), *(str(w) for w in rng.choice(words, 2))) for k in range(n)]
    teams, others = picks(60) + [(90, None, "ajax", "real"), (91, 0, None, "real")], picks(80)
    within = lambda a, b: min(len(a), len(b)) >= 4 and (a in b or b in a)
    want = []
    for l_id, day, home, away in teams:
        fits = [(0 if (home, away) == (h, a) else 1, r) for r, d, h, a in others if home and d == day and ((home, away) == (h, a) or (within(home, h) and within(away, a)))]
        if fits:
            want.append((l_id, min(fits)[1], *(("exact", 1.0) if min(fits)[0] == 0 else ("substring", 0.8))))
    schema = "{0}_id long, day int, {0}_home string, {0}_away string"
    got = joins.best_name_match(spark.createDataFrame(teams, schema.format("l")), spark.createDataFrame(others, schema.format("r")), "day")
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[2] for w in want} == {"exact", "substring"}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_block_of_ties_stays_small():
    """Equally similar rows were all gathered before the best were taken."""
    import tracemalloc

    rows = pd.concat([table(3, 1).iloc[:1]] * 8000, ignore_index=True).assign(fixture_id=np.arange(8000), unix=np.arange(8000) % 50)
    asked = rows.iloc[:200].assign(unix=100)
    tracemalloc.start()
    got = joins._block_top(asked, rows, 8, 60.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and len(got) == 8 * 200
    assert set(got.match_id) == set(range(49, 8000, 50)[:8]) and set(got.similarity) == {100.0}


@pytest.mark.parametrize("kinds", [1, 6, 40])
def test_kinds_of_rows_give_what_all_pairs_give(kinds):
    rows = table(1200, 7)
    names = [*joins.VECTOR, "pick"]
    rows[names] = rows[names].iloc[np.arange(1200) % kinds].to_numpy()
    rows = rows.astype({n: "float64" for n in joins.VECTOR})
    show = lambda found: sorted(zip(found.query_id, found.match_id, found.similarity, found.unix, found.pick, found.outcome))
    assert len(rows) ** 2 > joins.SMALL and kinds * 8 < len(rows)
    singly = pd.concat([joins._block_top(rows.iloc[[n]], rows, 8, 60.0) for n in range(len(rows))])
    assert len(singly) > 4000 and show(joins._block_top(rows, rows, 8, 60.0)) == show(singly)


def test_every_contest_is_refined_and_equal_questions_are_asked_once(spark, tmp_path, monkeypatch):
    """Only ids divisible by 100 had a row; repeated and missing ids keep what the SQL gives them."""
    rng = np.random.default_rng(11)
    keys = [*range(5), 5, 5, None, 8, None, *range(10, 400)]
    rows = [
        (key, int(n % 7), "F", float(rng.choice(np.arange(12)) * 1234.5 + 950), datetime(1996, 1, 1 + (n if n < 10 else int(rng.integers(0, 25)))))
        for n, key in enumerate(keys)
    ]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    asked = []

    def watched(rows, queries, real=joins.nearest_past):
        asked.append(queries.count())
        return real(rows, queries)

    monkeypatch.setattr(joins, "nearest_past", watched)
    got = catalog.QUERIES["g8_mode_refinement"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
        want = con.execute(catalog.ORACLES["g8_mode_refinement"]).fetchall()
    assert sorted(((r.query_id, r["mode"], r.k, r.refined) for r in got), key=repr) == sorted(want, key=repr)
    ids = [r.query_id for r in got]
    assert len(ids) > 350 and {None, 5, 11} <= set(ids) and len(ids) == len(set(ids))
    assert asked[0] < len(rows)
