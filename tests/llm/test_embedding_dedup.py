import numpy as np
import pytest

from matchweave.llm import embedding_dedup as op


def brute(ids, vectors, threshold=0.95):
    unit = [op.unit_vector(v) for v in vectors]
    ok = [k for k, u in enumerate(unit) if u is not None]
    near = {k: set() for k in range(len(ids))}
    x = np.stack([unit[k] for k in ok])
    for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
        if a != b:
            near[ok[a]].add(ok[b])
    return near


def test_code_lists_the_highest_directions():
    for per_code in (1, 6, 20, 64):
        code = op.ProductCode(12, 4, 3, per_code)
        x = np.random.default_rng(0).standard_normal((50, 12))
        turned = x @ code.rotation
        directions = np.array([np.concatenate([code.words[0][a], code.words[1][b], code.words[2][c]]) for a in range(4) for b in range(4) for c in range(4)])
        want = np.sort(np.argsort(-(turned @ directions.T), axis=1)[:, :per_code], axis=1)
        assert (np.sort(code.filters(x), axis=1) == want).all()


def planted(n, dim, cosine, share, seed=1):
    """n random unit vectors, around a common mean that makes up `share` of the square; pairs k, n/2 + k at the cosine."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = rng.standard_normal(dim)
    x = share**0.5 * mean / np.linalg.norm(mean) + (1 - share) ** 0.5 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[: n // 2]
    g = rng.standard_normal(y.shape)
    g -= (g * y).sum(axis=1, keepdims=True) * y
    x[n // 2 :] = cosine * y + (1 - cosine**2) ** 0.5 * g / np.linalg.norm(g, axis=1, keepdims=True)
    return x


@pytest.mark.parametrize("n", [500, 4000, 20_000, 100_000])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.7])
def test_planted_pairs_share_a_filter(n, share):
    x = planted(n, 64, 0.955, share)
    tool = op.CapFilters(x.mean(axis=0), *op.code_shape(n, 64, 0.95, 3, 6, 8.0), 6, 4, 42)
    lists = [f for k in range(0, n, 2048) for f in tool.lists(x[k : k + 2048])]
    assert min(map(len, lists)) >= 24
    met = sum(bool(np.intersect1d(lists[k], lists[n // 2 + k]).size) for k in range(0, n // 2, max(1, n // 4000)))
    assert met >= 0.95 * len(range(0, n // 2, max(1, n // 4000)))
    rows = np.unique(np.concatenate(lists), return_counts=True)[1].astype(float)
    assert (rows**2).sum() < 500 * n  # pairs to verify grow with n, not with its square


@pytest.mark.parametrize("dim,share", [(64, 0.0), (64, 0.7), (64, 0.9), (8, 0.0), (3, 0.0), (2, 0.0), (1, 0.0)])
def test_links_against_brute_force(spark, dim, share):
    n = 1200
    x = planted(n, dim, 0.96, share) if dim > 1 else np.random.default_rng(1).standard_normal((n, 1))
    got = {r.vec_id: r.n_links for r in op.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), part_rows=200).collect()}
    near = brute(range(n), x)
    want = sum(map(len, near.values()))
    assert 0.97 * want <= sum(got.values()) <= want
    assert all(got[k] <= len(v) for k, v in near.items())


def test_recall_and_precision_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    near = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {r.vec_id: r for r in op.near_duplicates(table, part_rows=8).collect()}
    want = sum(map(len, near.values()))
    found = sum(got[r.vec_id].n_links for r in rows)
    assert 0.98 * want <= found <= want
    assert all(got[r.vec_id].n_links <= len(near[k]) for k, r in enumerate(rows))


def test_groups_of_near_copies_count_each_link_once(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(32)
    rows = [(k, (base + 0.02 * rng.standard_normal(32)).tolist()) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(20)] + [(200 + k, (2 * np.array(rows[1][1])).tolist()) for k in range(2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for part_rows in (7, 2048):
        got = op.near_duplicates(table, part_rows=part_rows).collect()
        assert {r.n_links for r in got} == {81} and {r.component_id for r in got} == {0}
        assert [r.vec_id for r in got if r.kept] == [0]


def test_edge_rows(spark):
    schema = "vec_id long, embedding array<double>, label int, rep long, filter string"
    nan = float("nan")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]),
        (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (None, [1.0, 0.0]),
    ]
    table = spark.createDataFrame([(*r, None, 5, "x") for r in rows], schema)
    got = {r.vec_id: r for r in op.near_duplicates(table).collect()}
    assert len(got) == 11
    assert {i for i, r in got.items() if r.n_links} == {7, 8} and got[None].kept is False
    assert got[8].component_id == 7 and not got[8].kept and got[7].kept and got[1].kept
    assert op.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (1, [0.0, 5.0]), (4, [1.0, 1.0])]
    got = op.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 0, 4)]
