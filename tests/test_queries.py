"""Every registered query of the library against its DuckDB oracle."""

import duckdb
import pytest

from matchweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        yield con


def plain(value):
    return float(f"{value:.6g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted((tuple(plain(r[k]) for k in order) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_oracle(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
