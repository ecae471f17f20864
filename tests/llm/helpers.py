"""Comparing a Spark result with DuckDB SQL over the same tables."""

import duckdb

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table_rows(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(sql, sf_dir=None, **frames):
    with duckdb.connect() as con:
        for t in TABLES if sf_dir else ():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        for name, frame in frames.items():
            con.register(f"{name}_frame", frame)
            con.execute(f"create or replace view {name} as select * from {name}_frame")
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted((tuple(plain(r[k]) for k in order) for r in cursor.fetchall()), key=repr)
