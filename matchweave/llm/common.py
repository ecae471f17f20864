"""Helpers that several operators share: written intermediates, components, pair linking."""

from __future__ import annotations

import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset, and only in local mode, a temporary folder stands in for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/matchweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._matchweave_path = path
    return back


def bucketed(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Write df in the shared folder as a table in buckets of a column: joins by it move the other side alone."""
    spark = df.sparkSession
    name = f"matchweave_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(parts, column).write.format("parquet").option("path", path).bucketBy(parts, column).sortBy(column).saveAsTable(name)
    back = spark.table(name)
    back._matchweave_path, back._matchweave_table = path, name
    return back


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that written() or bucketed() returned."""
    spark = df.sparkSession
    if hasattr(df, "_matchweave_table"):
        spark.sql(f"DROP TABLE IF EXISTS {df._matchweave_table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(df._matchweave_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freeing_shuffles(build):
    """For build(df, ...): shuffle files go as each of its writes ends, not when the driver happens to collect garbage."""

    @wraps(build)
    def run(df: DataFrame, *args, **kwargs):
        conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key)
        conf.set(key, "true")
        try:
            return build(df, *args, **kwargs)
        finally:
            conf.set(key, before)

    return run


def by_bytes(batches, column: str, limit: int = 4 << 20):
    """Arrow batches cut so that a string column holds about limit bytes in each; a longer row stands alone."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            seen = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, seen + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def extended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def schema_with(df: DataFrame, ddl: str) -> StructType:
    """The frame's schema with further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is its smallest node.

    Alternates the large-star and small-star steps until the edge set stands still. Each step is
    a grouped minimum (combined before the shuffle) and an equi-join, so that no neighbour list
    is ever gathered; a hub's rows can be split by adaptive skew handling. Self loops and null
    ends are ignored; nodes without any other edge are not returned.
    """
    u, v = F.col("u"), F.col("v")
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x is not null and y is not null and u != v")
        .select("u", "v")
        .distinct()
    )
    stamp = None
    while True:
        nearest = now.groupBy(u.alias("w")).agg(F.min(v).alias("m"))
        large = (
            now.join(nearest, now.v == nearest.w, "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        )
        least = large.groupBy(u.alias("w")).agg(F.min(v).alias("m"))
        small = (
            large.join(least, large.u == least.w)
            .where("v != m")
            .select(v.alias("u"), F.col("m").alias("v"))
            .unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        after = written(small)
        discard(now)
        now = after
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == stamp:
            break
        stamp = mark
    return now.select(u.alias("node"), v.alias("component")).unionAll(
        now.select(v.alias("node"), v.alias("component")).distinct()
    )


def union_pairs(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the classes of i[k] and j[k] for every k; label[x] is the smallest index of x's class."""
    while len(i):
        li, lj = label[i], label[j]
        differ = li != lj
        if not differ.any():
            break
        i, j = i[differ], j[differ]
        high, low = np.maximum(li[differ], lj[differ]), np.minimum(li[differ], lj[differ])
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
