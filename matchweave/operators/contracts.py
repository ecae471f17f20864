"""Contracts on tables: feature columns, label domains, availability, statuses, hashes and disjoint unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label of each known status; anything else is upcoming.
STATUS_LABELS = {"FT": "FINISHED", "AET": "AET", "PEN": "PEN", "LIVE": "LIVE", "HT": "HT", "POSTP": "POSTPONED", "CANC": "CANCELLED", "SUSP": "SUSPENDED"}


def select_exact(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in that order; fails at once, naming all that are missing."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*(F.col(f"`{c}`") for c in columns))


def feature_columns(rows: DataFrame, labels: list[str], metadata: list[str]) -> list[str]:
    """All columns that are neither labels nor metadata, in their order."""
    return [c for c in rows.columns if c not in {*labels, *metadata}]


def required(rows: DataFrame, holds: Column, message: str) -> DataFrame:
    """rows, failing at run time on the first one that breaks the condition."""
    return rows.where(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def labelled(rows: DataFrame, label: str, domain: list[str], excluded: DataFrame, key: str) -> DataFrame:
    """Rows with a label, without the keys of `excluded`; a label outside the domain fails the run."""
    out = excluded.select(F.col(key).alias("excluded_key")).distinct()
    marked = rows.where(F.col(label).isNotNull()).join(out, F.col(key) == F.col("excluded_key"), "left")
    gone = F.col("excluded_key").isNotNull()
    return required(marked, gone | F.col(label).isin(domain), f"{label} outside its domain").where(~gone).drop("excluded_key")


def availability(train: DataFrame, batch: DataFrame, columns: list[str], max_null_rate: float) -> DataFrame:
    """Per column of a batch: null rate, its change against training, and missing, all_null, constant, over_rate or ok.

    Each side is one aggregate, whatever the number of columns.
    """

    def rates(rows: DataFrame, suffix: str) -> DataFrame:
        there = [c for c in columns if c in rows.columns]
        cells = [
            F.struct(
                F.lit(c).alias("column"),
                F.avg(F.col(c).isNull().cast("double")).alias("null_rate"),
                (F.min(c) == F.max(c)).alias("constant"),
            )
            for c in there
        ]
        cells += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("null_rate"), F.lit(None).cast("boolean").alias("constant")) for c in columns if c not in there]
        packed = rows.agg(*(c.alias(f"c{k}") for k, c in enumerate(cells)))
        named = F.explode(F.array(*(F.col(f"c{k}") for k in range(len(cells)))))
        return packed.select(named.alias("c")).select(F.col("c.column").alias("column"), F.col("c.null_rate").alias(f"null_rate{suffix}"), F.col("c.constant").alias(f"constant{suffix}"))

    both = rates(batch, "").join(rates(train, "_train"), "column")
    status = (
        F.when(F.col("null_rate").isNull(), "missing")
        .when(F.col("null_rate") == 1, "all_null")
        .when(F.col("constant"), "constant")
        .when(F.col("null_rate") > max_null_rate, "over_rate")
        .otherwise("ok")
    )
    return both.select("column", "null_rate", (F.col("null_rate") - F.col("null_rate_train")).alias("change"), status.alias("status"))


def normalized_status(status: Column, home: Column, away: Column) -> list[Column]:
    """(status, label, score to show, finished): known statuses as they are, all others UPCOMING."""
    known = F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair))
    label = F.coalesce(known[F.upper(F.trim(status))], F.lit("UPCOMING"))
    name = F.when(label == "UPCOMING", "UPCOMING").otherwise(F.upper(F.trim(status)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    shown = F.when(name.isin("LIVE", "HT"), F.concat_ws("-", zero(home), zero(away))).when(
        name.isin("FT", "AET", "PEN", "SUSP") & home.isNotNull() & away.isNotNull(), F.concat_ws("-", home.cast("string"), away.cast("string"))
    )
    return [name, label, F.coalesce(shown, F.lit("-")), name.isin("FT", "AET", "PEN")]


def typed_values(predictions: Column, type_id: int, names: tuple[str, ...] = ("home", "draw", "away")) -> Column:
    """struct(names): values of the first struct (type_id, values map) of an array with that type, none under zero; null where
    there is none. Select it once under a name, as every mention of it is worked out anew."""
    first = F.filter(predictions, lambda p: p["type_id"] == type_id)
    read = F.transform(F.slice(first, 1, 1), lambda p: F.struct(*(F.when(p["values"][n].isNotNull(), F.greatest(p["values"][n], F.lit(0.0))).alias(n) for n in names)))
    return F.get(read, F.lit(0))


def typed_percentages(found: Column, names: tuple[str, ...] = ("home", "draw", "away")) -> list[Column]:
    """Fractions that sum to one, of a column of typed_values; null unless complete."""
    total = reduce(lambda x, y: x + y, (found[n] for n in names))
    return [F.when(total > 0, found[n] / total).when(total == 0, F.lit(1.0 / len(names))) for n in names]


def disjoint_union(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """All parts under `part`, in the order given; a key in two of them fails the run."""
    named = [rows.withColumn("part", F.lit(name)).withColumn("part_order", F.lit(k)) for k, (name, rows) in enumerate(parts.items())]
    union = reduce(DataFrame.unionByName, named)
    shared = union.groupBy(F.col(key).alias("shared_key")).agg(F.count_distinct("part").alias("n_parts"))
    joined = union.join(shared, F.col(key) == F.col("shared_key"))
    return required(joined, F.col("n_parts") == 1, f"{key} in more than one part").drop("shared_key", "n_parts")
