"""Joins with guards, interval and similarity joins, set operations and splits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchweave.operators.contracts import required
from matchweave.sources.storage import stored


def latest_state(rows: DataFrame, entity: str, state: str, order: list[str]) -> DataFrame:
    """Each entity's last state in the given order."""
    return rows.groupBy(entity).agg(F.max_by(F.col(state), F.struct(*order)).alias(state), F.count("*").alias("rows"))


def with_default(rows: DataFrame, lookup: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """Left lookup; entities without a row get the default."""
    return rows.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of matched rows and of rows without a partner on either side."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("l") & F.col("r")).alias("matched"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only")
    )


def interval_label(rows: DataFrame, windows: DataFrame, key: str, day: str) -> DataFrame:
    """The first window (by start) of the row's key that holds the day; null without one.

    Windows are cut into days, so that the join is on equal keys and days instead of a range.
    """
    days = windows.select(key, "label", "start_date", F.explode(F.sequence("start_date", "end_date")).alias(day))
    first = days.groupBy(key, day).agg(F.min_by("label", F.struct("start_date", "label")).alias("label"))
    return rows.join(first, [key, day], "left")


def best_name_match(left: DataFrame, right: DataFrame, day: str) -> DataFrame:
    """Pairs of one day by normalised names: exact first, else one name inside the other (four letters at least).

    left(l_id, day, l_home, l_away), right(r_id, day, r_home, r_away) -> l_id, r_id, method, confidence.
    Only distinct names of a day are compared, each with its first r_id. A home name that lies inside another equals one of
    that one's parts: the parts as long as some name of the other side are joined with those names. Both sides can be
    large once cut into parts, whatever their tables' size, so that none is broadcast.
    """
    teams = left.select(day, "l_home", "l_away").distinct()
    others = right.groupBy(day, "r_home", "r_away").agg(F.min("r_id").alias("r_id"))
    names = [day, "l_home", "l_away", "r_home", "r_away", "r_id"]

    def long_enough(*columns: str) -> Column:
        return reduce(lambda x, y: x & y, (F.length(c) >= 4 for c in columns))

    def lengths(rows: DataFrame, name: str) -> DataFrame:
        return rows.where(long_enough(name)).agg(F.collect_set(F.length(name)).alias("lengths"))

    def parts(rows: DataFrame, name: str, sought: DataFrame) -> DataFrame:
        fits = F.filter("lengths", lambda n: n <= F.length(name))
        cut = F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda k: F.substring(F.col(name), k, n)))
        held = rows.where(long_enough(name)).crossJoin(F.broadcast(sought))
        return held.withColumn("part", F.explode(F.array_distinct(F.flatten(cut)))).drop("lengths")

    same = teams.join(others.hint("merge"), (teams[day] == others[day]) & (teams.l_home == others.r_home) & (teams.l_away == others.r_away)).drop(others[day])
    l, r = (x.where(long_enough(f"{s}_home", f"{s}_away")) for x, s in ((teams, "l"), (others, "r")))
    l_parts, r_parts = parts(l, "l_home", lengths(r, "r_home")), parts(r, "r_home", lengths(l, "l_home"))
    inside = F.contains(F.col("l_away"), F.col("r_away")) | F.contains(F.col("r_away"), F.col("l_away"))
    found = [
        l.join(r_parts.hint("merge"), (l[day] == r_parts[day]) & (l.l_home == r_parts.part)).drop(r_parts[day]),
        r.join(l_parts.hint("merge"), (r[day] == l_parts[day]) & (r.r_home == l_parts.part)).drop(l_parts[day]),
    ]
    partly = found[0].select(*names).unionByName(found[1].select(*names)).where(inside)
    pairs = same.select(*names, F.lit(0).alias("k")).unionByName(partly.select(*names, F.lit(1).alias("k")))
    best = pairs.groupBy(day, "l_home", "l_away").agg(F.min(F.struct("k", "r_id")).alias("b"))
    matched = left.join(best.hint("merge"), [day, "l_home", "l_away"]).groupBy("l_id").agg(F.min("b").alias("b"))
    exact = F.col("b.k") == 0
    return matched.select(
        "l_id", "b.r_id", F.when(exact, "exact").otherwise("substring").alias("method"), F.when(exact, 1.0).otherwise(0.8).alias("confidence")
    )


VECTOR = ("p_home", "p_draw", "p_away", "lambda_home", "lambda_away")


def _similarity(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    """Similarity in per cent, rounded to a tenth, of every query to every candidate of a block.

    0.7 of the probability distance and 0.3 of the rate distance / 5, 0.15 more if the picks differ.
    """
    gap = [(q[n].to_numpy()[:, None] - c[n].to_numpy()[None, :]) ** 2 for n in VECTOR]
    distance = 0.7 * np.sqrt(gap[0] + gap[1] + gap[2]) + 0.3 * np.sqrt(gap[3] + gap[4]) / 5
    distance += 0.15 * (q["pick"].to_numpy()[:, None] != c["pick"].to_numpy()[None, :])
    return np.floor(1000 * np.maximum(0, 1 - distance / np.sqrt(2)) + 0.5) / 10


#: Pairs of a block up to which comparing them all takes less time than finding kinds of rows.
SMALL = 2**17


def _kinds(c: pd.DataFrame) -> list[np.ndarray]:
    """Places of the rows of each kind in ascending order; rows of one kind are equally similar to any query."""
    kind = c.groupby([*VECTOR, "pick"], sort=False, dropna=False).ngroup().to_numpy()
    return np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind))[:-1])


def _keys(similar: np.ndarray, places: np.ndarray, fits: np.ndarray, n: int, least: float) -> np.ndarray:
    return np.rint(np.where(fits & (similar >= least), similar, -1) * 10).astype(np.int64) * n - places


def _all_keys(q: pd.DataFrame, c: pd.DataFrame, places: np.ndarray, k: int, least: float) -> np.ndarray:
    """Keys of all rows at these places for each query."""
    cs = c.iloc[places]
    earlier = cs["unix"].to_numpy()[None, :] < q["unix"].to_numpy()[:, None]
    return _keys(_similarity(q, cs), places, earlier, len(c), least)


def _next_keys(q: pd.DataFrame, c: pd.DataFrame, places: np.ndarray, k: int, least: float) -> np.ndarray:
    """Keys of the k rows of one kind that come first among those before each query; no other of the kind can be among its k best."""
    ahead = -c["unix"].to_numpy()[places]
    at = np.searchsorted(ahead, -q["unix"].to_numpy(), side="right")[:, None] + np.arange(min(k, len(places)))
    return _keys(_similarity(q, c.iloc[places[:1]]), places[np.minimum(at, len(places) - 1)], at < len(places), len(c), least)


def _block_top(q: pd.DataFrame, c: pd.DataFrame, k: int, least: float, q_rows: int = 256, c_rows: int = 8192) -> pd.DataFrame:
    # in the order that breaks ties, so that a row's key tells its similarity and its place and no two are equal
    c = c.sort_values(["unix", "fixture_id"], ascending=[False, True]).reset_index(drop=True)
    codes = {v: n for n, v in enumerate(pd.unique(pd.concat([q["pick"], c["pick"]])))}
    q, c = (x.assign(pick_name=x["pick"], pick=x["pick"].map(codes)) for x in (q, c))
    # with enough rows to a kind, each kind gives the k that come next before the query; else, and in small blocks, all rows are compared
    kinds = _kinds(c) if len(q) * len(c) > SMALL else []
    few = 0 < len(kinds) * k < len(c)
    parts = kinds if few else [np.arange(t, min(t + c_rows, len(c))) for t in range(0, len(c), c_rows)]
    keyed, q_rows = (_next_keys, c_rows) if few else (_all_keys, q_rows)
    found = []
    for s in range(0, len(q), q_rows):
        qs, best = q.iloc[s : s + q_rows], None
        for places in parts:
            keys = keyed(qs, c, places, k, least)
            if keys.shape[1] > k:
                keys = np.partition(keys, -k, axis=1)[:, -k:]
            best = keys if best is None else np.concatenate([best, keys], axis=1)
            if best.shape[1] > k:
                best = np.partition(best, -k, axis=1)[:, -k:]
        if best is not None:
            level = -(-best // len(c))
            i, n = np.nonzero(level >= 0)
            level, j = level[i, n], (level * len(c) - best)[i, n]
            found.append(
                pd.DataFrame({
                    "query_id": qs["fixture_id"].to_numpy()[i], "match_id": c["fixture_id"].to_numpy()[j], "similarity": level / 10,
                    "unix": c["unix"].to_numpy()[j], "pick": qs["pick_name"].to_numpy()[i], "outcome": c["outcome"].to_numpy()[j],
                })
            )
    columns = ["query_id", "match_id", "similarity", "unix", "pick", "outcome"]
    return pd.concat(found)[columns] if found else pd.DataFrame(columns=columns)


#: Widths of the index's cells in probability and in rate, and the number of cells of a rate.
CELLS = (0.1, 0.75, 8)


def _cell(row: dict[str, Column], group: Column) -> Column:
    """Name of a row's cell: its group and the bins of two probabilities and both rates; ends are open."""
    wide, tall, top = CELLS
    bins = [F.floor(row[n] / wide) for n in ("p_home", "p_draw")] + [F.floor(row[n] / tall) for n in ("lambda_home", "lambda_away")]
    held = [F.least(F.greatest(b, F.lit(0)), F.lit(round(1 / wide) - 1 if k < 2 else top - 1)) for k, b in enumerate(bins)]
    return F.concat_ws("/", group.cast("string"), *(b.cast("string") for b in held))


def _compared(asked: DataFrame, rows: DataFrame, sizes: DataFrame, k: int, least: float, slice_rows: int) -> DataFrame:
    """The k best rows of a cell for each query that is to search it, by task.

    asked holds queries with a `cell` to search, rows have their own `cell`, sizes their number by cell. Both sides of
    a cell are dealt into slices of about slice_rows rows and a task compares one slice of each. Rows that are not before
    the last query of their cell stay behind.
    """
    slices = asked.groupBy("cell").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("q_slices"), F.max("unix").alias("until")).join(
        sizes.select("cell", F.ceil(F.col("n") / slice_rows).cast("int").alias("c_slices")), "cell"
    )

    def dealt(df: DataFrame, own: str, other: str, when: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("fixture_id"), F.col(f"{own}_slices")).cast("int")
        return df.join(slices, "cell").where(when).select(*df.columns, mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(f"{other}_slices") - 1)).alias(other))

    def named(df: DataFrame, side: str):
        # dealt by number, because few bytes can be much work and would be merged into one task
        keys = [f"{side}_{c}" for c in ("cell", "q", "c")]
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)).repartition(tasks, *keys).groupBy(*keys)

    def top(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        q, c = (x.rename(columns=lambda n: n.split("_", 1)[1]) for x in (q, c))
        return _block_top(q if len(c) else q.iloc[:0], c, k, least)

    return named(dealt(asked, "q", "c", "unix <= until"), "asked").cogroup(named(dealt(rows, "c", "q", "unix < until"), "row")).applyInPandas(
        top, "query_id long, match_id long, similarity double, unix long, pick string, outcome string"
    )


#: Stands for a missing id inside nearest_past, where ids are numpy integers; like a null it comes last.
NO_ID = 2**63 - 1


def asked_once(queries: DataFrame, group: str = "competition_id") -> DataFrame:
    """What nearest_past asks for with `asked_as`, the smallest id among those of the same group, vector, pick and time, and `copy`.

    Such queries have the same neighbours, so that nearest_past need search only for the rows that are asked as
    themselves. The rows of a repeated id share one list of neighbours: each is asked as itself; `copy` counts them from 1.
    """
    same = W.partitionBy("fixture_id")
    counted = queries.select("fixture_id", group, "unix", *VECTOR, "pick").withColumns({"copies": F.count("*").over(same), "copy": F.row_number().over(same.orderBy("unix"))})
    alone = F.when(F.col("copies") > 1, F.col("fixture_id"))
    alike = W.partitionBy(group, "unix", *VECTOR, "pick", F.col("copies") > 1, alone)
    return counted.withColumn("asked_as", F.min("fixture_id").over(alike)).drop("copies")


def nearest_past(rows: DataFrame, queries: DataFrame, k: int = 8, least: float = 60.0, group: str = "competition_id", slice_rows: int = 20_000) -> DataFrame:
    """The k most similar earlier rows of the same group for each query of a stated query set, exactly.

    Rows lie in cells of a grid over probabilities and rates; the number of cells follows from the grid, not from the
    rows. A query first searches its own cell, which gives the similarity that k rows reach. It then searches
    those other cells whose bounding box lets a row reach it as well and that hold earlier rows; far cells are never paired.
    In either round a task compares a slice of a cell's queries with a slice of its rows, each of about slice_rows,
    and keeps its own k best, so that pairs never leave it. Rows and queries with a null among the compared columns
    have no neighbours; those without an id count as the others, and come last among equals.
    """
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("unix"), "match_id")
    names = ["fixture_id", "unix", *VECTOR, "pick"]

    def prepared(df: DataFrame, *more: str) -> DataFrame:
        cell = _cell({n: F.col(n) for n in VECTOR}, F.col(group))
        known = df.withColumn("fixture_id", F.coalesce("fixture_id", F.lit(NO_ID)))
        return known.select(*names, F.col(group).alias("held"), cell.alias("cell"), *more).dropna(subset=["unix", "held", *VECTOR])

    c, q = prepared(rows, "outcome"), prepared(queries)
    boxes = stored(c.groupBy("cell", "held").agg(F.count("*").alias("n"), F.min("unix").alias("first"), *(f(n).alias(f"{f.__name__}_{n}") for n in VECTOR for f in (F.min, F.max))))
    own = stored(_compared(q, c.drop("held"), boxes, k, least, slice_rows))
    reached = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("fixture_id"), F.col("similarity").alias("reached"))
    gap = {n: F.greatest(F.col(f"min_{n}") - F.col(n), F.col(n) - F.col(f"max_{n}"), F.lit(0.0)) for n in VECTOR}
    squares = [gap[n] * gap[n] for n in VECTOR]
    nearest = 0.7 * F.sqrt(squares[0] + squares[1] + squares[2]) + 0.3 * F.sqrt(squares[3] + squares[4]) / 5
    best = 100 * (1 - nearest / 2**0.5) + 0.05 + 1e-9
    others = boxes.withColumnRenamed("cell", "other")
    asked = (
        q.join(reached, "fixture_id", "left")
        .join(others, "held")
        .where((F.col("other") != F.col("cell")) & (F.col("first") < F.col("unix")) & (best >= F.coalesce("reached", F.lit(least))))
        .select(*names, F.col("other").alias("cell"))
    )
    found = own.unionByName(_compared(stored(asked), c.drop("held"), boxes, k, least, slice_rows))
    ids = {c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("query_id", "match_id")}
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("unix").withColumns(ids)


def evidence(neighbours: DataFrame, least: int = 3) -> DataFrame:
    """Share of analogues whose outcome was the query's pick, with a level by sample and share."""
    found = neighbours.groupBy("query_id").agg(F.count("*").alias("n"), F.avg((F.col("outcome") == F.col("pick")).cast("double")).alias("success"))
    return found.withColumn(
        "level",
        F.when(F.col("n") < least, "INSUFFICIENT").when(F.col("success") >= 0.75, "HIGH").when(F.col("success") >= 0.5, "MODERATE").otherwise("CAUTION"),
    )


def folds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Every row under each (fold, role) that names its season; one pass for all folds."""
    return rows.join(F.broadcast(plan), "season_year")


def temporal_safety(split: DataFrame) -> DataFrame:
    """Per fold: rows by role, whether training ends before evaluation starts, and shared keys."""
    train, test = F.col("role") == "train", F.col("role") == "eval"
    keys = split.groupBy("fold", "fixture_id").agg(F.max(train.cast("int")).alias("t"), F.max(test.cast("int")).alias("e"))
    shared = keys.groupBy("fold").agg(F.sum(F.col("t") * F.col("e")).alias("shared_keys"))
    ends = split.groupBy("fold").agg(
        F.count_if(train).alias("n_train"), F.count_if(test).alias("n_eval"), (F.max(F.when(train, F.col("unix"))) < F.min(F.when(test, F.col("unix")))).alias("ordered")
    )
    return ends.join(shared, "fold")


def final_split(rows: DataFrame, walked: set[int], train: set[int], test: set[int], season: str = "season_year", time: str = "unix") -> DataFrame:
    """Rows of the last split under `role`: train or eval.

    walked holds all seasons of the walk-forward folds. The test seasons must be untouched by them and by training (an
    error here), and training must end before they start (the run fails on the first row otherwise).
    """
    if test & (walked | train):
        raise ValueError(f"the final test seasons {sorted(test & (walked | train))} are used before")
    role = F.when(F.col(season).isin(*train), "train").when(F.col(season).isin(*test), "eval")
    split = rows.withColumn("role", role).where("role is not null")
    bounds = split.agg(F.max(F.when(F.col("role") == "train", F.col(time))).alias("__end"), F.min(F.when(F.col("role") == "eval", F.col(time))).alias("__start"))
    safe = F.coalesce(F.col("__end") < F.col("__start"), F.lit(True))
    return required(split.crossJoin(F.broadcast(bounds)), safe, "training reaches into the final test seasons").drop("__end", "__start")


def alignment(left: DataFrame, right: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """One row of counts that are all zero if two arms predict the same rows: keys that an arm lacks or repeats, and keys
    whose place in time or label differs between the arms."""
    arms = [
        rows.groupBy(key).agg(F.count("*").alias(f"n_{s}"), F.min(order).alias(f"order_{s}"), F.min(label).alias(f"label_{s}")) for s, rows in (("left", left), ("right", right))
    ]
    both = arms[0].join(arms[1], key, "full_outer")
    shared = F.col("n_left").isNotNull() & F.col("n_right").isNotNull()
    return both.agg(
        F.count("*").alias("keys"), F.count_if(F.col("n_left").isNull()).alias("missing_left"), F.count_if(F.col("n_right").isNull()).alias("missing_right"),
        F.count_if(F.col("n_left") > 1).alias("repeated_left"), F.count_if(F.col("n_right") > 1).alias("repeated_right"),
        F.count_if(shared & ~F.col("order_left").eqNullSafe(F.col("order_right"))).alias("moved"),
        F.count_if(shared & ~F.col("label_left").eqNullSafe(F.col("label_right"))).alias("relabelled"),
    )
