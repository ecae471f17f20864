"""Contest tables derived from the provided tables, as DataFrames and as DuckDB CTEs.

Every order stands for a contest between two of a hundred teams in five competitions; predictions,
odds and ledgers follow from it by integer arithmetic, so that Spark and DuckDB agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAYED = ("FT", "AWARDED")
OUTCOMES = ("H", "D", "A")


def _digits(divisor: int, modulus: int) -> str:
    return f"(cast(floor(o_totalprice / {divisor}) as bigint) % {modulus})"


_STATUS = "case when o_orderstatus = 'P' and o_orderkey % 10 = 0 then 'ABANDONED' when o_orderkey % 50 = 7 then 'NS' else 'FT' end"
_HOME = "o_custkey % 100"


def _stat(divisor: int, modulus: int, scale: int = 1, since: int = 0) -> str:
    value = f"cast({_digits(divisor, modulus)} as double) / {scale}" if scale > 1 else _digits(divisor, modulus)
    gone = f"year(o_orderdate) < {since} or " if since else ""
    return f"case when {gone}{_STATUS} <> 'FT' then null else {value} end"


def _contest_columns(epoch: str) -> dict[str, str]:
    return {
        "fixture_id": "o_orderkey",
        "unix": epoch,
        "home_id": _HOME,
        "away_id": f"({_HOME} + 5 * (1 + o_orderkey % 19)) % 100",
        "competition_id": f"({_HOME}) % 5",
        "season_id": f"cast(year(o_orderdate) as bigint) * 10 + ({_HOME}) % 5",
        "season_year": "cast(year(o_orderdate) as bigint)",
        "status": _STATUS,
        "home_goals": _stat(1, 5),
        "away_goals": _stat(7, 4),
        "home_xg": _stat(1, 300, 100, 1997),
        "away_xg": _stat(3, 250, 100, 1997),
        "home_shots": _stat(17, 21),
        "away_shots": _stat(19, 18),
        "home_shots_on": _stat(23, 9),
        "away_shots_on": _stat(29, 8),
    }


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contest: ids, kickoff (epoch seconds), status, goals and match statistics."""
    columns = _contest_columns("unix_timestamp(o_orderdate)")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*(F.expr(e).alias(c) for c, e in columns.items()))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per played contest: two models' probabilities, goal rates, rating gap and outcome."""
    return _predicted(
        spark.read.parquet(f"{sf_dir}/orders.parquet").select(
            *(F.expr(e).alias(c) for c, e in {**_contest_columns("unix_timestamp(o_orderdate)"), **_WEIGHTS}.items())
        )
    )


_WEIGHTS = {
    "a": f"1 + {_digits(1, 7)}",
    "b": f"1 + {_digits(11, 5)}",
    "c": f"1 + {_digits(13, 6)}",
    "elo_diff": f"cast({_digits(5, 401)} - 200 as double)",
}
_PREDICTED = {
    "fixture_id": "fixture_id",
    "unix": "unix",
    "competition_id": "competition_id",
    "season_id": "season_id",
    "season_year": "season_year",
    "home_goals": "home_goals",
    "away_goals": "away_goals",
    "y_true": "case when home_goals > away_goals then 'H' when home_goals < away_goals then 'A' else 'D' end",
    "p_home": "cast(a as double) / (a + b + c)",
    "p_draw": "cast(b as double) / (a + b + c)",
    "p_away": "cast(c as double) / (a + b + c)",
    "q_home": "power(a, 1 / 1.2e0) / (power(a, 1 / 1.2e0) + power(b, 1 / 1.2e0) + power(c, 1 / 1.2e0))",
    "q_draw": "power(b, 1 / 1.2e0) / (power(a, 1 / 1.2e0) + power(b, 1 / 1.2e0) + power(c, 1 / 1.2e0))",
    "q_away": "power(c, 1 / 1.2e0) / (power(a, 1 / 1.2e0) + power(b, 1 / 1.2e0) + power(c, 1 / 1.2e0))",
    "lambda_home": "0.5e0 + a / 4e0",
    "lambda_away": "0.4e0 + c / 4e0",
    "elo_diff": "elo_diff",
}


def _predicted(raw: DataFrame) -> DataFrame:
    return raw.where("status = 'FT'").select(*(F.expr(e).alias(c) for c, e in _PREDICTED.items()))


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long odds: (fixture_id, bookmaker_id, outcome, opening, closing), null where not quoted."""
    p = predictions(spark, sf_dir)
    return p.select(
        "fixture_id",
        "competition_id",
        "season_id",
        (F.col("fixture_id") % 3).alias("bookmaker_id"),
        F.explode(
            F.array(*(F.struct(F.lit(o).alias("outcome"), F.col(c).alias("p"), F.col(q).alias("q")) for o, c, q in (("home", "p_home", "q_home"), ("draw", "p_draw", "q_draw"), ("away", "p_away", "q_away"))))
        ).alias("o"),
    ).select(
        "fixture_id",
        "competition_id",
        "season_id",
        "bookmaker_id",
        "o.outcome",
        F.when(F.col("fixture_id") % 13 != 0, 1 / (1.06 * F.col("o.q"))).alias("opening"),
        F.when((F.col("fixture_id") % 17 != 0) | (F.col("o.outcome") == "home"), 1 / (1.05 * F.col("o.p"))).alias("closing"),
    )


def _cte(name: str, columns: dict[str, str], source: str) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source})"


_EPOCH = "cast(epoch(o_orderdate) as bigint)"
CONTESTS = _cte("contests", _contest_columns(_EPOCH), "orders")
PREDS = (
    _cte("raw_preds", {**_contest_columns(_EPOCH), **_WEIGHTS}, "orders")
    + ", "
    + _cte("preds", _PREDICTED, "raw_preds WHERE status = 'FT'")
)
ODDS = PREDS + """, odds AS (
  SELECT fixture_id, competition_id, season_id, fixture_id % 3 AS bookmaker_id, outcome,
         CASE WHEN fixture_id % 13 <> 0 THEN 1 / (1.06e0 * q) END AS opening,
         CASE WHEN fixture_id % 17 <> 0 OR outcome = 'home' THEN 1 / (1.05e0 * p) END AS closing
  FROM (SELECT *, 'home' AS outcome, p_home AS p, q_home AS q FROM preds UNION ALL SELECT *, 'draw', p_draw, q_draw FROM preds
        UNION ALL SELECT *, 'away', p_away, q_away FROM preds))"""
