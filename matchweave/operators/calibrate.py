"""Calibration and model fits: Spark does the sums over rows, the driver solves for a few numbers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import exp, log, sqrt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.functions.probability import entropy, logit, poisson_pmf, poisson_table, sigmoid, tail_safe_sums, temperature
from matchweave.operators.metrics import p_true, quantiles

LABELS = ("H", "D", "A")


def fit_platt(rows: DataFrame, score: Column, label: Column, weight: Column | None = None, rounds: int = 12) -> tuple[float, float]:
    """(slope, intercept) of a one-dimensional logistic by Newton steps; each step is one aggregate of five sums."""
    return fit_platts(rows, {"": (score, label)}, weight, rounds)[""]


def fit_platts(rows: DataFrame, pairs: dict[str, tuple[Column, Column]], weight: Column | None = None, rounds: int = 12) -> dict[str, tuple[float, float]]:
    """The logistics of several (score, label), by name: a step of all that still move is one aggregate."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    columns = [c for k, (x, y) in enumerate(pairs.values()) for c in (x.alias(f"x{k}"), y.cast("double").alias(f"y{k}"))]
    data = rows.select(*columns, w.alias("w")).persist()
    found, moving = {k: (1.0, 0.0) for k in range(len(pairs))}, set(range(len(pairs)))

    def sums(k: int) -> Column:
        (a, b), x = found[k], F.col(f"x{k}")
        p = sigmoid(F.lit(a) * x + F.lit(b))
        g, h = F.col("w") * (p - F.col(f"y{k}")), F.col("w") * p * (1 - p)
        return F.struct(F.sum(g * x).alias("gx"), F.sum(g).alias("g"), F.sum(h * x * x).alias("hxx"), F.sum(h * x).alias("hx"), F.sum(h).alias("h")).alias(f"s{k}")

    try:
        for _ in range(rounds):
            if not moving:
                break
            row = data.agg(*(sums(k) for k in sorted(moving))).first()
            for k in sorted(moving):
                s = row[f"s{k}"]
                hxx, hh = (0.0, 0.0) if s.h is None else (s.hxx + 1e-9, s.h + 1e-9)
                det = hxx * hh - s.hx * s.hx if hh else 0.0
                if det <= 0:
                    moving.discard(k)
                    continue
                da, db = (hh * s.gx - s.hx * s.g) / det, (hxx * s.g - s.hx * s.gx) / det
                found[k] = found[k][0] - da, found[k][1] - db
                if max(abs(da), abs(db)) < 1e-10:
                    moving.discard(k)
    finally:
        data.unpersist()
    return dict(zip(pairs, found.values(), strict=True))


def platt_per_class(train: DataFrame, rows: DataFrame, p: dict[str, str], label: str = "y_true") -> DataFrame:
    """Each class's probability through its own logistic, renormalised: columns cal_H, cal_D, cal_A."""
    return PlattCalibrator(p, label).fit(train).transform(rows)


def isotonic_per_class(train: DataFrame, rows: DataFrame, p: dict[str, str], label: str = "y_true") -> DataFrame:
    """Each class's probability through its own monotone step function, renormalised."""
    return IsotonicCalibrator(p, label).fit(train).transform(rows)


def fit_rho(rows: DataFrame, groups: list[str], grid: list[float]) -> DataFrame:
    """Dependence of the four low scores by likelihood over a grid, per group, with its standard error."""
    lh, la, rho = F.col("lambda_home"), F.col("lambda_away"), F.col("rho")
    h, a = F.col("home_goals"), F.col("away_goals")
    tau = (
        F.when((h == 0) & (a == 0), 1 - lh * la * rho)
        .when((h == 0) & (a == 1), 1 + lh * rho)
        .when((h == 1) & (a == 0), 1 + la * rho)
        .when((h == 1) & (a == 1), 1 - rho)
        .otherwise(1.0)
    )
    slope = (
        F.when((h == 0) & (a == 0), lh * la).when((h == 0) & (a == 1), lh).when((h == 1) & (a == 0), la).when((h == 1) & (a == 1), F.lit(1.0)).otherwise(0.0)
    )
    low = rows.where("home_goals <= 1 and away_goals <= 1")
    curve = (
        low.withColumn("rho", F.explode(F.array(*map(F.lit, grid))))
        .groupBy(*groups, "rho")
        .agg(F.sum(F.log(F.greatest(tau, F.lit(1e-9)))).alias("ll"), F.sum(F.pow(slope / F.greatest(tau, F.lit(1e-9)), F.lit(2))).alias("info"), F.count("*").alias("n"))
    )
    best = curve.groupBy(*groups).agg(F.max_by(F.struct("rho", "ll", "info", "n"), F.struct("ll", -F.abs("rho"))).alias("b"))
    return best.select(*groups, "b.rho", "b.ll", (1 / F.sqrt("b.info")).alias("se"), "b.n")


def binned_curve(rows: DataFrame, value: str, width: float, happened: Column, least: int = 10) -> DataFrame:
    """Share per bin of a value; bins with too few rows take the overall share."""
    bins = rows.groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(happened.cast("double")).alias("own"))
    whole = rows.agg(F.avg(happened.cast("double")).alias("overall"))
    return bins.crossJoin(F.broadcast(whole)).select("bin", "n", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("overall")).alias("share"))


def preprocess(train: DataFrame, rows: DataFrame, numeric: list[str], category: str | None = None) -> DataFrame:
    """Median-filled, standardised by population deviation, and one-hot columns, all learnt on train alone."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in numeric))).alias("c")
    medians = quantiles(train.select(cells).select("c.*"), "x", [0.5], ["column"])
    stats = medians.agg(*(F.max(F.when(F.col("column") == c, F.get("q", F.lit(0)))).alias(f"m_{c}") for c in numeric))
    filled = train.crossJoin(F.broadcast(stats)).agg(
        *(F.first(f"m_{c}").alias(f"m_{c}") for c in numeric),
        *(F.avg(F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}"))).alias(f"a_{c}") for c in numeric),
        *(F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}"))).alias(f"s_{c}") for c in numeric),
    )
    out = rows.crossJoin(F.broadcast(filled)).withColumns(
        {f"z_{c}": (F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}")) - F.col(f"a_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in numeric}
    )
    out = out.drop(*(f"{k}_{c}" for k in "mas" for c in numeric))
    if category:
        known = sorted(r[0] for r in train.select(category).where(F.col(category).isNotNull()).distinct().collect())
        out = out.withColumns({f"is_{category}_{k}": F.coalesce((F.col(category) == k).cast("double"), F.lit(0.0)) for k in known})
    return out


def category_codes(train: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Dense codes in order of the category; unseen ones are -1. Only the distinct categories are ranked."""
    from pyspark.sql import Window as W

    codes = train.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", F.dense_rank().over(W.orderBy(column)) - 1)
    return rows.join(codes, column, "left").withColumn("code", F.coalesce("code", F.lit(-1)))


class Calibrator:
    """The protocol: fit(train) learns, transform(rows) adds cal_<class> columns that sum to one. This one changes nothing.

    With `weight`, a row of train stands for so many, as after counting() of equal ones.
    """

    def __init__(self, p: dict[str, str], label: str = "y_true", weight: str | None = None):
        self.p, self.label, self.weight = p, label, weight

    def fit(self, train: DataFrame) -> Calibrator:
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"cal_{v}": F.col(c) for v, c in self.p.items()})

    @staticmethod
    def _normalised(rows: DataFrame, raw: dict[str, Column]) -> DataFrame:
        parts = list(raw.values())
        total = sum(parts[1:], parts[0])
        return rows.withColumns({f"cal_{v}": x / total for v, x in raw.items()})


class PlattCalibrator(Calibrator):
    """A logistic curve of each class's logit, renormalised."""

    def fit(self, train: DataFrame) -> Calibrator:
        pairs = {v: (logit(F.col(c)), F.col(self.label) == v) for v, c in self.p.items()}
        self.curves = fit_platts(train, pairs, F.col(self.weight) if self.weight else None)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return self._normalised(rows, {v: sigmoid(a * logit(F.col(self.p[v])) + b) for v, (a, b) in self.curves.items()})


class IsotonicCalibrator(Calibrator):
    """A monotone step function of each class's probability, held to [1e-6, 1 - 1e-6] and renormalised."""

    def fit(self, train: DataFrame) -> Calibrator:
        self.models = {v: IsotonicRegression(featuresCol=c, labelCol="__y", weightCol="__w", predictionCol=f"__{v}").fit(self._places(train, v)) for v, c in self.p.items()}
        return self

    def _places(self, train: DataFrame, v: str) -> DataFrame:
        """One row for each value of a probability: the share of the class there and its weight. A fit keeps equal values in one task."""
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        y = (F.col(self.label) == v).cast("double")
        return train.groupBy(self.p[v]).agg((F.sum(w * y) / F.sum(w)).alias("__y"), F.sum(w).alias("__w"))

    def transform(self, rows: DataFrame) -> DataFrame:
        out = rows
        for model in self.models.values():
            out = model.transform(out)
        held = {v: F.least(F.greatest(F.col(f"__{v}"), F.lit(1e-6)), F.lit(1 - 1e-6)) for v in self.p}
        return self._normalised(out, held).drop(*(f"__{v}" for v in self.p))


class TemperatureCalibrator(Calibrator):
    """One temperature for all classes: that of least log loss on train among the given ones, the first of equal ones."""

    def __init__(self, p: dict[str, str], label: str = "y_true", settings: tuple[float, ...] = tuple(k / 20 for k in range(10, 41)), weight: str | None = None):
        super().__init__(p, label, weight)
        self.settings = settings

    def _scaled(self, t: Column | float) -> dict[str, Column]:
        return dict(zip(self.p, temperature([F.col(c) for c in self.p.values()], t), strict=True))

    def fit(self, train: DataFrame) -> Calibrator:
        def loss(t: Column) -> Column:
            expr = None
            for v, x in self._scaled(t).items():
                term = -F.log(F.greatest(x, F.lit(1e-15)))
                expr = F.when(F.col(self.label) == v, term) if expr is None else expr.when(F.col(self.label) == v, term)
            return expr

        self.setting = searched(train, loss, list(self.settings), [], self.weight).first()["setting"]
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return self._normalised(rows, self._scaled(self.setting))


def counting(rows: DataFrame, columns: list[str], weight: str = "weight") -> DataFrame:
    """Equal rows once, with their number."""
    return rows.groupBy(*columns).agg(F.count("*").alias(weight))


CALIBRATORS = {"uncalibrated": Calibrator, "platt": PlattCalibrator, "isotonic": IsotonicCalibrator, "temperature": TemperatureCalibrator}


def split_search(splits: list[tuple], settings: list[float], fit_predict: Callable[[DataFrame, DataFrame, float], DataFrame]) -> DataFrame:
    """(setting, splits, mean_loss, best) of a callback that may refit: fit_predict(train, test, setting) -> rows with `loss`.

    splits are (name, train, test). Each split counts alike; the first setting wins ties.
    """
    parts = [
        fit_predict(train, test, s).agg(F.avg("loss").alias("loss")).select(F.lit(str(name)).alias("split"), F.lit(float(s)).alias("setting"), "loss")
        for name, train, test in splits
        for s in settings
    ]
    curve = reduce(DataFrame.unionByName, parts).groupBy("setting").agg(F.count("loss").alias("splits"), F.avg("loss").alias("mean_loss"))
    best = curve.agg(F.min_by("setting", F.struct(F.round("mean_loss", 12), "setting")).alias("__best"))
    return curve.crossJoin(F.broadcast(best)).select("setting", "splits", "mean_loss", (F.col("setting") == F.col("__best")).alias("best"))


def searched(rows: DataFrame, loss, settings: list[float], groups: list[str], weight: str | None = None) -> DataFrame:
    """The setting of least mean loss per group; loss(setting column) gives each row's loss. The first wins ties."""
    tried = rows.withColumn("setting", F.explode(F.array(*map(F.lit, settings))))
    each = loss(F.col("setting"))
    mean = F.sum(each * F.col(weight)) / F.sum(F.when(each.isNotNull(), F.col(weight))) if weight else F.avg(each)
    curve = tried.groupBy(*groups, "setting").agg(mean.alias("loss"))
    return curve.groupBy(*groups).agg(F.min_by("setting", F.struct(F.round("loss", 12), "setting")).alias("setting"), F.min("loss").alias("loss"))


def features(columns: list[str]) -> list:
    filled = [f"{c}__filled" for c in columns]
    return [Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features")]


def outcome_model(train: DataFrame, columns: list[str], c: float = 1.0, n: int | None = None):
    """Multinomial logistic regression on median-filled features; c is the inverse penalty per row."""
    n = n or train.count()
    labelled = train.withColumn("label", F.when(F.col("y_true") == "H", 0.0).when(F.col("y_true") == "D", 1.0).otherwise(2.0))
    return Pipeline(stages=[*features(columns), LogisticRegression(family="multinomial", regParam=1.0 / (c * max(n, 1)), maxIter=50)]).fit(labelled)


def binary_model(train: DataFrame, columns: list[str], label: str, weight: str, penalty: float = 1e-4):
    """Weighted logistic regression of a 0/1 label."""
    logistic = LogisticRegression(family="binomial", labelCol=label, weightCol=weight, regParam=penalty, maxIter=50)
    return Pipeline(stages=[*features(columns), logistic]).fit(train)


def goal_models(train: DataFrame, columns: list[str], penalty: float = 0.01, weight: str | None = None):
    """Two Poisson regressions, home and away goals, optionally weighted."""
    out = []
    for side in ("home", "away"):
        glm = GeneralizedLinearRegression(family="poisson", link="log", regParam=penalty, labelCol=f"{side}_goals", predictionCol=f"fit_{side}", maxIter=25)
        if weight:
            glm = glm.setWeightCol(weight)
        out.append(Pipeline(stages=[*features(columns), glm]).fit(train))
    return out


def score_goals(models, rows: DataFrame) -> DataFrame:
    """Both goal rates of every row, clipped to [0.05, 8]."""
    out = rows
    for model in models:
        out = model.transform(out).drop("features", *(c for c in model.transform(rows).columns if c.endswith("__filled")))
    bound = lambda c: F.least(F.greatest(F.col(c), F.lit(0.05)), F.lit(8.0))
    return out.withColumns({"fit_home": bound("fit_home"), "fit_away": bound("fit_away")})


def save_goal_models(models, path: str) -> None:
    """Write both fitted pipelines under a folder that all nodes share."""
    for side, model in zip(("home", "away"), models, strict=True):
        model.write().overwrite().save(f"{path}/{side}")


def load_goal_models(path: str) -> list[PipelineModel]:
    return [PipelineModel.load(f"{path}/{side}") for side in ("home", "away")]


def score_batch(models, rows: DataFrame) -> DataFrame:
    """rows with fit_home, fit_away, fit_win, fit_draw, fit_loss, fit_pick and fit_safe: rates and their Poisson table."""
    scored = score_goals(models, rows).withColumn("fit_sums", tail_safe_sums(F.col("fit_home"), F.col("fit_away")))
    table = poisson_table(F.col("fit_sums"), F.col("fit_home"), F.col("fit_away"))
    return scored.select(*(c for c in scored.columns if c != "fit_sums"), *(table[k].alias(f"fit_{k}") for k in ("win", "draw", "loss", "pick", "safe")))


STACKED = ("ln_home", "ln_draw", "ln_away", "risk", "rate_gap", "rate_total")


def score_space(rows: DataFrame, p: tuple[str, ...] = ("p_home", "p_draw", "p_away"), eps: float = 1e-15) -> DataFrame:
    """rows with STACKED: log-probabilities, entropy, and the gap and total of both rates."""
    logs = [F.log(F.greatest(F.col(c), F.lit(eps))) for c in p]
    gap, total = F.col("lambda_home") - F.col("lambda_away"), F.col("lambda_home") + F.col("lambda_away")
    return rows.withColumns(dict(zip(STACKED, (*logs, entropy(*map(F.col, p)), gap, total), strict=True)))


def joint_stack(train: DataFrame, valid: DataFrame, rows: DataFrame, weights: list[float]) -> tuple[float, DataFrame]:
    """A multinomial fit in score space on train, blended with the given probabilities by the weight of least loss on valid.

    Returns (weight of the stack, rows with stack_H, stack_D, stack_A and joint_H, joint_D, joint_A).
    """
    p = ("p_home", "p_draw", "p_away")
    model = outcome_model(score_space(train), list(STACKED))

    def stacked(df: DataFrame) -> DataFrame:
        out = model.transform(score_space(df)).withColumn("stack_p", vector_to_array("probability"))
        return out.select(*df.columns, *(F.get("stack_p", F.lit(k)).alias(f"stack_{v}") for k, v in enumerate("HDA")))

    names = [f"stack_{v}" for v in "HDA"]
    mix = lambda w: -F.log(F.greatest(w * p_true(names) + (1 - w) * p_true(p), F.lit(1e-15)))
    weight = searched(stacked(valid), mix, weights, []).first()["setting"]
    done = stacked(rows)
    return weight, done.withColumns({f"joint_{v}": weight * F.col(s) + (1 - weight) * F.col(c) for v, s, c in zip("HDA", names, p, strict=True)})


def boosted_goals(train: DataFrame, columns: list[str], side: str = "home"):
    return Pipeline(stages=[*features(columns), GBTRegressor(labelCol=f"{side}_goals", predictionCol=f"gbt_{side}", maxIter=10, maxDepth=3, seed=42)]).fit(train)


def risk_forest(train: DataFrame, columns: list[str], label: str):
    return Pipeline(stages=[*features(columns), RandomForestClassifier(labelCol=label, numTrees=20, maxDepth=5, seed=42)]).fit(train)


def residual_model(train: DataFrame, columns: list[str], label: str, mix: float = 0.5):
    return Pipeline(stages=[*features(columns), LinearRegression(labelCol=label, predictionCol="residual_fit", elasticNetParam=mix, regParam=0.01)]).fit(train)


def regimes(train: DataFrame, columns: list[str], k: int = 3):
    return Pipeline(stages=[*features(columns), GaussianMixture(k=k, seed=42, predictionCol="regime", probabilityCol="regime_p")]).fit(train)


def bands(train: DataFrame, rows: DataFrame, value: str, cuts: dict[str, float]) -> DataFrame:
    """Bands by percentiles of train, highest first: the first name whose percentile is reached."""
    names = list(cuts)
    edges = quantiles(train, value, list(cuts.values())).select(*(F.get("q", F.lit(k)).alias(f"__{n}") for k, n in enumerate(cuts)))
    expr = F.when(F.col(value) >= F.col(f"__{names[0]}"), names[0])
    for n in names[1:]:
        expr = expr.when(F.col(value) >= F.col(f"__{n}"), n)
    return rows.crossJoin(F.broadcast(edges)).withColumn("band", expr.otherwise("REST")).drop(*(f"__{n}" for n in names))


def normal_cdf(x: float) -> float:
    """Standard normal distribution by a polynomial of the error function's tail."""
    t = 1 / (1 + 0.2316419 * abs(x))
    d = exp(-x * x / 2) / sqrt(2 * 3.141592653589793)
    tail = d * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 1 - tail if x > 0 else tail


def decay_from_half_life(days: float) -> float:
    return log(2) / days


def cell_multiplier(rows: DataFrame, top: int, alpha: float) -> DataFrame:
    """Per score cell up to `top` goals: expected and observed share, and (n * o + alpha * e) / ((n + alpha) * e)."""
    pmf = rows.select(
        "home_goals", "away_goals", F.posexplode(poisson_pmf(F.col("lambda_home"), top)).alias("i", "ph"), poisson_pmf(F.col("lambda_away"), top).alias("pa")
    ).select("home_goals", "away_goals", "i", "ph", F.posexplode("pa").alias("j", "pa"))
    hit = ((F.col("home_goals") == F.col("i")) & (F.col("away_goals") == F.col("j"))).cast("double")
    cells = pmf.groupBy(F.col("i").alias("home_goals"), F.col("j").alias("away_goals")).agg(
        F.avg(F.col("ph") * F.col("pa")).alias("expected"), F.avg(hit).alias("observed"), F.count("*").alias("n")
    )
    e = F.col("expected")
    return cells.withColumn("multiplier", (F.col("n") * F.col("observed") + alpha * e) / ((F.col("n") + alpha) * e)).drop("n")


def robustness(curve: DataFrame, group: str, setting: str, base: float) -> DataFrame:
    """Each setting's loss against the base setting's over the groups of curve(group, setting, loss).

    Verdict A: better in every group; B: better on average; C: within 0.001; D: worse.
    """
    reference = curve.where(F.col(setting) == base).select(group, F.col("loss").alias("base"))
    d = curve.join(reference, group).withColumn("d", F.col("loss") - F.col("base"))
    ends = curve.agg(F.min(setting).alias("low"), F.max(setting).alias("high"))
    better = F.col("d") < -1e-12
    found = d.groupBy(setting).agg(
        F.count("*").alias("n"), F.count_if(better).alias("wins"), F.min("d").alias("best"), F.max("d").alias("worst"), F.avg("d").alias("mean")
    )
    verdict = F.when(F.col("wins") == F.col("n"), "A").when(F.col("mean") < -1e-12, "B").when(F.col("mean") < 0.001, "C").otherwise("D")
    return found.crossJoin(F.broadcast(ends)).select(
        setting, "wins", "best", "worst", "mean", F.col(setting).isin(F.col("low"), F.col("high")).alias("edge"), verdict.alias("verdict")
    )
