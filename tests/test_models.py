"""Model fits against plain numpy versions, and contracts that must fail loudly."""

from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.operators import calibrate as cal
from matchweave.operators import contracts as con
from matchweave.operators import resample
from matchweave.plans import catalog
from matchweave.plans.models import CLASSES, COLUMNS, split
from matchweave.sources.bindings import predictions

SF = "/root/testdata/sf0.001"


def arrays(spark):
    train, test = split(spark, SF)
    return train, test, *(x.select("fixture_id", "y_true", "p_home", "p_draw", "p_away", *COLUMNS).orderBy("fixture_id").toPandas() for x in (train, test))


def test_platt_equals_newton(spark):
    train, test, a, b = arrays(spark)
    raw = {}
    for v, c in CLASSES.items():
        x, y, w = np.log(a[c] / (1 - a[c])).to_numpy(), (a.y_true == v).to_numpy(float), np.array([1.0, 0.0])
        design = np.stack([x, np.ones_like(x)], axis=1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-design @ w))
            w = w - np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design, design.T @ (p - y))
        z = np.log(b[c] / (1 - b[c])).to_numpy()
        raw[v] = 1 / (1 + np.exp(-(w[0] * z + w[1])))
    total = sum(raw.values())
    got = cal.platt_per_class(train, test, CLASSES).orderBy("fixture_id").toPandas()
    for v in "HDA":
        assert np.allclose(got[f"cal_{v}"], raw[v] / total, atol=1e-6)


def test_isotonic_equals_pooling(spark):
    train, test, a, b = arrays(spark)
    raw = {}
    for v, c in CLASSES.items():
        x, y = a[c].to_numpy(), (a.y_true == v).to_numpy(float)
        values = np.unique(x)
        blocks = [[y[x == u].mean(), (x == u).sum(), u, u] for u in values]
        pooled = []
        for block in blocks:
            pooled.append(block)
            while len(pooled) > 1 and pooled[-2][0] >= pooled[-1][0]:
                m2, n2, _, high = pooled.pop()
                m1, n1, low, _ = pooled.pop()
                pooled.append([(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, low, high])
        ends = [(u, m) for m, _, low, high in pooled for u in ([low] if low == high else [low, high])]
        raw[v] = np.clip(np.interp(b[c], [u for u, _ in ends], [m for _, m in ends]), 1e-6, 1 - 1e-6)
    total = sum(raw.values())
    got = cal.isotonic_per_class(train, test, CLASSES).orderBy("fixture_id").toPandas()
    for v in "HDA":
        assert np.allclose(got[f"cal_{v}"], raw[v] / total, atol=1e-6)


def test_outcome_regression_is_at_its_optimum(spark):
    train, _, a, _ = arrays(spark)
    model = cal.outcome_model(train, COLUMNS).stages[-1]
    x = a[COLUMNS].to_numpy(float)
    y = np.stack([(a.y_true == v).to_numpy(float) for v in "HDA"], axis=1)
    coef, bias, spread = model.coefficientMatrix.toArray(), model.interceptVector.toArray(), x.std(axis=0, ddof=1)
    z = x @ coef.T + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    slope = (p - y).T @ (x / spread) / len(x) + (coef * spread) / len(x)
    assert np.abs(slope).max() < 2e-3 and np.abs((p - y).mean(axis=0)).max() < 2e-3


def test_goal_regression_is_at_its_optimum(spark):
    train, _, _, _ = arrays(spark)
    model = cal.goal_models(train, COLUMNS, penalty=0.0)[0].stages[-1]
    rows = train.select("home_goals", *COLUMNS).toPandas().to_numpy(float)
    x = np.hstack([rows[:, 1:], np.ones((len(rows), 1))])
    rate = np.exp(x @ np.append(model.coefficients.toArray(), model.intercept))
    assert np.abs(x.T @ (rows[:, 0] - rate) / np.abs(x).sum(axis=0)).max() < 1e-4


def test_forest_mixture_and_boosting_separate_what_is_there(spark):
    rng = np.random.default_rng(1)
    rows = [(float(g * 8 + rng.normal()), float(rng.normal()), float(g), int(3 * g)) for g in rng.integers(0, 2, 600)]
    frame = spark.createDataFrame(rows, "x double, z double, bad double, home_goals int")
    forest = cal.risk_forest(frame, ["x", "z"], "bad").transform(frame)
    assert forest.where("prediction = bad").count() > 590
    regime = cal.regimes(frame, ["x", "z"], k=2).transform(frame).groupBy("regime").agg(F.avg("bad").alias("m"), F.count("*").alias("n")).collect()
    assert sorted(round(r.m) for r in regime) == [0, 1], regime
    boosted = cal.boosted_goals(frame, ["x", "z"]).transform(frame)
    assert boosted.agg(F.avg(F.abs(F.col("gbt_home") - F.col("home_goals")))).first()[0] < 0.1


def test_contracts_fail_loudly(spark):
    rows = spark.createDataFrame([(1, "H"), (2, "X"), (3, None)], "k long, y string")
    with pytest.raises(ValueError, match="b, c"):
        con.select_exact(rows, ["k", "b", "c"])
    none = rows.where("false")
    assert con.labelled(rows, "y", ["H"], rows.where("k = 2"), "k").count() == 1
    with pytest.raises(Exception, match="outside its domain"):
        con.labelled(rows, "y", ["H"], none, "k").collect()
    with pytest.raises(Exception, match="more than one part"):
        con.disjoint_union({"a": rows, "b": rows.where("k = 1")}, "k").collect()
    assert con.disjoint_union({"a": rows.where("k < 2"), "b": rows.where("k > 1")}, "k").count() == 3


def test_moving_blocks_are_the_sums_of_runs(spark):
    rows = predictions(spark, SF).select("unix", "fixture_id", F.col("p_home").alias("d"))
    got = sorted(map(tuple, resample.moving_blocks(rows, ["unix", "fixture_id"], F.floor(F.col("unix") / 86400), "d", 5).collect()))
    d = [r.d for r in rows.orderBy("unix", "fixture_id").collect()]
    assert [s for s, _, _ in got] == list(range(len(d) - 4)) and all(abs(t - sum(d[s : s + 5])) < 1e-6 and n == 5 for s, t, n in got)


def test_variance_inflation_equals_regressions(spark):
    got = {r.feature: r for r in catalog.QUERIES["m36_collinearity"](spark, SF).collect()}
    rows = predictions(spark, SF).select(*got).toPandas()
    for c, r in got.items():
        x = np.column_stack([rows.drop(columns=c).to_numpy(float), np.ones(len(rows))])
        y = rows[c].to_numpy(float)
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert r.vif == pytest.approx(((y - y.mean()) ** 2).sum() / (rest**2).sum(), rel=1e-4)
    assert got["p_home"].condition == pytest.approx(np.linalg.cond(np.corrcoef(rows.to_numpy(float).T)), rel=1e-4)


def test_batch_scores_follow_from_the_stored_coefficients(spark):
    from math import exp as e

    from matchweave.plans.models import COLUMNS
    from matchweave.sources.bindings import predictions
    from matchweave.sources.storage import shared_folder

    p = predictions(spark, "/root/testdata/sf0.001")
    train, test = p.where("season_year < 1997"), p.where("season_year >= 1997")
    path = shared_folder(spark)
    cal.save_goal_models(cal.goal_models(train, COLUMNS), path)
    models = cal.load_goal_models(path)
    got = {r.fixture_id: r for r in cal.score_batch(models, test).collect()}
    assert len(got) == test.count() > 0
    coefficients = [(m.stages[-1].intercept, m.stages[-1].coefficients.toArray()) for m in models]
    for r in test.collect():
        rates = [min(max(e(b + sum(w * r[c] for w, c in zip(k, COLUMNS))), 0.05), 8.0) for b, k in coefficients]
        g = got[r.fixture_id]
        assert g.fit_home == pytest.approx(rates[0]) and g.fit_away == pytest.approx(rates[1]) and g.fit_safe
        grid = [[e(-rates[0]) * rates[0] ** i / factorial(i) * e(-rates[1]) * rates[1] ** j / factorial(j) for j in range(60)] for i in range(60)]
        assert g.fit_win == pytest.approx(sum(grid[i][j] for i in range(60) for j in range(i)), abs=1e-9)
        assert g.fit_draw == pytest.approx(sum(grid[i][i] for i in range(60)), abs=1e-9)


def test_joint_stack_is_no_worse_where_its_weight_was_chosen(spark):
    from matchweave.sources.bindings import predictions

    p = predictions(spark, "/root/testdata/sf0.001")
    train, valid = p.where("season_year < 1996"), p.where("season_year = 1996")
    weights = [k / 20 for k in range(21)]
    weight, rows = cal.joint_stack(train, valid, valid, weights)
    rows = rows.toPandas()
    label = rows["y_true"].map({"H": 0, "D": 1, "A": 2}).to_numpy()
    at = np.arange(len(rows))
    stack, given = (rows[list(c)].to_numpy()[at, label] for c in (("stack_H", "stack_D", "stack_A"), ("p_home", "p_draw", "p_away")))
    losses = [-np.log(w * stack + (1 - w) * given).mean() for w in weights]
    assert weight == weights[int(np.argmin(np.round(losses, 12)))]
    assert np.allclose(rows[["joint_H", "joint_D", "joint_A"]].sum(axis=1), 1)
    # the fit's optimum: on train, the mean of probabilities less outcomes vanishes for each class
    _, fitted = cal.joint_stack(train, valid, train, weights)
    t = fitted.toPandas()
    for k, v in enumerate("HDA"):
        assert abs(t[f"stack_{v}"].mean() - (t["y_true"] == v).mean()) < 5e-3


@pytest.mark.parametrize("name", sorted(cal.CALIBRATORS))
def test_calibrators_follow_the_protocol(spark, name):
    train, test = split(spark, SF)
    tool = cal.CALIBRATORS[name](CLASSES)
    assert tool.fit(train) is tool
    rows = tool.transform(test)
    assert rows.columns == [*test.columns, "cal_H", "cal_D", "cal_A"]
    got = rows.select("cal_H", "cal_D", "cal_A").toPandas()
    assert len(got) == test.count() and np.allclose(got.sum(axis=1), 1) and (got > 0).all().all()


def test_temperature_is_that_of_least_loss(spark):
    train = split(spark, SF)[0]
    tool = cal.TemperatureCalibrator(CLASSES).fit(train)
    rows = train.select("y_true", "p_home", "p_draw", "p_away").toPandas()
    at = rows["y_true"].map({"H": 0, "D": 1, "A": 2}).to_numpy()
    z = np.log(rows[["p_home", "p_draw", "p_away"]].to_numpy())

    def loss(t):
        e = np.exp(z / t)
        return -np.log((e / e.sum(axis=1, keepdims=True))[np.arange(len(at)), at]).mean()

    assert tool.setting == min(tool.settings, key=lambda t: (round(loss(t), 10), t))


def test_counted_rows_calibrate_as_the_rows_do(spark, monkeypatch):
    """Fits of equal rows by weight; an isotonic fit gets one row for each value, where it got them all before."""
    rows = spark.range(3000).selectExpr(
        "element_at(array('H', 'D', 'A'), cast(1 + abs(hash(id)) % 3 as int)) as y_true", "(1 + id % 7) as a", "(1 + id % 5) as b", "(1 + id % 6) as c"
    ).selectExpr("y_true", "a / (a + b + c) as p_home", "b / (a + b + c) as p_draw", "c / (a + b + c) as p_away")
    columns = list(CLASSES.values())
    counted = cal.counting(rows, ["y_true", *columns])
    assert counted.count() < 700 and counted.agg(F.sum("weight")).first()[0] == 3000
    fits, kept = [], cal.IsotonicRegression.fit
    monkeypatch.setattr(cal.IsotonicRegression, "fit", lambda self, data: (fits.append((self.getFeaturesCol(), data.count())), kept(self, data))[1])
    for kind in cal.CALIBRATORS.values():
        out = [kind(CLASSES, **k).fit(t).transform(rows.distinct()).orderBy("y_true", *columns).select("cal_H", "cal_D", "cal_A").collect() for k, t in (({}, rows), ({"weight": "weight"}, counted))]
        assert np.allclose(*out, atol=1e-9)
    assert len(fits) == 6 and all(n == rows.select(c).distinct().count() for c, n in fits)
