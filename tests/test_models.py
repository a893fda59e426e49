import numpy as np
import pytest
from pyspark.sql import functions as F

from curveloom.operators import stacking
from curveloom.operators.dense import LAYER_SCHEMA, load_layers, score_dense
from curveloom.operators.models import ModelConfig, TargetModels, fit_models, select_models, training_history

FEATURES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    y = np.column_stack([x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 120), np.sin(x[:, 0])])
    rows = [(*map(float, a), *map(float, b)) for a, b in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "f0 double, f1 double, f2 double, t0 double, t1 double").repartition(3)


def test_ridge_equals_normal_equations(data, spark, tmp_path):
    x, y, df = data
    fitted = fit_models(df, FEATURES, ["t0", "t1"], "ridge", ModelConfig(ridge_alpha=2.5))
    xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
    expected = np.linalg.solve(xc.T @ xc + 2.5 * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(fitted.coefficients, expected, atol=1e-10)
    np.testing.assert_allclose(fitted.base, y.mean(axis=0) - x.mean(axis=0) @ expected, atol=1e-10)
    fitted.save(str(tmp_path), spark)
    again = TargetModels.load(str(tmp_path), "ridge", spark).predict(df, "p_").collect()
    for r in again:
        wanted = fitted.base + np.array([r[f] for f in FEATURES]) @ expected
        np.testing.assert_allclose([r["p_t0"], r["p_t1"]], wanted, atol=1e-9)


@pytest.mark.parametrize("name", ["random_forest", "boosting"])
def test_trees_learn_persist_and_report(data, spark, tmp_path, name):
    x, y, df = data
    config = ModelConfig(forest_trees=10, forest_leaves=20, boosting_rounds=12, boosting_leaves=8, boosting_min_leaf=3)
    fitted = fit_models(df, FEATURES, ["t0", "t1"], name, config, F.pmod(F.hash("f0"), F.lit(5)) == 0)
    scored = fitted.predict(df, "p_").collect()
    for i, t in enumerate(("t0", "t1")):
        assert np.mean([(r[t] - r[f"p_{t}"]) ** 2 for r in scored]) < np.var(y[:, i]) * 0.5
    fitted.save(str(tmp_path), spark)
    again = TargetModels.load(str(tmp_path), name, spark).predict(df, "p_").collect()
    assert sorted(r["p_t0"] for r in again) == pytest.approx(sorted(r["p_t0"] for r in scored))
    history = training_history(fitted, spark)
    assert history.count() == (2 * 12 if name == "boosting" else 0)


def test_model_names_are_checked():
    assert select_models(["boosting", "ridge"]) == ["ridge", "boosting"]
    with pytest.raises(ValueError, match="nope"):
        select_models(["nope"])


def _projected_gradient(gram, cross, alpha):
    h = gram + alpha * np.eye(len(cross))
    step, w = 1.0 / np.linalg.eigvalsh(h).max(), np.zeros(len(cross))
    for _ in range(50_000):
        w = np.maximum(0, w - step * (h @ w - cross))
    return w


def test_nonnegative_weights_match_projected_gradient():
    rng = np.random.default_rng(8)
    for _ in range(10):
        a = rng.normal(size=(30, 4))
        gram, cross = a.T @ a, rng.normal(size=4) * 10
        np.testing.assert_allclose(
            stacking.nonnegative_ridge(gram, cross, 1.0), _projected_gradient(gram, cross, 1.0), atol=1e-7
        )


def test_stacking_weights_reproduce_the_blend(spark, data):
    x, y, df = data
    df = df.withColumn("a", F.col("t0") * 0.9 + 0.1).withColumn("b", -F.col("t0"))
    table = stacking.fit_stacking(df, {"t0": "t0"}, {"a": {"t0": "a"}, "b": {"t0": "b"}})
    weights = stacking.weights_as_dict(table)["t0"]
    assert weights["b"] == 0 and weights["a"] > 1
    wide = stacking.blend(df, {"t0": weights}, {"a": {"t0": "a"}, "b": {"t0": "b"}}, "m_")
    assert wide.agg(F.avg(F.abs(F.col("m_t0") - F.col("t0")))).first()[0] < 0.02
    long = spark.createDataFrame([(1, "t0", "a", 2.0), (1, "t0", "b", 5.0)], "k int, target string, model string, predicted double")
    got = stacking.blend_long(long, table, ["k"]).first()["predicted"]
    assert got == pytest.approx(weights["intercept"] + 2 * weights["a"])


def test_blend_and_mean_of_literals(spark):
    rows = [(1.0, 2.0, 3.0, 10.0, 20.0, 30.0), (4.0, 5.0, 6.0, 40.0, 50.0, 60.0)]
    df = spark.createDataFrame(rows, "a_cl double, a_cd double, a_cm double, b_cl double, b_cd double, b_cm double")
    predictions = {m: {t: f"{m}_{t}" for t in ("cl", "cd", "cm")} for m in ("a", "b")}
    weights = {
        "cl": {"a": 0.5, "b": 0.5, "intercept": 1.0}, "cd": {"a": 1.0, "b": 0.0, "intercept": 0.0},
        "cm": {"a": 0.0, "b": 2.0, "intercept": -1.0},
    }
    got = stacking.blend(df, weights, predictions).select("cl", "cd", "cm").collect()
    assert sorted(map(tuple, got)) == [(6.5, 2.0, 59.0), (23.0, 5.0, 119.0)]
    mean = stacking.weighted_mean(df, ["cl"], predictions, [3.0, 1.0]).select("cl").collect()
    assert sorted(r[0] for r in mean) == [3.25, 13.0]
    with pytest.raises(ValueError):
        stacking.weighted_mean(df, ["cl"], predictions, [1.0])
    with pytest.raises(ValueError, match="no predictions"):
        stacking.blend(df, {"cl": {"z": 1.0}}, predictions)


def test_dense_network_matches_numpy(spark, data):
    x, _, df = data
    rng = np.random.default_rng(6)
    layers = [(rng.normal(size=(5, 3)), rng.normal(size=5)), (rng.normal(size=(2, 5)), rng.normal(size=2))]
    table = spark.createDataFrame([(i, w.tolist(), b.tolist()) for i, (w, b) in enumerate(layers)][::-1], LAYER_SCHEMA)
    scored = score_dense(df, FEATURES, load_layers(table), ["p", "q"], ["f0"]).toPandas().sort_values("f0")
    order = np.argsort(x[:, 0])
    expected = np.maximum(x[order] @ layers[0][0].T + layers[0][1], 0) @ layers[1][0].T + layers[1][1]
    np.testing.assert_allclose(scored[["p", "q"]].to_numpy(), expected)
    with pytest.raises(ValueError):
        score_dense(df, FEATURES, load_layers(table), ["p"], ["f0"])


def test_active_sets_find_the_least_of_all_sets():
    """Against every set of free weights, and on more models than could be enumerated."""
    from itertools import combinations

    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 5, 6):
        for _ in range(8):
            x, y = rng.normal(size=(30, k)), rng.normal(size=30)
            x[:, -1] = x[:, 0] + 0.01 * x[:, -1]
            gram, cross = x.T @ x, x.T @ y
            matrix = gram + 0.5 * np.eye(k)
            best = 0.0
            for size in range(1, k + 1):
                for chosen in map(list, combinations(range(k), size)):
                    w = np.linalg.solve(matrix[np.ix_(chosen, chosen)], cross[chosen])
                    if (w >= 0).all():
                        best = min(best, float(w @ matrix[np.ix_(chosen, chosen)] @ w - 2 * cross[chosen] @ w))
            found = stacking.nonnegative_ridge(gram, cross, 0.5)
            assert (found >= 0).all()
            assert float(found @ matrix @ found - 2 * cross @ found) == pytest.approx(best, abs=1e-9)
    x, y = rng.normal(size=(200, 40)), rng.normal(size=200)
    w = stacking.nonnegative_ridge(x.T @ x, x.T @ y, 1.0)
    slope = x.T @ y - (x.T @ x + np.eye(40)) @ w
    assert (w >= 0).all() and (slope <= 1e-8).all() and np.abs(slope[w > 0]).max() < 1e-8


def test_blend_rows_needs_no_row_key(spark):
    rows = spark.createDataFrame([("e", 1.0, 2.0), ("e", 1.0, 2.0)], "entity string, a double, b double")
    table = spark.createDataFrame([("t", "a", 0.5), ("t", "b", 2.0), ("t", "intercept", 0.25)], stacking.WEIGHTS_SCHEMA)
    out = stacking.blend_rows(rows, table, {"a": {"t": "a"}, "b": {"t": "b"}}, ["entity"]).collect()
    assert [tuple(r) for r in out] == [("e", "t", 4.75)] * 2
