"""Trees grown on bins: against exhaustive splits, caps, patience, shared scans, scoring in parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curveloom.operators import models, trees
from curveloom.operators.gram import column_moments, moments
from curveloom.operators.models import ModelConfig, fit_candidates, fit_models, score_models

FEATURES = ["f0", "f1"]
SCHEMA = "f0 double, f1 double, t0 double, t1 double, held boolean"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.integers(0, 30, 500), rng.normal(size=500)])
    y = np.column_stack([np.sin(x[:, 0] / 4) + (x[:, 1] > 0.3) + rng.normal(0, 0.05, 500), x[:, 1] ** 2 + x[:, 0] / 10])
    rows = [(*map(float, a), *map(float, b), i % 5 == 0) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, SCHEMA).repartition(4)


def exhaustive(x, y, cuts, leaves, min_leaf):
    """Best-first growth by trying every cut of every leaf; leaf number and prediction of each row."""
    def best(rows):
        found = (1e-9, None)
        for k in range(x.shape[1]):
            for c in cuts[k]:
                left = rows[x[rows, k] <= c]
                right = rows[x[rows, k] > c]
                if min(len(left), len(right)) >= min_leaf:
                    gain = sum(((y[rows] - y[rows].mean(axis=0)) ** 2).sum() - sum(
                        ((y[p] - y[p].mean(axis=0)) ** 2).sum() for p in (left, right)) for _ in (0,))
                    if gain > found[0] + 1e-9:
                        found = gain, (left, right)
        return found

    parts = [(best(np.arange(len(x))), np.arange(len(x)))]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda i: parts[i][0][0])
        if parts[i][0][1] is None:
            break
        _, pair = parts.pop(i)[0]
        parts += [(best(p), p) for p in pair]
    fit = np.empty_like(y)
    for _, rows in parts:
        fit[rows] = y[rows].mean(axis=0)
    return fit, len(parts)


@pytest.mark.parametrize("leaves, room", [(2, 16_000_000), (3, 16_000_000), (9, 3_000), (30, 16_000_000)])
def test_one_tree_of_two_targets_is_the_exhaustive_one(data, spark, monkeypatch, leaves, room):
    monkeypatch.setattr(trees, "SCAN_NUMBERS", room)
    x, y, df = data
    config = ModelConfig(forest_trees=1, forest_leaves=leaves, forest_min_leaf=7, forest_bootstrap=False, forest_features=1.0)
    model = fit_models(df, FEATURES, ["t0", "t1"], "random_forest", config)
    cuts = trees.Bins.fit(df, FEATURES).cuts
    fit, n = exhaustive(x, y, cuts, leaves, 7)
    got = {(r["f0"], r["f1"]): (r["p_t0"], r["p_t1"]) for r in model.predict(df, "p_").collect()}
    np.testing.assert_allclose([got[tuple(a)] for a in x], fit, atol=1e-9)
    assert model.nodes.where("feature < 0").count() == n <= leaves
    # Every leaf holds the means of a group-by over its rows.
    leaf = model.predict(df, "p_").groupBy("p_t0", "p_t1").agg(F.avg("t0").alias("a"), F.avg("t1").alias("b"), F.count("*").alias("n"))
    for r in leaf.collect():
        assert (r["p_t0"], r["p_t1"]) == pytest.approx((r["a"], r["b"])) and r["n"] >= 7


def test_boosting_is_trees_on_residuals(data):
    x, y, df = data
    config = ModelConfig(boosting_rounds=12, boosting_leaves=4, boosting_min_leaf=5, boosting_rate=0.3)
    model = fit_models(df, FEATURES, ["t0", "t1"], "boosting", config)
    cuts = trees.Bins.fit(df, FEATURES).cuts
    got = {(r["f0"], r["f1"]): (r["p_t0"], r["p_t1"]) for r in model.predict(df, "p_").collect()}
    for t in range(2):
        fit = np.full(len(y), y[:, t].mean())
        losses = [np.mean((y[:, t] - fit) ** 2)]
        for _ in range(12):
            fit = fit + 0.3 * exhaustive(x, (y[:, t] - fit)[:, None], cuts, 4, 5)[0][:, 0]
            losses.append(np.mean((y[:, t] - fit) ** 2))
        np.testing.assert_allclose([got[tuple(a)][t] for a in x], fit, atol=1e-9)
        history = [h[3] for h in model.history if h[1] == f"t{t}"]
        np.testing.assert_allclose(history, losses[:len(history)], atol=1e-9)
        assert len(history) >= 12


def test_patience_ends_rounds(data):
    _, y, df = data
    noise = df.withColumn("t0", F.rand(3)).withColumn("t1", F.lit(2.0))
    config = ModelConfig(boosting_rounds=60, boosting_leaves=6, boosting_min_leaf=2, boosting_rate=0.8, boosting_patience=4)
    model = fit_models(noise, FEATURES, ["t0", "t1"], "boosting", config, F.col("held"))
    held = [h[4] for h in model.history if h[1] == "t0"]
    rounds = model.nodes.where("array_contains(targets, 0)").select("tree").distinct().count()
    assert rounds < 50 and rounds == len(held) - 1
    assert min(held[-4:]) > held[-5] - 1e-7
    assert all(min(held[i - 4:i]) <= held[i - 5] - 1e-7 for i in range(5, len(held)))
    # A constant has one leaf and ends at once.
    assert model.nodes.where("array_contains(targets, 1)").count() == 1


def test_candidates_share_scans_and_differ(data, spark, monkeypatch):
    _, _, df = data
    count = []
    monkeypatch.setattr(trees, "_scan", lambda *a, f=trees._scan, **k: count.append(1) or f(*a, **k))
    configs = [ModelConfig(boosting_rounds=r, boosting_leaves=n, boosting_min_leaf=5) for r, n in ((2, 4), (4, 8), (3, 2))]
    together = fit_candidates(df, FEATURES, ["t0", "t1"], "boosting", configs)
    shared = len(count)
    count.clear()
    alone = [fit_models(df, FEATURES, ["t0", "t1"], "boosting", c) for c in configs]
    assert shared < len(count)
    names = [f"{k}{i}_" for k in "ab" for i in range(3)]
    rows = score_models(df, dict(zip(names, [*together, *alone]))).collect()
    for i in range(3):
        for t in ("t0", "t1"):
            assert [r[f"a{i}_{t}"] for r in rows] == pytest.approx([r[f"b{i}_{t}"] for r in rows])


def test_drawn_rows_and_features_are_the_same_again(data, spark):
    _, _, df = data
    config = ModelConfig(forest_trees=6, forest_leaves=15, forest_min_leaf=3, forest_features=0.5)
    one = fit_models(df, FEATURES, ["t0"], "random_forest", config).nodes
    other = fit_models(df.repartition(7), FEATURES, ["t0"], "random_forest", config).nodes
    order = ["tree", "node", "feature", "cut"]
    assert [tuple(r) for r in one.select(order).sort(order).collect()] == [tuple(r) for r in other.select(order).sort(order).collect()]
    assert one.where("feature >= 0").groupBy("tree").count().count() == 6
    assert {r[0] for r in one.where("feature >= 0").select("feature").distinct().collect()} == {0, 1}
    assert one.where("node = 0").select("cut").distinct().count() > 1


def test_scoring_in_parts_adds_up(data, monkeypatch):
    _, _, df = data
    config = ModelConfig(forest_trees=9, forest_leaves=10, forest_min_leaf=3, boosting_rounds=5, boosting_leaves=4)
    whole = [fit_models(df, FEATURES, ["t0", "t1"], n, config) for n in ("random_forest", "boosting", "ridge")]
    wanted = {(r["f0"], r["f1"]): r for r in score_models(df, dict(zip("abc", whole))).collect()}
    monkeypatch.setattr(models, "GROUP_NUMBERS", 400)
    parts = [fit_models(df, FEATURES, ["t0", "t1"], n, config) for n in ("random_forest", "boosting", "ridge")]
    assert parts[0].nodes.select("part").distinct().count() > 2
    for r in score_models(df, dict(zip("abc", parts))).collect():
        for c in ("at0", "bt1", "ct0", "at1"):
            assert r[c] == pytest.approx(wanted[r["f0"], r["f1"]][c])


def test_bins_and_missing_values(spark):
    rows = [(float(i), None if i % 10 == 0 else float(i % 3), float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    bins = trees.Bins.fit(df, ["a", "b"])
    assert 200 < len(bins.cuts[0]) < 256 and bins.cuts[1].tolist() == [0.5, 1.5]
    codes = bins.of(np.array([[0.0, np.nan], [999.0, 0.0], [500.0, 2.0]]))
    assert codes[0].tolist() == [0, 2] and codes[1].tolist() == [len(bins.cuts[0]), 0] and codes[2][1] == 2
    model = fit_models(df, ["a", "b"], ["y"], "boosting", ModelConfig(boosting_rounds=6, boosting_rate=0.8))
    assert model.predict(df, "p_").agg(F.max(F.abs(F.col("p_y") - F.col("y")))).first()[0] < 100
    empty = fit_models(df.limit(0), ["a", "b"], ["y"], "boosting", ModelConfig(boosting_rounds=2))
    assert [r["p_y"] for r in empty.predict(df.limit(2), "p_").collect()] == [0.0, 0.0]


def test_moments_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 7)) + 1e6
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,), ([1.0] * 6,), ([float("nan")] * 7,)], "v array<double>")
    for block in (512, 3):
        found = moments(df.repartition(6), F.col("v"), 7, block)
        assert found.n == 300
        np.testing.assert_allclose(found.mean, x.mean(axis=0))
        np.testing.assert_allclose(found.covariance(), np.cov(x.T), atol=1e-6)
    assert column_moments(spark.createDataFrame([], "a double"), ["a"]).n == 0


def test_rows_that_share_their_bins_are_one_cell(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 6, 3000), rng.integers(0, 4, 3000)]).astype(float)
    y = x[:, 0] * x[:, 1] + rng.normal(0, 0.3, 3000)
    held = rng.random(3000) < 0.2
    df = spark.createDataFrame(
        [(*map(float, a), float(b), bool(h)) for a, b, h in zip(x, y, held)], "f0 double, f1 double, t0 double, held boolean")
    cells = trees.binned_cells(df.repartition(5), trees.Bins.fit(df, FEATURES), ["t0"], F.col("held"))
    sizes = {r["held"]: r["n"] for r in cells.groupBy("held").agg(F.sum("size").alias("n")).collect()}
    assert sizes == {h: len(np.unique(x[held == h], axis=0)) for h in (False, True)}
    model = fit_models(df, FEATURES, ["t0"], "boosting", ModelConfig(boosting_rounds=3, boosting_leaves=5, boosting_rate=0.5), F.col("held"))
    parts, fit = model.history, np.full(3000, y[~held].mean())
    cuts = trees.Bins.fit(df, FEATURES).cuts
    for _, _, _, loss, held_loss in parts[:3]:
        assert (loss, held_loss) == pytest.approx([np.mean((y - fit)[m] ** 2) for m in (~held, held)])
        grown = exhaustive(x[~held], (y - fit)[~held][:, None], cuts, 5, 20)[0][:, 0]
        means = {tuple(a): v for a, v in zip(x[~held], grown)}
        fit = fit + 0.5 * np.array([means[tuple(a)] for a in x])


@pytest.mark.parametrize("space, cluster, numbers", [(100, 1_000_000, 2_000_000), (100, 400, 30)])
def test_rows_that_trees_draw_are_summed_by_cell(spark, monkeypatch, space, cluster, numbers):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 6, 4000) * (rng.random(4000) < 0.4), rng.integers(0, 4, 4000) * (rng.random(4000) < 0.4)])
    y = np.column_stack([x[:, 0] * x[:, 1] + rng.normal(0, 0.3, 4000), x[:, 0] - x[:, 1] + rng.normal(0, 0.3, 4000)])
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y)], "f0 double, f1 double, t0 double, t1 double")
    sizes = []
    monkeypatch.setattr(models, "grow", lambda rows, *a, f=models.grow, **k: sizes.append(
        rows.agg(F.sum("size")).first()[0]) or f(rows, *a, **k))
    monkeypatch.setattr(trees, "CLUSTER_ROWS", cluster)
    monkeypatch.setattr(trees, "BLOCK_NUMBERS", numbers)
    config = ModelConfig(forest_trees=5, forest_leaves=12, forest_min_leaf=3, forest_features=0.5)
    order, found = ["tree", "node", "feature", "cut", "value"], []
    # Few cells, then rows as they are: cells of so many rows there are not.
    for rows_a_cell in (4, 100_000):
        monkeypatch.setattr(trees, "CELL_ROWS", rows_a_cell)
        monkeypatch.setattr(trees, "CELL_SPACE", space)
        nodes = fit_models(df.repartition(5), FEATURES, ["t0", "t1"], "random_forest", config).nodes
        found.append(nodes.select(order).sort("tree", "node").collect())
    assert sizes[0] < 400 and sizes[1] == 4000
    assert len({r["tree"] for r in found[0]}) == 5 and len(found[0]) == len(found[1]) > 50
    for a, b in zip(*found):
        assert tuple(a)[:4] == tuple(b)[:4] and a["value"] == pytest.approx(b["value"], abs=1e-12)
    # The space that sums take is bounded too.
    monkeypatch.setattr(trees, "CELL_ROWS", 4)
    monkeypatch.setattr(trees, "CELL_SPACE", 0.001)
    fit_models(df, FEATURES, ["t0", "t1"], "random_forest", config)
    assert sizes[2] == 4000


def test_forest_without_draws_takes_rows_by_cell(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 6, 2000), rng.integers(0, 4, 2000)]).astype(float)
    y = x[:, 0] * x[:, 1] + rng.normal(0, 0.3, 2000)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "f0 double, f1 double, t0 double").repartition(3)
    sizes = []
    monkeypatch.setattr(models, "grow", lambda rows, *a, f=models.grow, **k: sizes.append(
        rows.agg(F.sum("size")).first()[0]) or f(rows, *a, **k))
    config = ModelConfig(forest_trees=1, forest_leaves=9, forest_min_leaf=3, forest_bootstrap=False, forest_features=1.0)
    fit = exhaustive(x, y[:, None], trees.Bins.fit(df, FEATURES).cuts, 9, 3)[0][:, 0]
    # Grouped by values, and after they are binned.
    for most in (100_000, 1):
        monkeypatch.setattr(trees, "VALUE_CELLS", most)
        model = fit_models(df, FEATURES, ["t0"], "random_forest", config)
        got = {(r["f0"], r["f1"]): r["p_t0"] for r in model.predict(df, "p_").distinct().collect()}
        np.testing.assert_allclose([got[tuple(a)] for a in x], fit, atol=1e-9)
    assert sizes == [24, 24]


def test_moments_of_few_columns_are_those_of_many(spark, monkeypatch):
    from curveloom.operators import gram

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + 1e6
    rows = [tuple(map(float, r)) for r in x] + [(None, 1.0, 2.0), (float("nan"), 1.0, 2.0), (1.0, float("inf"), 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    few = column_moments(df, ["a", "b", "c"])
    monkeypatch.setattr(gram, "FEW_COLUMNS", 0)
    many = column_moments(df, ["a", "b", "c"])
    assert few.n == many.n == 400
    np.testing.assert_allclose(few.mean, many.mean)
    np.testing.assert_allclose(few.products, many.products, rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(few.products, np.cov(x.T) * 399, rtol=1e-6)
