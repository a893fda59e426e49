import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from curveloom.functions.shape import DESCRIPTOR_COLUMNS, STATIONS
from curveloom.operators import features


def _surfaces(u, l, le, te, x):
    def side(w):
        return sum(math.comb(7, i) * w[i] * x**i * (1 - x) ** (7 - i) for i in range(8)) * np.sqrt(x) * (1 - x)

    nose = le * x * (1 - x) ** 8.5
    return side(u) + nose + te * x / 2, side(l) + nose - te * x / 2


@pytest.fixture
def shapes(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", rng.uniform(0.1, 0.3, 8).tolist(), rng.uniform(-0.3, -0.05, 8).tolist(), float(rng.normal(0, 0.1)), 0.004) for i in range(5)]
    rows.append(("flat", [0.0] * 8, [0.0] * 8, 0.0, 0.0))
    return rows, spark.createDataFrame(rows, "entity_id string, upper array<double>, lower array<double>, le double, te double")


def test_descriptors_match_numpy(shapes):
    rows, df = shapes
    repeated = df.crossJoin(df.sparkSession.range(3).withColumnRenamed("id", "alpha"))
    out = features.add_descriptors(repeated, "entity_id")
    assert out.count() == 18
    got = {r["entity_id"]: r for r in out.where("alpha = 0").collect()}
    assert all(got["flat"][c] == 0 for c in DESCRIPTOR_COLUMNS)
    for name, u, l, le, te in rows[:5]:
        x = np.linspace(0, 1, 101)
        yu, yl = _surfaces(u, l, le, te, x)
        r = got[name]
        assert r["geom_max_thickness"] == pytest.approx((yu - yl).max())
        assert r["geom_max_camber"] == pytest.approx(((yu + yl) / 2).max())
        fine = np.linspace(0, 1, 200_001)
        fu, fl = _surfaces(u, l, le, te, fine)
        assert r["geom_area"] == pytest.approx(np.trapezoid(fu - fl, fine), rel=1e-5)
        a, b = u[0] ** 2 / 2, l[0] ** 2 / 2
        s = 0.03 * (a + b) / 2
        assert r["geom_le_radius"] == pytest.approx(-s * np.log(np.exp(-a / s) + np.exp(-b / s)))
        for st in STATIONS:
            su, sl = _surfaces(u, l, le, te, np.array(st))
            assert r[f"geom_thickness_{round(st * 100)}"] == pytest.approx(float(su - sl))
            assert r[f"geom_camber_{round(st * 100)}"] == pytest.approx(float(su + sl) / 2)
        c = 0.5 * (1 - np.cos(np.linspace(0, np.pi, 101)))
        cu, cl = _surfaces(u, l, le, te, c)
        length = sum(np.hypot(np.diff(c), np.diff(y)).sum() for y in (cu, cl))
        assert r["geom_perimeter"] == pytest.approx(length)
        slope = np.degrees(np.arctan(u[7] - te / 2) - np.arctan(l[7] + te / 2))
        assert r["geom_te_angle"] == pytest.approx(slope)


def test_existing_descriptors_are_kept_and_partial_ones_redone(shapes):
    _, df = shapes
    done = features.add_descriptors(df, "entity_id")
    assert features.add_descriptors(done, "entity_id") is done
    partial = df.withColumn(DESCRIPTOR_COLUMNS[0], F.lit(-1.0))
    redone = features.add_descriptors(partial, "entity_id")
    assert redone.where(f"{DESCRIPTOR_COLUMNS[0]} < 0").count() == 0
    assert len(redone.columns) == len(set(redone.columns))


def test_scaler_uses_population_deviation_and_inverts(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    scaler = features.Scaler.fit(df, ["a", "b"])
    assert scaler.statistics["a"] == pytest.approx((3.0, np.std([1, 2, 6])))
    assert scaler.statistics["b"] == (5.0, 1.0)
    back = scaler.inverse(scaler.transform(df, ["a", "b"]), {"a": "a", "b": "b"}).collect()
    assert sorted(r["a"] for r in back) == pytest.approx([1, 2, 6])
    assert {r["b"] for r in back} == {5.0}
    again = features.Scaler.from_table(scaler.to_table(spark))
    assert again.statistics == scaler.statistics


def test_log_label(spark):
    df = spark.createDataFrame([(0.01,), (0.0,)], "cd double")
    out = [r[0] for r in features.unlog_label(features.log_label(df, "cd"), "cd").collect()]
    assert sorted(out) == pytest.approx([1e-6, 0.01])
    with pytest.raises(PySparkException, match="has no logarithm"):
        features.log_label(spark.createDataFrame([(-0.01,)], "cd double"), "cd").collect()


def test_vector_statistics_match_numpy(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(r.tolist(),) for r in m], "v array<double>").repartition(3)
    mean = {r["i"]: r["mean"] for r in features.vector_mean(df, "v", 4).collect()}
    np.testing.assert_allclose([mean[i] for i in range(4)], m.mean(axis=0))
    cov = np.cov(m, rowvar=False)
    found = features.vector_covariance(df, "v", 4).collect()
    assert len(found) == 10
    for r in found:
        assert r["covariance"] == pytest.approx(cov[r["i"], r["j"]])


def test_rows_of_few_entities_are_not_shuffled(spark):
    rows = spark.range(60).selectExpr(
        "id % 3 AS e", "id", "transform(sequence(1, 8), i -> 0.1D + i / 100) AS upper",
        "transform(sequence(1, 8), i -> -0.1D - i / 100) AS lower", "0.0D AS le", "0.001D AS te")
    described = features.add_descriptors(rows, "e")
    assert described.count() == 60
    plan = described._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
