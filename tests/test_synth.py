import numpy as np
import pytest
from pyspark.sql import functions as F

from curveloom.functions.draws import normal, normal_columns, normals, uniform
from curveloom.functions.scalars import convex_weights, inclusive_sweep, line_grid
from curveloom.operators import synth


@pytest.fixture
def parents(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [*rng.uniform(0.1, 0.3, 8).tolist(), *rng.uniform(-0.3, -0.1, 8).tolist(), 0.05, 0.002 * i]) for i in range(12)]
    return spark.createDataFrame(rows, "pid int, vector array<double>")


def test_operating_points(spark):
    cases = spark.range(400).withColumnRenamed("id", "case")
    rows = synth.operating_points(cases, "case").collect()
    for r in rows:
        steps = np.diff(r["alphas"])
        assert len(r["alphas"]) == 7 and np.allclose(steps, 5.0)
        assert r["reynolds"] > 0 and 0 <= r["n_crit"] <= 18 and r["mach"] == 0
        assert 0 <= r["xtr_upper"] <= 1 and 0 <= r["xtr_lower"] <= 1
    free = np.mean([r["xtr_upper"] == 1.0 for r in rows])
    assert 0.72 < free < 0.88
    logs = np.log10([r["reynolds"] for r in rows])
    assert abs(logs.mean() - 5.5) < 0.15 and abs(logs.std() - 0.75) < 0.1
    assert synth.explode_conditions(synth.operating_points(cases, "case")).count() == 2800


@pytest.mark.parametrize("n", [1, 5])
def test_draws_do_not_depend_on_partitions(spark, parents, n):
    cases = spark.range(60).withColumnRenamed("id", "case")

    def drawn(c, p):
        points = synth.operating_points(c, "case")
        shapes = synth.sample_shapes(c, "case", p, "pid", "vector")
        return (
            sorted(map(str, points.collect())),
            sorted(map(str, shapes.collect())),
        )

    assert drawn(cases, parents) == drawn(cases.repartition(n), parents.repartition(n))


def test_shapes_are_sound(spark, parents):
    cases = spark.range(50).withColumnRenamed("id", "case")
    rows = synth.sample_shapes(cases, "case", parents, "pid", "vector").collect()
    assert len(rows) == 50
    for r in rows:
        assert r["te"] >= 0
        assert r["accepted"] == all(u > v for u, v in zip(r["upper"], r["lower"]))
    assert sum(r["accepted"] for r in rows) > 45


def test_rejected_tries_are_drawn_again(spark, parents):
    # Parents whose surfaces almost touch: most first tries cross, later ones are accepted.
    close = parents.withColumn("vector", F.transform("vector", lambda x, i: F.when(i >= 16, x).otherwise(x - F.when(i < 8, 0.2).otherwise(-0.2))))
    cases = spark.range(40).withColumnRenamed("id", "case")
    one = synth.sample_shapes(cases, "case", close, "pid", "vector", config=synth.SamplingConfig(most_tries=1))
    many = synth.sample_shapes(cases, "case", close, "pid", "vector", config=synth.SamplingConfig(most_tries=64))
    accepted_once = {r["case"] for r in one.where("accepted").collect()}
    accepted = many.where("accepted").collect()
    assert accepted_once < {r["case"] for r in accepted}
    for r in many.collect():
        assert r["accepted"] == all(u > v for u, v in zip(r["upper"], r["lower"]))


def test_equal_parents_without_noise_give_the_parent(spark):
    vector = [*[0.2] * 8, *[-0.1] * 8, 0.05, 0.01]
    parents = spark.createDataFrame([(i, vector) for i in range(3)], "pid int, vector array<double>")
    cases = spark.range(5).withColumnRenamed("id", "case")
    config = synth.SamplingConfig(scale_log_sigma=0.0)
    for r in synth.sample_shapes(cases, "case", parents, "pid", "vector", config=config).collect():
        np.testing.assert_allclose([*r["upper"], *r["lower"], r["le"], r["te"]], vector, atol=1e-9)


def test_covariance_factor(parents):
    factor = synth.covariance_factor(parents, "vector")
    m = np.array([r["vector"] for r in parents.collect()])
    np.testing.assert_allclose(factor @ factor.T, np.cov(m, rowvar=False), atol=1e-12)
    assert np.allclose(factor, np.tril(factor))


def test_draw_distributions(spark):
    df = spark.range(4000)
    key = F.col("id")
    row = df.select(
        uniform(key, 1, "u").alias("u"), normal(key, 1, "n").alias("n"),
        normals(key, 1, "m", F.lit(0), 2)[1].alias("m"), normals(key, 1, "m", F.lit(3), 2)[0].alias("k"),
    ).toPandas()
    assert 0 < row.u.min() and row.u.max() < 1 and abs(row.u.mean() - 0.5) < 0.02
    for c in ("n", "m", "k"):
        assert abs(row[c].mean()) < 0.06 and abs(row[c].std() - 1) < 0.05
    assert abs(row[["n", "m", "k"]].corr().to_numpy() - np.eye(3)).max() < 0.06


def test_sentinel_rows(spark):
    rows = synth.sentinel_rows(spark).collect()
    assert len(rows) == 111
    assert {r["Re"] for r in rows} == {1e4, 1e5, 1e6}
    assert {round(r["alpha"], 9) for r in rows} == {-180.0 + 10 * i for i in range(37)}
    assert all(r["CD"] == 1 and r["confidence"] == 0.1 and len(r["upper_bl_H"]) == 32 for r in rows)


def test_grids_and_weights(spark):
    row = spark.range(1).select(
        inclusive_sweep(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("a"),
        inclusive_sweep(F.lit(-5.0), F.lit(5.0), F.lit(5.0)).alias("b"),
        inclusive_sweep(F.lit(-5.0), F.lit(5.0), F.lit(2.5)).alias("c"),
        inclusive_sweep(F.lit(5.0), F.lit(0.0), F.lit(1.0)).alias("d"),
        line_grid(-1.0, 1.0, 5).alias("e"),
        convex_weights(F.array(F.lit(0.7), F.lit(0.2))).alias("w"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ([0], [-5, 0, 5], [-5, -2.5, 0, 2.5, 5], [])
    assert row["e"] == [-1, -0.5, 0, 0.5, 1]
    assert row["w"] == pytest.approx([0.2, 0.5, 0.3])


def test_draws_of_a_batch_are_those_of_the_rows(spark):
    for keys in (["7", "8"], ["key of twelve", "KEY of TWELVE"], ["x" * 29, "y" * 29], ["z" * 80]):
        df = spark.createDataFrame([(k,) for k in keys], "k string")
        rows = df.select("k", normals(F.col("k"), 5, "noise", F.lit(3), 18).alias("z")).collect()
        for r in rows:
            head = np.frombuffer(f"5|{r['k']}|noise|".encode(), np.uint8)[None]
            z = np.concatenate([normal_columns(head, str(27 + i).encode())[0] for i in range(9)])
            np.testing.assert_allclose(z, r["z"], rtol=1e-12, atol=1e-13)
