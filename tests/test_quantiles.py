import numpy as np
import pytest

from curveloom.operators import quantiles
from curveloom.operators.quantiles import GroupSizes, exact_quantiles, measure_groups


@pytest.fixture
def values(spark):
    rng = np.random.default_rng(5)
    groups = {
        "wide": rng.lognormal(0, 4, 3000), "signed": rng.normal(0, 1, 2000),
        "same": np.full(500, 0.25), "near": 1 + rng.uniform(0, 1e-9, 1500),
        "zeros": np.array([0.0] * 30 + [-1.0] * 31), "one": np.array([7.0]), "two": np.array([1.0, 4.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("wide", None), ("none", None), ("two", float("nan"))]
    return groups, spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("largest", [10, 10**9])
def test_equals_numpy_with_one_and_two_levels(values, largest):
    groups, df = values
    wanted = {"p0": ("v", 0.0), "p50": ("v", 0.5), "p95": ("v", 0.95), "p100": ("v", 1.0)}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], wanted, GroupSizes(8, largest)).collect()}
    assert set(got) == set(groups) | {"none"}
    assert got["none"]["p50"] is None
    for g, vs in groups.items():
        for name, q in (("p0", 0), ("p50", 50), ("p95", 95), ("p100", 100)):
            assert got[g][name] == pytest.approx(np.percentile(vs, q), rel=1e-14, abs=1e-300), (g, name)


@pytest.mark.parametrize("largest_cell", [1, 50, 700])
def test_cells_are_cut_until_they_fit(values, spark, largest_cell):
    """All values within a thousandth, one outlier, and a cluster next to it."""
    groups, df = values
    rng = np.random.default_rng(6)
    groups["close"] = np.append(0.5 + rng.uniform(0, 5e-4, 2000), [1e9])
    groups["clustered"] = np.concatenate([0.5 + rng.uniform(0, 1e-13, 800), [0.5009]])
    df = df.unionByName(spark.createDataFrame([(g, float(v)) for g in ("close", "clustered") for v in groups[g]], df.schema))
    wanted = {"p10": ("v", 0.1), "p50": ("v", 0.5), "p95": ("v", 0.95)}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], wanted, GroupSizes(10, 3000), largest_cell=largest_cell).collect()}
    for g, vs in groups.items():
        for name, q in (("p10", 10), ("p50", 50), ("p95", 95)):
            assert got[g][name] == pytest.approx(np.percentile(vs, q), rel=1e-14, abs=1e-300), (g, name)


def test_measured_sizes(values):
    _, df = values
    sizes = measure_groups(df, ["g"])
    assert (sizes.groups, sizes.largest) == (8, 3001)
    assert sizes.buffered() and not sizes.buffered(100)


def test_buckets_never_decrease(spark):
    xs = sorted([0.0, *(s * m * 10.0**e for s in (1, -1) for m in (1, 1.0000001, 9.99) for e in range(-300, 300, 7))])
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    buckets = [r[0] for r in df.coalesce(1).select(quantiles.magnitude_bucket(df["v"])).collect()]
    assert buckets == sorted(buckets)
