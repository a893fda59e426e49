"""Values joined to intervals: open-ended, wide, overlapping, empty and missing bounds, few and many of them."""

import random

import pytest

from curveloom.operators.quality import _nodes_over, join_intervals

INF = float("inf")


@pytest.mark.parametrize("n, most", [(3, 100_000), (60, 100_000), (60, 10)])
def test_against_every_pair(spark, n, most):
    rng = random.Random(n + most)
    bounds = [(i, rng.choice([-INF, round(rng.uniform(-5, 5), 1)]), rng.choice([INF, round(rng.uniform(-5, 5), 1), 1e9]))
              for i in range(n)]
    bounds += [(900, -INF, INF), (901, None, 1.0), (902, 1.0, None), (903, 2.0, 2.0), (904, 3.0, 1.0), (905, -INF, 0.0), (906, 0.0, INF)]
    values = [round(rng.uniform(-6, 6), 1) for _ in range(80)] + [0.0, -INF, INF, None, 2.0, 1e12]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    table = spark.createDataFrame(bounds, "id int, low double, high double")
    got = sorted((r["k"], r["id"]) for r in join_intervals(df, "v", table, most).collect())
    wanted = sorted((k, i) for k, v in enumerate(values) for i, a, b in bounds
                    if None not in (v, a, b) and a <= v < b)
    assert got == wanted and len(got) > 100


def test_no_intervals(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    assert join_intervals(df, "v", spark.createDataFrame([], "low double, high double")).count() == 0


def test_nodes_cover_exactly_their_leaves():
    for size in (1, 2, 8, 16):
        for first in range(size):
            for last in range(first, size):
                leaves = []
                for node in _nodes_over(first, last, size):
                    low = high = node
                    while low < size:
                        low, high = 2 * low, 2 * high + 1
                    leaves += range(low - size, high - size + 1)
                assert sorted(leaves) == list(range(first, last + 1))
