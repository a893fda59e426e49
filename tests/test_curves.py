import numpy as np
import pytest
from pyspark.sql import functions as F

from curveloom.functions.scalars import cosine_stations, literal_array, midcell_stations
from curveloom.operators import curves
from curveloom.operators.skew import find_hot_keys
from curveloom.sources.text import parse_pairs, point_rows

UPPER_FIRST = [(1, 0.0), (0.7, 0.05), (0.4, 0.08), (0.1, 0.05), (0, 0), (0.1, -0.03), (0.4, -0.04), (0.7, -0.02), (1, 0)]
NOSE_FIRST = [(0, 0), (0.1, 0.05), (0.4, 0.08), (0.7, 0.05), (1, 0), (0.7, -0.02), (0.4, -0.04), (0.1, -0.03), (0, 0)]
NOSE_LAST = [(0.05, 0.04), (0.4, 0.08), (0.7, 0.05), (1, 0), (0.7, -0.02), (0.4, -0.04), (0.1, -0.03), (0, 0)]


def _rows(spark, **outlines):
    rows = [(name, i, float(x), float(y)) for name, pts in outlines.items() for i, (x, y) in enumerate(pts, 1)]
    return spark.createDataFrame(rows, "curve string, ord int, x double, y double")


def test_three_traversals_give_upper_above_lower(spark):
    df = _rows(spark, a=UPPER_FIRST, b=NOSE_FIRST)
    good, rejected = curves.detect_branches(df, ["curve"], "x", "y", "ord")
    assert rejected.count() == 0
    out = {r["curve"]: r for r in curves.resample_outline(good, ["curve"], "x", "y", cosine_stations(20)).collect()}
    for r in out.values():
        x = np.array(r["x"])
        assert len(x) == 20 and x[0] == 0 and x[-1] == 1
        upper = np.interp(x, [0, 0.1, 0.4, 0.7, 1], [0, 0.05, 0.08, 0.05, 0])
        lower = np.interp(x, [0, 0.1, 0.4, 0.7, 1], [0, -0.03, -0.04, -0.02, 0])
        np.testing.assert_allclose(r["upper_y"], upper, atol=1e-12)
        np.testing.assert_allclose(r["lower_y"], lower, atol=1e-12)


def test_outline_that_ends_at_the_nose(spark):
    # One branch starts away from the nose: the outline is rejected, as its surface has a hole.
    _, rejected = curves.detect_branches(_rows(spark, c=NOSE_LAST), ["curve"], "x", "y", "ord")
    assert [r["reason"] for r in rejected.collect()] == ["both surfaces must reach the nose"]
    attached = [(1e-7, 0.0), *NOSE_FIRST[1:]]
    good, rejected = curves.detect_branches(_rows(spark, d=attached), ["curve"], "x", "y", "ord")
    assert rejected.count() == 0
    sides = good.groupBy("surface").agg(F.avg("y").alias("m")).collect()
    means = {r["surface"]: r["m"] for r in sides}
    assert means["upper"] > 0 > means["lower"]


def test_degenerate_outlines_are_rejected(spark):
    df = _rows(spark, flat=[(0.5, i / 10) for i in range(9)], onesided=[(i / 8, i) for i in range(9)])
    good, rejected = curves.detect_branches(df, ["curve"], "x", "y", "ord")
    assert good.count() == 0
    assert {r["curve"]: r["reason"] for r in rejected.collect()} == {
        "flat": "outline must have non-zero extent",
        "onesided": "points needed on both sides of the tail",
    }


@pytest.mark.parametrize("rule", [curves.split_by_step_sign, curves.split_at_minimum])
def test_surfaces_do_not_depend_on_how_hot_curves_are_cut(skewed, rule):
    df = skewed.withColumn("ord", F.col("id") + 1).withColumn("x", F.abs(F.col("id") - 430) / 450.0)
    df = df.select("curve", "ord", "x")
    plain, plain_out = rule(df, ["curve"], "x", "ord", hot=find_hot_keys(df, ["curve"], 10_000))
    hot = find_hot_keys(df, ["curve"], 50)
    assert hot.any
    cut, cut_out = rule(df, ["curve"], "x", "ord", hot=hot)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))
    assert sorted(map(tuple, plain_out.collect())) == sorted(map(tuple, cut_out.collect()))
    assert plain.count() > 900


def test_branches_of_a_hot_outline(skewed):
    df = skewed.withColumn("ord", F.col("id") + 1).withColumn("x", F.abs(F.col("id") - 430) / 450.0)
    df = df.select("curve", "ord", "x", "y")
    results = []
    for smallest in (10_000, 50):
        good, rejected = curves.detect_branches(
            df, ["curve"], "x", "y", "ord", find_hot_keys(df, ["curve"], smallest)
        )
        results.append((sorted(map(tuple, good.collect())), sorted(map(tuple, rejected.collect()))))
    assert results[0] == results[1]


def test_step_sign_rule_shares_the_turning_rows(spark):
    xs = [1, 0.8, 0.5, 0.2, 0, 0.2, 0.5, 0.8, 1]
    df = _rows(spark, a=[(x, 0) for x in xs])
    rows, rejected = curves.split_by_step_sign(df, ["curve"], "x", "ord")
    got = {s: [r["ord"] for r in rows.where(F.col("surface") == s).orderBy("place").collect()] for s in ("upper", "lower")}
    assert got == {"upper": [5, 4, 3, 2, 1], "lower": [5, 6, 7, 8, 9]}
    monotone = _rows(spark, m=[(x, 0) for x in range(9)], s=[(1, 0), (0, 0), (1, 0)])
    _, rejected = curves.split_by_step_sign(monotone, ["curve"], "x", "ord")
    assert {r["curve"]: r["reason"] for r in rejected.collect()} == {
        "m": "the curve does not turn into two sides", "s": "one side of the curve has too few samples",
    }


def test_resampling_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], {}
    for c in range(12):
        x = np.round(rng.uniform(-0.1, 1.1, 40), 2)
        y = rng.normal(size=40)
        x[5] = 0.5 / 32  # exactly on a station
        rows += [(c, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
        order = np.argsort(x, kind="stable")
        xs, ys = x[order], y[order]
        keep = np.concatenate(([True], np.diff(xs) > 1e-10))
        expected[c] = np.interp(midcell_stations(32), xs[keep], ys[keep])
    df = spark.createDataFrame(rows, "curve int, ord int, x double, y double").repartition(5)
    values, rejected = curves.resample_surface(df, ["curve"], "x", "ord", ["y"], midcell_stations(32))
    assert rejected.count() == 0
    for r in values.collect():
        np.testing.assert_allclose(r["y"], expected[r["curve"]], rtol=0, atol=1e-12)


def test_too_few_distinct_points_are_rejected(spark):
    df = _rows(spark, a=[(0.1, 1), (0.1, 2), (0.2, 3), (0.3, 4)], b=[(i / 4, i) for i in range(5)])
    values, rejected = curves.resample_surface(df, ["curve"], "x", "ord", ["y"], midcell_stations(8))
    assert [r["curve"] for r in values.collect()] == ["b"]
    assert [r["curve"] for r in rejected.collect()] == ["a"]


def test_ordered_points_and_validity(spark):
    row = spark.range(1).select(
        curves.ordered_points(literal_array([0, 0.5, 1]), literal_array([0, 2, 1]), literal_array([0, -2, -1])).alias("p"),
        curves.outline_is_valid(literal_array([0, 0.3, 0.6, 1]), literal_array([0, 1, 1, 0]), literal_array([0, 1, 1, 0])).alias("ok"),
        curves.outline_is_valid(literal_array([0, 0.5, 1]), literal_array([0, 1, 0]), literal_array([0, 1, 0])).alias("short"),
    ).first()
    assert [(p["x"], p["y"]) for p in row["p"]] == [(1, 1), (0.5, 2), (0, 0), (0.5, -2), (1, -1)]
    assert row["ok"] and not row["short"]


def test_text_to_outline(spark):
    body = "\n".join(f"{x}, {y}" if i % 2 else f"  {x}   {y} note" for i, (x, y) in enumerate(UPPER_FIRST))
    counted = "49 49\n" + "\n".join(f"{x} {y}" for x, y in UPPER_FIRST)
    short = "name\n" + "\n".join("0.5 0.5" for _ in range(7))
    df = spark.createDataFrame([("plain", "shape\n" + body), ("counted", counted), ("short", short), ("odd", "nan 1\n1d 2\n1_0 3")], "id string, text string")
    parsed = parse_pairs(df)
    rejected = {r["id"] for r in parsed.where("reason IS NOT NULL").collect()}
    assert rejected == {"short", "odd"}
    points = point_rows(parsed, ["id"]).orderBy("id", "ord").toPandas()
    for name in ("plain", "counted"):
        assert list(zip(points[points.id == name].x, points[points.id == name].y)) == [(float(a), float(b)) for a, b in UPPER_FIRST]
