"""Descriptors of a shape given by class-shape coefficients.

The surfaces follow the published class-shape transformation with a round nose and a sharp tail
(class function ``sqrt(x) * (1 - x)``, Bernstein polynomials of degree 7), a leading-edge term
``x * (1 - x) ** 8.5`` shared by both surfaces and a tail thickness split between them. Values at
stations and the enclosed area are linear in the coefficients, so they are weighted sums with
constant weights; only the maxima and the perimeter walk along a grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveloom.functions.scalars import cosine_stations, double_text

N_WEIGHTS = 8
STATIONS = (0.15, 0.30, 0.45, 0.60, 0.75)
PROFILE_STATIONS = 101
PERIMETER_STATIONS = 101
NOSE_SOFTNESS = 0.03

DESCRIPTOR_COLUMNS = [
    "geom_max_thickness", "geom_max_camber", "geom_le_radius", "geom_te_angle", "geom_area",
    "geom_perimeter",
    *[f"geom_thickness_{round(x * 100)}" for x in STATIONS],
    *[f"geom_camber_{round(x * 100)}" for x in STATIONS],
]


def surface_basis(x: float) -> list[float]:
    """Value at ``x`` of each of the eight weighted basis curves."""
    degree = N_WEIGHTS - 1
    return [
        math.comb(degree, i) * x ** (i + 0.5) * (1.0 - x) ** (degree - i + 1)
        for i in range(N_WEIGHTS)
    ]


def nose_basis(x: float) -> float:
    return x * (1.0 - x) ** (N_WEIGHTS + 0.5)


def area_basis() -> list[float]:
    """Integral over the chord of each basis curve (a Beta function)."""
    degree = N_WEIGHTS - 1
    return [
        math.comb(degree, i)
        * math.gamma(i + 1.5) * math.gamma(degree - i + 2) / math.gamma(degree + 3.5)
        for i in range(N_WEIGHTS)
    ]


def station_text(x: float) -> str:
    """SQL text of a station: its place, the nose term and the basis values."""
    fields = {"x": x, "nose": nose_basis(x)}
    fields |= {f"b{i}": b for i, b in enumerate(surface_basis(x))}
    return f"named_struct({', '.join(f'{name!r}, {double_text(v)}' for name, v in fields.items())})"


def _even(n: int) -> list[float]:
    return [i / (n - 1) for i in range(n)]


def _weighted(weights: list[Column], station: Column) -> Column:
    # Written out: one arithmetic expression instead of intermediate arrays per station.
    total = weights[0] * station["b0"]
    for i in range(1, N_WEIGHTS):
        total = total + weights[i] * station[f"b{i}"]
    return total


def surfaces_at(
    upper: list[Column], lower: list[Column], le: Column, te: Column, xs: list[float]
) -> Column:
    """Array of (x, u, v): both surfaces at every station."""
    def point(station: Column) -> Column:
        nose = le * station["nose"]
        tail = te * station["x"] / 2
        return F.struct(
            station["x"].alias("x"),
            (_weighted(upper, station) + nose + tail).alias("u"),
            (_weighted(lower, station) + nose - tail).alias("v"),
        )

    return F.transform(F.expr(f"array({', '.join(map(station_text, xs))})"), point)


def soft_minimum(a: Column, b: Column, softness: Column) -> Column:
    """Smooth lower bound of two values: shifted so the exponentials cannot underflow together."""
    low, high = F.least(a, b), F.greatest(a, b)
    return low - softness * F.log1p(F.exp((low - high) / softness))


def coefficient(name: str, i: int) -> str:
    return f"{name}_{i}"


def describe_shapes(shapes: DataFrame, keep: list[str]) -> DataFrame:
    """Descriptor columns of rows with coefficients ``upper_0..7``, ``lower_0..7``, ``le``, ``te``.

    A shape without a nose is degenerate and gets zeros throughout.
    """
    upper = [F.col(coefficient("upper", i)) for i in range(N_WEIGHTS)]
    lower = [F.col(coefficient("lower", i)) for i in range(N_WEIGHTS)]
    le, te = F.col("le"), F.col("te")
    stations = list(STATIONS)
    outlined = shapes.select(
        *keep, *upper, *lower, le, te,
        surfaces_at(upper, lower, le, te, _even(PROFILE_STATIONS)).alias("_even"),
        surfaces_at(upper, lower, le, te, stations).alias("_stations"),
        surfaces_at(upper, lower, le, te, cosine_stations(PERIMETER_STATIONS)).alias("_cosine"),
    )
    nose_upper, nose_lower = upper[0] * upper[0] / 2, lower[0] * lower[0] / 2
    nose = nose_upper + nose_lower
    area = te / 2
    for i, weight in enumerate(area_basis()):
        area = area + (upper[i] - lower[i]) * F.lit(weight)
    last = N_WEIGHTS - 1
    described = {
        "geom_max_thickness": F.array_max(F.transform("_even", lambda p: p["u"] - p["v"])),
        "geom_max_camber": F.array_max(F.transform("_even", lambda p: (p["u"] + p["v"]) / 2)),
        "geom_le_radius": soft_minimum(nose_upper, nose_lower, F.lit(NOSE_SOFTNESS) * nose / 2),
        "geom_te_angle": F.degrees(F.atan(upper[last] - te / 2) - F.atan(lower[last] + te / 2)),
        "geom_area": area,
        "geom_perimeter": _length(F.col("_cosine")),
    }
    for i, x in enumerate(stations):
        p = F.get("_stations", F.lit(i))
        described[f"geom_thickness_{round(x * 100)}"] = p["u"] - p["v"]
        described[f"geom_camber_{round(x * 100)}"] = (p["u"] + p["v"]) / 2
    return outlined.select(*keep, *[
        F.when(nose > 0, described[name]).otherwise(F.lit(0.0)).alias(name)
        for name in DESCRIPTOR_COLUMNS
    ])


def _length(points: Column) -> Column:
    """Length of both surfaces as polylines, tail gap not included."""
    def step(p: Column, q: Column) -> Column:
        dx, du, dv = q["x"] - p["x"], q["u"] - p["u"], q["v"] - p["v"]
        return F.sqrt(dx * dx + du * du) + F.sqrt(dx * dx + dv * dv)

    steps = F.zip_with(
        F.slice(points, 1, PERIMETER_STATIONS - 1), F.slice(points, 2, PERIMETER_STATIONS - 1), step
    )
    return F.aggregate(steps, F.lit(0.0), lambda total, s: total + s)
