"""Column helpers used by more than one operator."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_FLOOR = 1e-6


def finite(c: Column) -> Column:
    """True for ordinary numbers; false for NULL, NaN and the infinities."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def all_finite(columns: Sequence[Column]) -> Column:
    result = F.lit(True)
    for c in columns:
        result = result & finite(c)
    return result


def abs_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def guarded_ratio(numerator: Column, denominator: Column, above: float = 1e-9) -> Column:
    """Ratio, NULL unless the denominator is larger than ``above``."""
    return F.when(denominator > F.lit(above), numerator / denominator)


def floored_log(c: Column, floor: float = LOG_FLOOR) -> Column:
    return F.ln(F.greatest(c, F.lit(floor)))


def power_of_ten(c: Column) -> Column:
    return F.pow(F.lit(10.0), c)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        c = F.greatest(c, F.lit(low))
    if high is not None:
        c = F.least(c, F.lit(high))
    return c


def null_unless_finite(c: Column) -> Column:
    return F.when(finite(c), c)


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    """Ratio with zero denominators and non-finite results turned into NULL."""
    return null_unless_finite(F.try_divide(numerator, denominator))


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def is_whole(c: Column) -> Column:
    return close_to(c, F.rint(c))


def half_even(c: Column) -> Column:
    """Round to the nearest whole number, ties to even, as a long."""
    return F.bround(c, 0).cast("long")


def standardise(c: Column, mean: Column, std: Column) -> Column:
    return (c - mean) / std


def unstandardise(c: Column, mean: Column, std: Column) -> Column:
    return c * std + mean


# -- grids ---------------------------------------------------------------------------------


def line_grid(start: float, stop: float, n: int) -> Column:
    """``n`` evenly spaced values, both ends included."""
    if n < 2:
        raise ValueError("a line grid needs at least two points")
    step = (stop - start) / (n - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * F.lit(float(step)) + F.lit(float(start))
    )


def inclusive_sweep(start: Column, stop: Column, step: Column) -> Column:
    """``start, start + step, ...`` up to and including ``stop`` despite rounding."""
    last = F.ceil((stop + step / 2 - start) / step) - 1
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: start + i * step),
    ).otherwise(F.array().cast("array<double>"))


def cosine_stations(n: int) -> list[float]:
    """``n`` stations on [0, 1], dense at both ends."""
    if n < 4:
        raise ValueError(f"an outline needs four stations or more, not {n}")
    return [0.5 * (1.0 - math.cos(math.pi * i / (n - 1))) for i in range(n)]


def midcell_stations(n: int = 32) -> list[float]:
    """Centres of ``n`` equal cells on [0, 1]."""
    return [(i + 0.5) / n for i in range(n)]


# -- arrays --------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def convex_weights(cuts: Column) -> Column:
    """Cut points in (0, 1) to the lengths of the pieces; one more than the cuts, sum 1."""
    edges = F.concat(F.array(F.lit(0.0)), F.array_sort(cuts), F.array(F.lit(1.0)))
    return F.transform(
        F.slice(edges, F.lit(2), F.size(edges) - 1),
        lambda right, i: right - F.get(edges, i),
    )


def double_text(value: float) -> str:
    """A float as SQL text that reads back as the same double."""
    return f"{float(value)!r}D"


def literal_array(values: Sequence[float]) -> Column:
    """Array constant; one expression text instead of one call per element."""
    return F.expr(f"array({', '.join(double_text(v) for v in values)})")


# -- names ---------------------------------------------------------------------------------


def numbered_id(prefix: str, number: Column, width: int = 6) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def condition_key(value: Column, prefix: str = "re_") -> Column:
    """Label of a numeric group, truncated towards zero as in ``re_500000``."""
    return F.concat(F.lit(prefix), value.cast("long").cast("string"))


def file_stem(path: Column) -> Column:
    """Last path segment without its extension, lower case."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
