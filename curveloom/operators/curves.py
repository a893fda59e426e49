"""Operators on sampled curves: one row per sample, a curve key and an ordinal.

A curve may hold any share of the table. Facts about a curve are map-side combined aggregates
joined back with ``attach``; row-to-row steps go through ``OrderedRows``; resampling reduces every
curve to at most one row per grid cell before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveloom.functions.scalars import (
    all_finite, clip, double_text, finite, half_even, literal_array,
    null_unless_finite,
)
from curveloom.operators.ordered import OrderedRows, following, number, previous
from curveloom.operators.skew import HotKeys, find_hot_keys, reasons, with_facts

SMALLEST_STEP = 1e-10
NOSE_TOLERANCE = 1e-5
UPPER, LOWER = "upper", "lower"


def _hot(df: DataFrame, keys: Sequence[str], hot: HotKeys | None) -> HotKeys:
    return find_hot_keys(df, keys) if hot is None else hot


# -- row-to-row steps ---------------------------------------------------------------------------


def step_delta(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str = "delta",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Difference from the previous row of the curve; NULL on the first row."""
    rows = OrderedRows(df, keys, order, _hot(df, keys, hot)).add(_before=previous(column))
    return rows.withColumn(name, F.col(column) - F.col("_before")).drop("_before")


def drop_repeats(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
    hot: HotKeys | None = None,
) -> DataFrame:
    """Drop rows whose values equal those of the row before."""
    packed = df.withColumn("_values", F.struct(*columns))
    rows = OrderedRows(packed, keys, order, _hot(df, keys, hot)).add(_before=previous("_values"))
    return rows.where(
        F.col("_before").isNull() | (F.col("_values") != F.col("_before"))
    ).drop("_values", "_before")


def drop_near_duplicates(
    df: DataFrame, keys: Sequence[str], x: str, ordinal: str, step: float = SMALLEST_STEP,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Drop rows that lie at most ``step`` after the row before them in ``x`` order."""
    rows = OrderedRows(df, keys, [x, ordinal], _hot(df, keys, hot)).add(_before=previous(x))
    return rows.where(
        F.col("_before").isNull() | (F.col(x) - F.col("_before") > F.lit(step))
    ).drop("_before")


def renumber(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ord",
    hot: HotKeys | None = None,
) -> DataFrame:
    return OrderedRows(df, keys, order, _hot(df, keys, hot)).add(**{name: number()})


# -- surfaces -----------------------------------------------------------------------------------


def _labelled(rows: DataFrame, upper: Column, lower: Column) -> DataFrame:
    """One copy of a row per surface it belongs to; a border row may belong to both."""
    sides = F.filter(
        F.array(F.when(upper, F.lit(UPPER)), F.when(lower, F.lit(LOWER))),
        lambda side: side.isNotNull(),
    )
    return rows.withColumn("surface", F.explode(sides))


def split_by_step_sign(
    df: DataFrame, keys: Sequence[str], x: str, ordinal: str, shortest: int = 5,
    hot: HotKeys | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split a curve that travels down and back up in ``x``.

    The upper surface runs to the end of the last downward step, the lower one starts at the first
    upward step. ``place`` orders each surface in its direction of travel from the nose for the
    upper and in curve order for the lower surface. Returns (surfaces, rejects with reason).
    """
    keys = list(keys)
    hot = _hot(df, keys, hot)
    stepped = OrderedRows(df, keys, [ordinal], hot).add(_after=following(x))
    step = null_unless_finite(F.col("_after") - F.col(x))
    turned = with_facts(stepped, {
        "_last_down": F.max(F.when(step < 0, F.col(ordinal))),
        "_first_up": F.min(F.when(step > 0, F.col(ordinal))),
        "_first": F.min(ordinal),
        "_last": F.max(ordinal),
    }, hot)
    # Ordinals are consecutive, so the surface sizes follow from the borders.
    n_upper = F.col("_last_down") + 2 - F.col("_first")
    n_lower = F.col("_last") + 1 - F.col("_first_up")
    reason = F.when(
        F.col("_last_down").isNull() | F.col("_first_up").isNull(),
        F.lit("the curve does not turn into two sides"),
    ).when(
        (n_upper < shortest) | (n_lower < shortest), F.lit("one side of the curve has too few samples")
    )
    checked = turned.withColumn("reason", reason)
    rows = _labelled(
        checked.where(F.col("reason").isNull()),
        F.col(ordinal) <= F.col("_last_down") + 1,
        F.col(ordinal) >= F.col("_first_up"),
    )
    place = F.when(F.col("surface") == UPPER, F.col("_last_down") + 2 - F.col(ordinal)).otherwise(
        F.col(ordinal) - F.col("_first_up") + 1
    )
    return rows.select(*df.columns, "surface", place.cast("long").alias("place")), reasons(checked, keys)


def split_at_minimum(
    df: DataFrame, keys: Sequence[str], x: str, ordinal: str, shortest: int = 5,
    fewest_finite: int = 8, hot: HotKeys | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split a curve at its first row of least ``x``; that row is in both surfaces."""
    keys = list(keys)
    hot = _hot(df, keys, hot)
    usable_x = null_unless_finite(F.col(x))
    lowest = with_facts(df, {
        "_low": F.min(usable_x), "_finite": F.count(usable_x),
        "_first": F.min(ordinal), "_last": F.max(ordinal),
    }, hot)
    nosed = with_facts(
        lowest, {"_nose": F.min(F.when(F.col(x) == F.col("_low"), F.col(ordinal)))}, hot
    )
    reason = F.when(
        F.col("_finite") < fewest_finite, F.lit("the curve has too few samples")
    ).when(
        (F.col("_nose") + 1 - F.col("_first") < shortest)
        | (F.col("_last") + 1 - F.col("_nose") < shortest),
        F.lit("one side of the curve has too few samples"),
    )
    checked = nosed.withColumn("reason", reason)
    rows = _labelled(
        checked.where(F.col("reason").isNull()),
        F.col(ordinal) <= F.col("_nose"),
        F.col(ordinal) >= F.col("_nose"),
    )
    return rows.select(*df.columns, "surface"), reasons(checked, keys)


def detect_branches(
    df: DataFrame, keys: Sequence[str], x: str, y: str, ordinal: str,
    hot: HotKeys | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Recognise the traversal of a closed outline and label its two branches.

    Repeated points are dropped, ``x`` is scaled to [0, 1] per curve and the outline is cut at its
    nose (or, when it starts or ends there, at its tail). The branch with the larger mean ordinate
    is the upper one. Returns (keys, surface, ordinal, x, y) and rejects with reason.
    """
    keys = list(keys)
    hot = _hot(df, keys, hot)
    usable = df.where(all_finite([F.col(x), F.col(y)]))
    kept = drop_repeats(usable, keys, [ordinal], [x, y], hot).select(*keys, ordinal, x, y)
    measured = with_facts(kept, {"_low": F.min(x), "_high": F.max(x)}, hot)
    extent = F.col("_high") - F.col("_low")
    flat = extent <= F.lit(SMALLEST_STEP)
    scaled = measured.withColumn("_flat", flat).withColumn(
        x, F.when(~flat, (F.col(x) - F.col("_low")) / extent)
    ).drop("_low", "_high")

    # After scaling the nose rows have x = 0 and the tail rows x = 1 exactly.
    at_nose, at_tail = F.col(x) == 0.0, F.col(x) == 1.0
    turned = with_facts(scaled, {
        "_first": F.min(ordinal),
        "_last": F.max(ordinal),
        "_nose": F.min(F.when(at_nose, F.col(ordinal))),
        "_tail_first": F.min(F.when(at_tail, F.col(ordinal))),
        "_tail_last": F.max(F.when(at_tail, F.col(ordinal))),
    }, hot)
    nose_first = F.col("_nose") == F.col("_first")
    nose_last = ~nose_first & (F.col("_nose") == F.col("_last"))
    cut = F.when(nose_first, F.col("_tail_first")).when(nose_last, F.col("_tail_last")).otherwise(
        F.col("_nose")
    )
    one_sided = (nose_first & (F.col("_tail_first") == F.col("_last"))) | (
        nose_last & (F.col("_tail_last") == F.col("_first"))
    )
    # Read backwards, the branch after the cut comes first.
    formed = turned.select(
        *keys, ordinal, x, y, "_flat", cut.alias("_cut"), nose_last.alias("_reversed"),
        one_sided.alias("_one_sided"),
    )
    before, after = F.col(ordinal) <= F.col("_cut"), F.col(ordinal) >= F.col("_cut")
    in_a = F.when(F.col("_reversed"), after).otherwise(before)
    in_b = F.when(F.col("_reversed"), before).otherwise(after)
    sided = with_facts(formed.withColumns({"_in_a": in_a, "_in_b": in_b}), {
        "_mean_a": F.avg(F.when(F.col("_in_a"), F.col(y))),
        "_mean_b": F.avg(F.when(F.col("_in_b"), F.col(y))),
        "_start_a": F.min(F.when(F.col("_in_a"), F.col(x))),
        "_start_b": F.min(F.when(F.col("_in_b"), F.col(x))),
    }, hot)
    detached = F.greatest("_start_a", "_start_b") > F.lit(NOSE_TOLERANCE)
    checked = sided.withColumn(
        "reason",
        F.when(F.col("_flat"), F.lit("outline must have non-zero extent"))
        .when(F.col("_one_sided"), F.lit("points needed on both sides of the tail"))
        .when(detached, F.lit("both surfaces must reach the nose")),
    )
    a_is_upper = F.col("_mean_a") >= F.col("_mean_b")
    good = _labelled(
        checked.where(F.col("reason").isNull()),
        F.when(a_is_upper, F.col("_in_a")).otherwise(F.col("_in_b")),
        F.when(a_is_upper, F.col("_in_b")).otherwise(F.col("_in_a")),
    ).select(*keys, "surface", ordinal, x, y)
    return good, reasons(checked, keys)


def mean_by_abscissa(
    df: DataFrame, keys: Sequence[str], x: str, columns: Sequence[str]
) -> DataFrame:
    """Average the values of samples that share an ``x``."""
    return df.groupBy(*keys, x).agg(*[F.avg(c).alias(c) for c in columns])


# -- resampling ---------------------------------------------------------------------------------


def resample(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    columns: Sequence[str],
    stations: Sequence[float],
    fewest: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Piecewise-linear values of each curve at increasing ``stations``, clamped at the ends.

    ``x`` must be unique within a curve. A station depends only on the sample below it and the one
    above it, so each curve is first reduced to the lowest and highest sample of every grid cell
    (combined before the shuffle); the at most ``size(stations) + 1`` remaining rows per curve are
    then interpolated in an array. Returns (keys, one array per column) and rejects with reason.
    """
    keys = list(keys)
    columns = list(columns)
    samples = df.where(all_finite([F.col(x), *[F.col(c) for c in columns]]))
    # Number of stations below the sample, as plain comparisons that are compiled.
    cell = F.expr(" + ".join(f"cast(`{x}` > {double_text(s)} AS INT)" for s in stations))
    reduced = samples.withColumn("_cell", cell).groupBy(*keys, "_cell").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(x).alias("_x0"),
        F.max(x).alias("_x1"),
        *[F.min_by(c, x).alias(f"_first_{c}") for c in columns],
        *[F.max_by(c, x).alias(f"_last_{c}") for c in columns],
    )
    gathered = reduced.groupBy(*keys).agg(
        F.sum("_n").alias("_n"),
        F.array_sort(F.collect_list(F.struct(
            "_cell", "_x0", "_x1",
            *[f"_first_{c}" for c in columns], *[f"_last_{c}" for c in columns],
        ))).alias("_cells"),
    )
    rejected = gathered.where(F.col("_n") < fewest).select(
        *keys, F.lit("not enough different abscissas on one side").alias("reason")
    )

    def neighbours(station: Column, i: Column) -> Column:
        below = F.filter(F.col("_cells"), lambda c: c["_cell"] <= i)
        return F.struct(
            station.alias("at"),
            F.try_element_at(below, F.lit(-1)).alias("left"),
            F.get(F.col("_cells"), F.size(below)).alias("right"),
        )

    pairs = gathered.where(F.col("_n") >= fewest).withColumn(
        "_pairs", F.transform(literal_array(stations), neighbours)
    )

    def values(c: str) -> Column:
        def value(pair: Column) -> Column:
            left, right, at = pair["left"], pair["right"], pair["at"]
            y0, y1 = left[f"_last_{c}"], right[f"_first_{c}"]
            slope = (y1 - y0) / (right["_x0"] - left["_x1"])
            return (
                F.when(left.isNull(), y1)
                .when(right.isNull() | (left["_x1"] == at), y0)
                .otherwise(slope * (at - left["_x1"]) + y0)
            )

        return F.transform("_pairs", value)

    resampled = pairs.select(*keys, *[values(c).alias(c) for c in columns])
    return resampled, rejected


def resample_surface(
    df: DataFrame, keys: Sequence[str], x: str, ordinal: str, columns: Sequence[str],
    stations: Sequence[float], hot: HotKeys | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate removal, then ``resample``; at least four distinct points are needed."""
    valid = df.where(all_finite([F.col(x), *[F.col(c) for c in columns]]))
    unique = drop_near_duplicates(valid, keys, x, ordinal, hot=hot)
    return resample(unique, keys, x, columns, stations, fewest=4)


def resample_outline(
    branches: DataFrame, keys: Sequence[str], x: str, y: str, stations: Sequence[float]
) -> DataFrame:
    """Both branches of an outline on one grid: columns x, upper_y, lower_y (arrays)."""
    keys = list(keys)
    means = mean_by_abscissa(branches, [*keys, "surface"], x, [y])
    values, _ = resample(means, [*keys, "surface"], x, [y], stations)
    return values.groupBy(*keys).agg(
        F.first(literal_array(stations)).alias("x"),
        F.max(F.when(F.col("surface") == UPPER, F.col(y))).alias("upper_y"),
        F.max(F.when(F.col("surface") == LOWER, F.col(y))).alias("lower_y"),
    )


# -- shapes held as arrays ----------------------------------------------------------------------


def outline_is_valid(x: Column, upper: Column, lower: Column) -> Column:
    """Equal lengths, at least four points, all finite."""
    same = (F.size(x) == F.size(upper)) & (F.size(x) == F.size(lower)) & (F.size(x) >= 4)
    return F.coalesce(
        same & F.forall(F.concat(x, upper, lower), finite), F.lit(False)
    )


def ordered_points(x: Column, upper: Column, lower: Column) -> Column:
    """Tail to nose along the upper surface, then nose to tail along the lower one."""
    def pairs(a: Column) -> Column:
        return F.zip_with(x, a, lambda p, q: F.struct(p.alias("x"), q.alias("y")))

    return F.concat(F.reverse(pairs(upper)), F.slice(pairs(lower), 2, F.greatest(F.size(x) - 1, F.lit(0))))


def shape_vector(upper: Column, lower: Column) -> Column:
    return F.concat(upper, lower)


# -- tables along a condition -------------------------------------------------------------------


def polar_table(
    df: DataFrame, entity: str, condition: str, actual: dict[str, str], predicted: dict[str, str],
) -> DataFrame:
    """Actual and predicted values with their ratio cl/cd, for curves along ``condition``."""
    return df.select(
        entity,
        condition,
        *[F.col(c).alias(t) for t, c in actual.items()],
        *[F.col(c).alias(f"pred_{t}") for t, c in predicted.items()],
        F.try_divide(F.col(actual["cl"]), F.col(actual["cd"])).alias("ratio"),
        F.try_divide(F.col(predicted["cl"]), clip(F.col(predicted["cd"]), low=1e-8)).alias("pred_ratio"),
    )


def sorted_for_export(df: DataFrame, entity: str, condition: str) -> DataFrame:
    """Files in entity order, rows in condition order; long entities span several files."""
    return df.repartitionByRange(entity, condition).sortWithinPartitions(entity, condition)


def sweep_position(value: Column) -> Column:
    """Sort key of a sweep: zero and positive conditions upwards first, then negative downwards."""
    near_zero = F.abs(value) <= F.lit(1e-10)
    return F.struct(
        F.when(near_zero, 0).when(value > 0, 1).otherwise(2).alias("side"),
        F.abs(value).alias("size"),
    )


def thousandths(value: Column) -> Column:
    """Integer key of a condition rounded to three decimals."""
    return half_even(value * 1000)
