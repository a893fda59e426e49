"""Projection, row rules and reports on them."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from curveloom.functions.scalars import LOG_FLOOR, all_finite, finite

# Column names of the published tables (fixed values).
POLAR_COLUMNS = ("entity_id", "alpha_deg", "reynolds", "mach", "cl", "cd", "cm")
PROFILE_POINTS = 32
PROFILE_COLUMNS = [
    f"{side}_bl_{quantity}" for side in ("upper", "lower") for quantity in ("theta", "H", "ue_vinf")
]
HEAD_TARGETS = ["CL", "CD", "CM", "Top_Xtr", "Bot_Xtr"]

# Mean and deviation of log10 Reynolds number in the published dataset (fixed values).
LOG10_REYNOLDS = (5.5, 0.75)
# Largest angle of the published grid, with room for its jitter (fixed value).
LARGEST_ANGLE = 25.0


def _within(mean: float, deviation: float, times: int = 3) -> tuple[float, float]:
    """Powers of ten that are a number of deviations below and above a mean exponent."""
    return 10 ** (mean - times * deviation), 10 ** (mean + times * deviation)


REYNOLDS_ENVELOPE = _within(*LOG10_REYNOLDS)
ALPHA_ENVELOPE = (-LARGEST_ANGLE, LARGEST_ANGLE)

# Half-open condition regimes (fixed values).
REGIMES = [
    (-2.0, 0.0, "negative lift"),
    (0.0, 4.0, "attached flow"),
    (4.0, 8.0, "drag rise"),
    (8.0, 11.0, "near stall"),
]

# Conditions of a request that names none (fixed values).
DEFAULT_CONDITIONS = {"mach": 0.0, "n_crit": 9.0, "xtr_upper": 1.0, "xtr_lower": 1.0}


class MissingColumns(ValueError):
    pass


# -- columns ------------------------------------------------------------------------------------


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "required") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"the table lacks these {what} columns: {missing}")


def select_doubles(df: DataFrame, columns: Sequence[str], what: str = "required") -> DataFrame:
    require_columns(df, columns, what)
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns])


def columns_like(df: DataFrame, pattern: str, head: Sequence[str] = ()) -> list[str]:
    """``head`` followed by the columns whose name contains a match of ``pattern``."""
    return [*head, *[c for c in df.columns if re.search(pattern, c) and c not in head]]


def target_columns(df: DataFrame) -> list[str]:
    return columns_like(df, "bl_", HEAD_TARGETS)


def drop_overlap(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def normalise_types(df: DataFrame, id_column: str, numeric: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {id_column: F.col(id_column).cast("string"), **{c: F.col(c).cast("double") for c in numeric}}
    )


def as_polar(df: DataFrame) -> DataFrame:
    """Training-table names to the names of the polar table."""
    return df.withColumnsRenamed(
        {"alpha": "alpha_deg", "Re": "reynolds", "CL": "cl", "CD": "cd", "CM": "cm"}
    )


def fill_conditions(df: DataFrame) -> DataFrame:
    """Default for each absent or NULL condition column."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in df.columns else F.lit(v)
        for c, v in DEFAULT_CONDITIONS.items()
    })


def profiles_to_columns(df: DataFrame, arrays: Sequence[str], n: int = PROFILE_POINTS) -> DataFrame:
    """Array columns to one column per position: ``name_0 .. name_{n-1}``."""
    others = [c for c in df.columns if c not in arrays]
    return df.select(
        *others, *[F.get(F.col(a), F.lit(i)).alias(f"{a}_{i}") for a in arrays for i in range(n)]
    )


def columns_to_profiles(df: DataFrame, arrays: Sequence[str], n: int = PROFILE_POINTS) -> DataFrame:
    wide = {f"{a}_{i}" for a in arrays for i in range(n)}
    others = [c for c in df.columns if c not in wide]
    return df.select(*others, *[F.array(*[f"{a}_{i}" for i in range(n)]).alias(a) for a in arrays])


# -- rows ---------------------------------------------------------------------------------------


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(all_finite([F.col(c) for c in columns]))


def keep_recorded(df: DataFrame, ids: DataFrame, id_column: str, strict: bool = False) -> DataFrame:
    """Rows whose id is recorded in ``ids``; strict mode fails when there are none."""
    kept = df.join(ids.select(id_column).distinct(), id_column, "left_semi")
    if strict and kept.isEmpty():
        raise ValueError("none of the recorded ids is present")
    return kept


def regime_label(value: Column, regimes: Sequence[tuple[float, float, str]] = REGIMES) -> Column:
    """Label of the half-open interval around ``value``; NULL outside all of them."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(regimes):
        label = F.when((value >= F.lit(low)) & (value < F.lit(high)), F.lit(name)).otherwise(label)
    return label


#: Intervals up to this number are broadcast, more are joined by a shuffle.
MOST_BROADCAST_INTERVALS = 100_000
#: Up to so many break points a row is compared with each of them; more are searched.
FEW_BREAKS = 32


def _nodes_over(first: int, last: int, size: int) -> list[int]:
    """The fewest nodes of a binary tree whose leaves are exactly ``first`` to ``last`` of ``size`` leaves."""
    nodes, low, high = [], size + first, size + last + 1
    while low < high:
        if low & 1:
            nodes.append(low)
            low += 1
        if high & 1:
            high -= 1
            nodes.append(high)
        low, high = low >> 1, high >> 1
    return nodes


def join_intervals(
    df: DataFrame, value: str, bounds: DataFrame, most_broadcast: int = MOST_BROADCAST_INTERVALS
) -> DataFrame:
    """Inner join of values to half-open intervals ``[low, high)`` held in a table.

    The break points of the intervals are the leaves of a binary tree, found by binary search in the row. An interval is
    listed under the nodes that cover it, two a level at most, and a value looks at the nodes above its leaf, one a level:
    an equi-join that meets each pair once, for wide, open-ended (infinite) and overlapping intervals alike. Beyond
    ``most_broadcast`` intervals the leaves are cut at quantiles of the bounds, and the join is a shuffle. Missing
    values and bounds match nothing, and neither does an interval that ends before it starts.
    """
    few = bounds.count() <= most_broadcast
    ends = bounds.select(F.explode(F.array("low", "high").cast("array<double>")).alias("_end")).where(
        F.col("_end").isNotNull() & ~F.isnan("_end") & (F.abs("_end") < F.lit(float("inf"))))
    if few:
        breaks = np.array(sorted(r[0] for r in ends.distinct().collect()))
    else:
        shares = [k / most_broadcast for k in range(1, most_broadcast)]
        breaks = np.unique(np.array(ends.approxQuantile("_end", shares, 0.25 / most_broadcast), dtype=float))
    size = 1 << len(breaks).bit_length()
    shared = df.sparkSession.sparkContext.broadcast(breaks)

    def leaf(values: pa.Array) -> pa.Array:
        found = np.searchsorted(shared.value, values.to_numpy(zero_copy_only=False), "right")
        return pa.array(found + size, pa.int64())

    def nodes(low: pa.Array, high: pa.Array) -> pa.Array:
        firsts = np.searchsorted(shared.value, low.to_numpy(zero_copy_only=False), "right")
        lasts = np.searchsorted(shared.value, high.to_numpy(zero_copy_only=False), "left")
        return pa.array([_nodes_over(a, b, size) for a, b in zip(firsts.tolist(), lasts.tolist())], pa.list_(pa.int64()))

    low, high = (F.col(c).cast("double") for c in ("low", "high"))
    listed = bounds.where(low < high).withColumn("_node", F.explode(arrow_udf(nodes, "array<bigint>")(low, high)))
    above = F.transform(F.sequence(F.lit(0), F.lit(size.bit_length() - 1)), lambda i: F.call_function("shiftright", F.col("_leaf"), i))
    number = F.col(value).cast("double")
    if len(breaks) <= FEW_BREAKS:
        place = sum(((number >= F.lit(float(b))).cast("long") for b in breaks), F.lit(size).cast("long"))
    else:
        place = arrow_udf(leaf, "bigint")(number)
    found = df.where(F.col(value).isNotNull()).withColumn("_leaf", place).withColumn("_node", F.explode(above)).drop("_leaf")
    return found.join(F.broadcast(listed) if few else listed, "_node").where(
        (F.col(value) >= F.col("low")) & (F.col(value) < F.col("high"))).drop("_node")


def envelope_flags(
    alpha: Column, reynolds: Column, mach: Column,
    reynolds_range: tuple[float, float] = REYNOLDS_ENVELOPE,
    alpha_range: tuple[float, float] = ALPHA_ENVELOPE,
) -> Column:
    """Names of the conditions of a row that lie outside the training envelope (array)."""
    def outside(c: Column, bounds: tuple[float, float]) -> Column:
        return (c < F.lit(bounds[0])) | (c > F.lit(bounds[1]))

    return F.filter(
        F.array(
            F.when(outside(reynolds, reynolds_range), F.lit("reynolds")),
            F.when(outside(alpha, alpha_range), F.lit("alpha")),
            F.when(F.abs(mach) > 0, F.lit("mach")),
        ),
        lambda flag: flag.isNotNull(),
    )


def envelope_warnings(df: DataFrame, alpha: str, reynolds: str, mach: str) -> DataFrame:
    """One row for the batch: which conditions leave the envelope anywhere in it."""
    r_low, r_high = REYNOLDS_ENVELOPE
    a_low, a_high = ALPHA_ENVELOPE
    return df.agg(
        ((F.min(reynolds) < r_low) | (F.max(reynolds) > r_high)).alias("reynolds_outside"),
        ((F.min(alpha) < a_low) | (F.max(alpha) > a_high)).alias("alpha_outside"),
        (F.max(F.abs(F.col(mach))) > 0).alias("mach_outside"),
    )


# -- rules --------------------------------------------------------------------------------------


def polar_rules(
    numeric: Sequence[str], reynolds: str = "reynolds", drag: str = "cd"
) -> dict[str, Column]:
    """Violation of each rule, as a condition on a row."""
    return {
        "non_finite": ~all_finite([F.col(c) for c in numeric]),
        "reynolds_not_positive": ~finite(F.col(reynolds)) | (F.col(reynolds) <= 0),
        "drag_negative": finite(F.col(drag)) & (F.col(drag) < 0),
        "drag_not_loggable": finite(F.col(drag)) & (F.col(drag) < F.lit(-LOG_FLOOR)),
    }


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows (rule, n_rows, n_violations) from one pass over ``df``."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()],
    )
    entries = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_violations")) for name in rules
    ]))
    return counts.select("n_rows", entries.alias("_e")).select(
        "_e.rule", "n_rows", "_e.n_violations"
    )


def enforce(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Strict mode: fail with the report unless the table has rows and keeps every rule."""
    report = {r["rule"]: r for r in rule_report(df, rules).collect()}
    if next(iter(report.values()))["n_rows"] == 0:
        raise ValueError("the table is empty")
    broken = {name: r["n_violations"] for name, r in report.items() if r["n_violations"]}
    if broken:
        raise ValueError(f"rules violated (rule: rows): {broken}")
    return df


def orphans(df: DataFrame, catalog: DataFrame, id_column: str) -> DataFrame:
    """Distinct ids of ``df`` that the catalog does not hold."""
    return df.select(id_column).distinct().join(catalog.select(id_column), id_column, "left_anti")


class MissingEntities(ValueError):
    """Entities that are not where they must be; ``table`` holds all of them, however many."""

    def __init__(self, what: str, table: DataFrame) -> None:
        self.table = table
        self.n = table.count()
        super().__init__(f"{what}: {self.n} entities, for example {table.first()[0]} (all are in .table)")


def require_none(missing: DataFrame, what: str) -> None:
    """Fail with the whole table of missing entities unless it is empty."""
    if not missing.isEmpty():
        raise MissingEntities(what, missing)


def require_catalogued(df: DataFrame, catalog: DataFrame, id_column: str) -> None:
    require_none(orphans(df, catalog, id_column), "no catalog entry")


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def first_failures(failures: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The first ``k`` failures by id, as a preview."""
    return failures.orderBy(by).limit(k)


def dataset_counts(df: DataFrame, entity: str, sentinel: str) -> DataFrame:
    """Rows, distinct entities without the sentinel, and sentinel rows."""
    real = F.col(entity) != F.lit(sentinel)
    return df.agg(
        F.count_if(real).alias("n_rows"),
        F.count_distinct(F.when(real, F.col(entity))).alias("n_entities"),
        F.count_if(~real).alias("n_sentinel_rows"),
    )
