"""Regression error reports.

All reports read paired rows: actual and predicted value of one target in one row, so nothing has
to be aligned. ``pair_targets`` brings a wide table into that form inside the row. Every report is
one aggregation with map-side combination; the shuffle carries one row per group and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveloom.functions.scalars import condition_key
from curveloom.operators.quality import REGIMES, regime_label
from curveloom.operators.quantiles import (
    LARGEST_BUFFERED_GROUP, GroupSizes, buffered_quantile, exact_quantiles, measure_groups,
)

# Smallest denominators of relative errors and the unit of drag errors (fixed values).
RELATIVE_FLOORS = {"cl": 0.05, "cd": 0.005, "cm": 0.01, "ld": 1.0}
DRAG_COUNTS = 1e4
SMALLEST_RATIO_DRAG = 1e-4
RATIO_FLOOR = 1e-6
SMALLEST_SCALE = 1e-8

TARGETS = ("cl", "cd", "cm")
RATIO = "ld"


def _pairs(
    models: dict[str, dict[str, str]], targets: Sequence[str], ratio: bool, guarded: bool,
) -> list[tuple[str, str, Column, Column]]:
    """(model, target, actual, predicted) of a wide table."""
    entries = []
    for model, predicted in models.items():
        for target in targets:
            entries.append((model, target, F.col(target), F.col(predicted[target])))
        if ratio:
            usable = F.lit(True)
            if guarded:
                usable = (F.col("cd") >= F.lit(SMALLEST_RATIO_DRAG)) & (F.col(predicted["cd"]) > 0)
            entries.append((
                model, RATIO,
                F.when(usable, F.try_divide(F.col("cl"), F.col("cd"))),
                F.when(usable, F.try_divide(F.col(predicted["cl"]), F.col(predicted["cd"]))),
            ))
    return entries


def pair_targets(
    df: DataFrame,
    models: dict[str, dict[str, str]],
    keep: Sequence[str],
    targets: Sequence[str] = TARGETS,
    ratio: bool = False,
    guarded: bool = True,
) -> DataFrame:
    """Long form (keep..., model, target, actual, predicted).

    ``models`` maps a model to its prediction column per target. With ``ratio`` the pair of cl/cd
    is added as target ``ld``: guarded, it is NULL on rows where either drag is not usable; else
    only where a drag is zero.
    """
    entries = _pairs(models, targets, ratio, guarded)
    exploded = F.explode(F.array(*[
        F.struct(
            F.lit(m).alias("model"), F.lit(t).alias("target"),
            a.cast("double").alias("actual"), p.cast("double").alias("predicted"),
        )
        for m, t, a, p in entries
    ]))
    return df.select(*keep, exploded.alias("_p")).select(
        *keep, "_p.model", "_p.target", "_p.actual", "_p.predicted"
    )


def slice_rows(
    df: DataFrame, alpha: str = "alpha", reynolds: str = "reynolds", overall: bool = False,
    regimes: Sequence[tuple[float, float, str]] = REGIMES,
) -> DataFrame:
    """One copy of each row per slice it belongs to: (dimension, value).

    Slices are the condition regime (rows outside all regimes have none), the Reynolds number and,
    on request, the whole table. The copies are combined again before the shuffle. Slice before
    pairing: a label is then worked out once per row, not once per model and target.
    """
    def entry(dimension: str, value: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))

    label = regime_label(F.col(alpha), regimes)
    entries = [
        F.when(label.isNotNull(), entry("regime", label)),
        entry("reynolds", condition_key(F.col(reynolds))),
    ]
    if overall:
        entries.append(entry("overall", F.lit("all")))
    others = [c for c in df.columns if c not in (alpha, reynolds)]
    return df.select(*others, F.explode(F.array(*entries)).alias("_s")).where(
        F.col("_s").isNotNull()
    ).select("_s.dimension", "_s.value", *others)


def _error() -> Column:
    return F.col("actual") - F.col("predicted")


def determination(sse: Column, sst: Column) -> Column:
    """1 - SSE/SST; without spread 1 for a perfect prediction and 0 otherwise."""
    return F.when(sst > 0, 1.0 - F.try_divide(sse, sst)).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def regression_metrics(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """mae, rmse and r2 per group."""
    e = _error()
    sst = F.var_pop("actual") * F.count("actual")
    return paired.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        determination(F.sum(e * e), sst).alias("r2"),
    )


def pooled_r2(paired: DataFrame, by: Sequence[str], target: str = "target") -> DataFrame:
    """One r2 over all targets of a group: summed errors over spreads around each target's mean."""
    e = _error()
    per_target = paired.groupBy(*by, target).agg(
        F.sum(e * e).alias("_sse"),
        (F.var_pop("actual") * F.count("actual")).alias("_sst"),
        F.count("actual").alias("_n"),
    )
    sse, sst = F.sum("_sse"), F.sum("_sst")
    return per_target.groupBy(*by).agg(
        F.when((F.max("_n") >= 2) & (sst > 0), 1.0 - F.try_divide(sse, sst))
        .otherwise(F.lit(0.0)).alias("pooled_r2")
    )


def mean_abs_error_by(df: DataFrame, by: Sequence[str], predicted: dict[str, str]) -> DataFrame:
    """Mean absolute error of each target per exact value of ``by``."""
    return df.groupBy(*by).agg(*[
        F.avg(F.abs(F.col(t) - F.col(p))).alias(f"{t}_abs_error") for t, p in predicted.items()
    ])


def bucketed(value: Column, width: float) -> Column:
    """Lower end of the bucket of a continuous condition, for conditions that never repeat."""
    return F.floor(value / F.lit(float(width))) * F.lit(float(width))


def relative_error_by(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean floored relative error in percent."""
    return paired.groupBy(*by).agg((F.avg(_relative()) * 100.0).alias("mape_percent"))


def _floor() -> Column:
    floor = F.lit(None).cast("double")
    for target, value in RELATIVE_FLOORS.items():
        floor = F.when(F.col("target") == target, F.lit(value)).otherwise(floor)
    return floor


def _relative() -> Column:
    return F.abs(_error()) / F.greatest(F.abs(F.col("actual")), _floor())


def percentage_metrics(
    paired: DataFrame, by: Sequence[str], largest_buffered_group: int = LARGEST_BUFFERED_GROUP,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Percentage-error suite per group of (by..., target).

    Columns that make sense for one target only are NULL elsewhere. Medians and percentiles are
    exact; how they are found depends on the size of the largest group, which is measured unless
    ``sizes`` is given.
    """
    by = [*by, "target"]
    rows = paired.withColumn("_e", F.abs(_error())).withColumn("_r", _relative())
    plain_aggregates = _percentage_aggregates(
        F.col("_e"), F.col("_r"), F.abs(F.col("actual")) >= 2.0 * _floor(), F.col("predicted"))
    quantiles = {"_median": ("_r", 0.5), "_p95": ("_e", 0.95)}
    sizes = measure_groups(paired, by) if sizes is None else sizes
    if sizes.buffered(largest_buffered_group):
        summary = rows.groupBy(*by).agg(
            *plain_aggregates,
            *[buffered_quantile(F.col(c), q).alias(name) for name, (c, q) in quantiles.items()],
        )
    else:
        summary = rows.groupBy(*by).agg(*plain_aggregates).join(
            exact_quantiles(rows, by, quantiles, sizes, every_group=False), by, "left"
        )
    return _percentage_columns(summary, by)


def _percentage_aggregates(e: Column, r: Column, defined: Column, predicted: Column) -> list[Column]:
    """Aggregates of absolute and relative errors, all but the quantiles."""
    return [
        F.avg(e).alias("_mae"),
        F.sqrt(F.avg(e * e)).alias("_rmse"),
        (F.avg(r) * 100.0).alias("_mape"),
        (F.avg(F.when(defined, r)) * 100.0).alias("_mape_defined"),
        F.max(e).alias("_max"),
        F.count(e).alias("n"),
        F.count_if(e.isNull()).alias("n_excluded"),
        F.count_if(predicted < 0).alias("_negative"),
    ]


def _percentage_columns(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    plain = F.col("target") != RATIO
    drag = F.col("target") == "cd"
    zero = F.lit(0.0)
    return summary.select(
        *by,
        F.coalesce("_mae", zero).alias("mae"),
        F.when(plain, F.col("_rmse")).alias("rmse"),
        F.coalesce("_mape", zero).alias("mape_percent"),
        F.coalesce(F.col("_median") * 100.0, zero).alias("median_ape_percent"),
        F.when(plain, F.coalesce("_mape_defined", zero)).alias("mape_percent_defined"),
        F.coalesce("_p95", zero).alias("p95_abs"),
        F.coalesce("_max", zero).alias("max_abs"),
        "n",
        "n_excluded",
        F.when(drag, F.col("_mae") * DRAG_COUNTS).alias("mae_drag_counts"),
        F.when(drag, F.col("_p95") * DRAG_COUNTS).alias("p95_drag_counts"),
        F.when(drag, F.col("_negative")).alias("n_negative_predictions"),
    )


def percentage_report(
    df: DataFrame, models: dict[str, dict[str, str]], by: Sequence[str], ratio: bool = False,
    largest_buffered_group: int = LARGEST_BUFFERED_GROUP,
) -> DataFrame:
    """``percentage_metrics`` by (model, by..., target) of a wide table.

    The pairs of a row are aggregated side by side and only the groups are unfolded, so no row is copied.
    """
    by = list(by)
    entries = _pairs(models, TARGETS, ratio, True)
    pairs = df.select(*by, *[
        c.cast("double").alias(f"_{name}{i}") for i, (_, _, a, p) in enumerate(entries) for name, c in (("a", a), ("p", p))
    ])
    rows = pairs.select("*", *[
        F.abs(F.col(f"_a{i}") - F.col(f"_p{i}")).alias(f"_e{i}") for i in range(len(entries))
    ])
    floors = [F.lit(RELATIVE_FLOORS.get(target)).cast("double") for _, target, _, _ in entries]
    rows = rows.select("*", *[
        (F.col(f"_e{i}") / F.greatest(F.abs(F.col(f"_a{i}")), floor)).alias(f"_r{i}") for i, floor in enumerate(floors)
    ])
    names = ["_mae", "_rmse", "_mape", "_mape_defined", "_max", "n", "n_excluded", "_negative"]
    aggregates = [
        c.alias(f"{name}{i}") for i, floor in enumerate(floors) for name, c in zip(names, _percentage_aggregates(
            F.col(f"_e{i}"), F.col(f"_r{i}"), F.abs(F.col(f"_a{i}")) >= 2.0 * floor, F.col(f"_p{i}")))
    ]
    quantiles = {}
    for i in range(len(entries)):
        quantiles |= {f"_median{i}": (f"_r{i}", 0.5), f"_p95{i}": (f"_e{i}", 0.95)}
    sizes = measure_groups(df, by)
    if sizes.buffered(largest_buffered_group):
        summary = rows.groupBy(*by).agg(
            *aggregates, *[buffered_quantile(F.col(c), q).alias(name) for name, (c, q) in quantiles.items()])
    else:
        summary = rows.groupBy(*by).agg(*aggregates).join(
            exact_quantiles(rows, by, quantiles, sizes, every_group=False), by, "left")
    unfolded = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(t).alias("target"), *[
            F.col(f"{name}{i}").alias(name) for name in (*names, "_median", "_p95")])
        for i, (m, t, _, _) in enumerate(entries)
    ]))
    return _percentage_columns(summary.select(*by, unfolded.alias("_s")).select(*by, "_s.*"), ["model", *by, "target"])


def drag_summary(
    df: DataFrame, models: dict[str, dict[str, str]], alpha: str = "alpha",
    reynolds: str = "reynolds",
) -> DataFrame:
    """Drag metrics and cl/cd errors per model: overall, by regime and by Reynolds number.

    The ratio errors take in every row, also with tiny or negative drag; only rows with a drag of
    zero, which have no ratio, are left out of them and counted.
    """
    entries = []
    for model, predicted in models.items():
        reference = F.try_divide(F.col("cl"), F.col("cd"))
        estimate = F.try_divide(F.col(predicted["cl"]), F.col(predicted["cd"]))
        entries.append(F.struct(
            F.lit(model).alias("model"), F.col("cd").alias("actual"),
            F.col(predicted["cd"]).alias("predicted"),
            F.abs(reference - estimate).alias("ratio_error"),
            F.greatest(F.abs(reference), F.lit(RATIO_FLOOR)).alias("ratio_scale"),
        ))
    used = {"cl", "cd"} | {p[t] for p in models.values() for t in ("cl", "cd")}
    sliced = slice_rows(df.select(alpha, reynolds, *sorted(used)), alpha, reynolds, overall=True)
    rows = sliced.select(
        "dimension", "value", F.explode(F.array(*entries)).alias("_p")
    ).select("dimension", "value", "_p.*")
    e = _error()
    return rows.groupBy("model", "dimension", "value").agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        determination(F.sum(e * e), F.var_pop("actual") * F.count("actual")).alias("r2"),
        F.avg("ratio_error").alias("ld_mae"),
        F.avg(F.col("ratio_error") / F.col("ratio_scale")).alias("ld_relative_mae"),
        F.count_if(F.col("ratio_error").isNull()).alias("n_ld_excluded"),
    )


def drag_error_by(
    df: DataFrame, by: str, models: dict[str, dict[str, str]]
) -> DataFrame:
    """Mean drag and cl/cd error per value of a condition and model, over all rows that have a ratio."""
    paired = pair_targets(df, models, [by], targets=("cd",), ratio=True, guarded=False)
    e = F.abs(_error())
    return paired.groupBy("model", by).agg(
        F.avg(F.when(F.col("target") == "cd", e)).alias("cd_abs_error"),
        F.avg(F.when(F.col("target") == RATIO, e)).alias("ld_abs_error"),
    )


def relative_dataset_error(
    paired: DataFrame, by: Sequence[str], largest_buffered_group: int = LARGEST_BUFFERED_GROUP
) -> DataFrame:
    """Mean absolute error over the mean size of the target, and the median relative error."""
    rows = paired.withColumn("_r", _relative())
    scaled = (
        F.avg(F.abs(_error())) / F.greatest(F.avg(F.abs(F.col("actual"))), F.lit(SMALLEST_SCALE))
    ).alias("relative_mae")
    sizes = measure_groups(paired, by)
    if sizes.buffered(largest_buffered_group):
        return rows.groupBy(*by).agg(
            scaled, (buffered_quantile(F.col("_r"), 0.5) * 100.0).alias("median_ape_percent")
        )
    medians = exact_quantiles(rows, by, {"_median": ("_r", 0.5)}, sizes, every_group=False)
    return rows.groupBy(*by).agg(scaled).join(medians, list(by), "left").select(
        *by, "relative_mae", (F.col("_median") * 100.0).alias("median_ape_percent")
    )


def relative_score(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over targets of the mean absolute error over the mean size of the target."""
    per_target = paired.groupBy(*by, "target").agg(
        (
            F.avg(F.abs(_error()))
            / F.greatest(F.avg(F.abs(F.col("actual"))), F.lit(SMALLEST_SCALE))
        ).alias("_relative")
    )
    return per_target.groupBy(*by).agg(F.avg("_relative").alias("score"))


def best_candidates(scores: DataFrame, by: Sequence[str], candidate: str) -> DataFrame:
    """Per group the candidate with the lowest score; ties go to the smaller candidate."""
    return scores.groupBy(*by).agg(
        F.min(F.struct("score", candidate)).alias("_best")
    ).select(*by, F.col("_best")[candidate].alias(candidate), F.col("_best")["score"].alias("score"))


def parity_limits(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """Common axis limits of actual and predicted values."""
    return paired.groupBy(*by).agg(
        F.least(F.min("actual"), F.min("predicted")).alias("low"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("high"),
    )


def upper_limit(
    paired: DataFrame, by: Sequence[str], q: float = 0.995, factor: float = 1.05,
    largest_buffered_group: int = LARGEST_BUFFERED_GROUP,
) -> DataFrame:
    """A high percentile of the actual values with some room above."""
    sizes = measure_groups(paired, by)
    if sizes.buffered(largest_buffered_group):
        return paired.groupBy(*by).agg(
            (buffered_quantile(F.col("actual"), q) * factor).alias("upper_limit")
        )
    found = exact_quantiles(paired, by, {"_q": ("actual", q)}, sizes)
    return found.select(*by, (F.col("_q") * factor).alias("upper_limit"))
