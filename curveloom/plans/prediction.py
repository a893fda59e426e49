"""Query tables: shapes x conditions, envelope flags, blended predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveloom.functions.scalars import guarded_ratio
from curveloom.operators.matching import broadcast_conditions
from curveloom.operators.quality import envelope_flags, fill_conditions
from curveloom.operators.stacking import Weights, blend
from curveloom.plans.training import (
    TrainingPlan, flatten_shapes, prediction_columns, recorded_plan, score_with_saved,
    with_features,
)
from curveloom.sources.store import RunStore

CONDITIONS = ("alpha", "Re", "mach", "n_crit", "xtr_upper", "xtr_lower")


def query_rows(shapes: DataFrame, conditions: dict[str, float | Sequence[float]]) -> DataFrame:
    """Each shape with its conditions; single values stretch to the longest list.

    Conditions not given take their defaults. A Reynolds number that is not positive is an error.
    """
    with_lists = shapes
    for name, value in conditions.items():
        values = list(value) if isinstance(value, (list, tuple)) else [value]
        with_lists = with_lists.withColumn(name, F.array(*[F.lit(float(v)) for v in values]))
    rows = fill_conditions(broadcast_conditions(with_lists, list(conditions)))
    return rows.withColumn(
        "Re",
        F.when(F.col("Re") > 0, F.col("Re")).otherwise(
            F.raise_error(F.lit("a condition has a Reynolds number of zero or below"))
        ),
    )


def feature_rows(queries: DataFrame, plan: TrainingPlan) -> DataFrame:
    return with_features(flatten_shapes(queries), plan, labelled=False)


def predict_table(
    features: DataFrame, store: RunStore, keep: Sequence[str] = (), per_model: bool = False,
    weights: Weights | None = None,
) -> DataFrame:
    """Conditions, blended targets, their guarded ratio and envelope flags.

    ``features`` holds the raw feature columns of the recorded plan. With ``per_model`` each
    model's own prediction is added as ``model__target``.
    """
    plan = recorded_plan(store)
    weights = store.weights() if weights is None else weights
    names = sorted({m for by_model in weights.values() for m in by_model} - {"intercept"})
    columns = prediction_columns(names, plan.targets)
    blended = blend(score_with_saved(features, store, names, plan), weights, columns)
    parts = [*keep, *[c for c in CONDITIONS if c in features.columns], *plan.targets]
    extra = [c for m in names for c in columns[m].values()] if per_model else []
    return blended.select(
        *parts,
        guarded_ratio(F.col(plan.targets[0]), F.col(plan.drag)).alias("L_over_D"),
        envelope_flags(F.col("alpha"), F.col("Re"), F.col("mach")).alias("outside"),
        *extra,
    )


def export_predictions(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with a header or JSON lines; list columns become text in CSV."""
    if fmt == "csv":
        flat = table.withColumn("outside", F.array_join("outside", " "))
        flat.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        table.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
