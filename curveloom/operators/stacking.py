"""Blending model predictions with learned or given weights.

Weights are a table (target, model, weight); the intercept is the pseudo-model ``intercept``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "intercept"
WEIGHTS_SCHEMA = "target string, model string, weight double"

Weights = dict[str, dict[str, float]]


def gram_aggregate(df: DataFrame, actual: str, predictions: Sequence[str]) -> dict[str, Column]:
    """Aggregates that hold all a linear fit needs: means, centred products and the row count.

    Missing pairs are left out of all of them alike.
    """
    names = [*predictions, actual]
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    values = {n: F.when(complete, F.col(n)) for n in names}
    aggregates = {"n": F.count_if(complete)}
    for i, a in enumerate(names):
        aggregates[f"mean_{i}"] = F.avg(values[a])
        for j in range(i, len(names)):
            aggregates[f"cov_{i}_{j}"] = F.covar_pop(values[a], values[names[j]])
    return aggregates


def gram_table(
    df: DataFrame, actual: dict[str, str], predictions: dict[str, dict[str, str]]
) -> DataFrame:
    """(target, i, j, product, n) of centred sums of products; the label is the last index."""
    aggregates, entries = [], []
    size = len(predictions) + 1
    for target, column in actual.items():
        used = [p[target] for p in predictions.values()]
        aggregates += [
            c.alias(f"{target}|{k}") for k, c in gram_aggregate(df, column, used).items()
        ]
        n = F.col(f"{target}|n")
        entries += [
            F.struct(
                F.lit(target).alias("target"), F.lit(i).alias("i"), F.lit(j).alias("j"),
                (F.col(f"{target}|cov_{i}_{j}") * n).alias("product"), n.alias("n"),
            )
            for i in range(size) for j in range(i, size)
        ]
    return df.agg(*aggregates).select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def nonnegative_ridge(gram: np.ndarray, cross: np.ndarray, alpha: float) -> np.ndarray:
    """Minimise w'Gw - 2c'w + alpha w'w over w >= 0 on the k x k sums of k models.

    Active sets: the weight with the steepest descent joins the free ones; a step that would turn a
    free weight negative stops at zero and fixes it there. Every round lowers the objective, so no
    set comes twice and the rounds end at the one minimum.
    """
    matrix = gram + alpha * np.eye(len(cross))
    weights = np.zeros(len(cross))
    free = np.zeros(len(cross), bool)
    slack = 1e-12 * max(1.0, float(np.abs(cross).max(initial=0.0)))
    while True:
        descent = np.where(free, -np.inf, cross - matrix @ weights)
        steepest = int(descent.argmax())
        if descent[steepest] <= slack:
            return weights
        free[steepest] = True
        while True:
            wanted = np.zeros(len(cross))
            wanted[free] = np.linalg.solve(matrix[np.ix_(free, free)], cross[free])
            falling = free & (wanted <= 0)
            if not falling.any():
                break
            step = (weights[falling] / (weights[falling] - wanted[falling])).min()
            weights = weights + step * (wanted - weights)
            free &= weights > 1e-15
            weights[~free] = 0.0
        weights = wanted


def fit_stacking(
    df: DataFrame, actual: dict[str, str], predictions: dict[str, dict[str, str]],
    alpha: float = 1.0,
) -> DataFrame:
    """Non-negative ridge weights per target over the models' predictions (validation rows).

    One pass over ``df`` for all targets; the driver sees one row of sums per target.
    """
    models = list(predictions)
    if not models:
        raise ValueError("stacking needs a model")
    aggregates = []
    for target, column in actual.items():
        used = [p[target] for p in predictions.values()]
        for k, c in gram_aggregate(df, column, used).items():
            aggregates.append(c.alias(f"{target}|{k}"))
    sums = df.agg(*aggregates).first().asDict()
    k = len(models)
    rows = []
    for target in actual:
        get = lambda name, t=target: sums[f"{t}|{name}"]
        n = get("n")
        if not n:
            raise ValueError("stacking needs validation rows")
        gram = np.array([[get(f"cov_{min(i, j)}_{max(i, j)}") * n for j in range(k)] for i in range(k)])
        cross = np.array([get(f"cov_{i}_{k}") * n for i in range(k)])
        weights = nonnegative_ridge(gram, cross, alpha)
        means = np.array([get(f"mean_{i}") for i in range(k)])
        rows += [(target, m, float(w)) for m, w in zip(models, weights)]
        rows.append((target, INTERCEPT, float(get(f"mean_{k}") - weights @ means)))
    return df.sparkSession.createDataFrame(rows, WEIGHTS_SCHEMA)


def weights_as_dict(table: DataFrame) -> Weights:
    weights: Weights = {}
    for r in table.collect():
        weights.setdefault(r["target"], {})[r["model"]] = r["weight"]
    return weights


def blend(
    df: DataFrame, weights: Weights, predictions: dict[str, dict[str, str]], prefix: str = ""
) -> DataFrame:
    """Wide form: add intercept + sum of weight * prediction per target, in physical units."""
    blended = {}
    for target, by_model in weights.items():
        unknown = sorted(set(by_model) - set(predictions) - {INTERCEPT})
        if unknown:
            raise ValueError(f"no predictions of models: {unknown}")
        total = F.lit(float(by_model.get(INTERCEPT, 0.0)))
        for model, columns in predictions.items():
            total = total + F.lit(float(by_model[model])) * F.col(columns[target])
        blended[f"{prefix}{target}"] = total
    return df.withColumns(blended)


#: Weights a table may have to be broadcast; beyond that it is joined by a shuffle.
MOST_BROADCAST_WEIGHTS = 100_000


def blend_long(predictions: DataFrame, weights: DataFrame, row_keys: Sequence[str]) -> DataFrame:
    """Long form: (row keys, target, model, predicted) joined with the weights table."""
    shared = weights.where(F.col("model") != INTERCEPT)
    intercepts = weights.where(F.col("model") == INTERCEPT).select(
        "target", F.col("weight").alias("_intercept")
    )
    table = shared.join(intercepts, "target", "left")
    if weights.count() <= MOST_BROADCAST_WEIGHTS:
        table = F.broadcast(table)
    return (
        predictions.join(table, ["target", "model"])
        .groupBy(*row_keys, "target")
        .agg(
            (F.sum(F.col("weight") * F.col("predicted")) + F.coalesce(F.max("_intercept"), F.lit(0.0)))
            .alias("predicted")
        )
    )


def blend_rows(
    df: DataFrame, weights: DataFrame, predictions: dict[str, dict[str, str]], keep: Sequence[str]
) -> DataFrame:
    """(keep, target, predicted) from wide rows and a weights table.

    The weights, one a target and model, are applied inside the row: nothing is joined, regrouped or
    shuffled, and rows need no key.
    """
    mixed = blend(df, weights_as_dict(weights), predictions, "_blend_")
    pairs = F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"_blend_{t}").alias("predicted"))
        for t in next(iter(predictions.values()))
    ])
    return mixed.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.target", "_p.predicted")


def weighted_mean(
    df: DataFrame, targets: Sequence[str], predictions: dict[str, dict[str, str]],
    weights: Sequence[float] | None = None, prefix: str = "",
) -> DataFrame:
    """Mean of the models' predictions, equal weights by default."""
    models = list(predictions)
    weights = [1.0] * len(models) if weights is None else list(weights)
    if len(weights) != len(models):
        raise ValueError(f"{len(models)} models, but {len(weights)} weights")
    means = {}
    for target in targets:
        total = F.lit(0.0)
        for model, w in zip(models, weights):
            total = total + F.lit(float(w)) * F.col(predictions[model][target])
        means[f"{prefix}{target}"] = total / F.lit(float(sum(weights)))
    return df.withColumns(means)
