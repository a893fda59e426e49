"""Scoring with a dense network from a table of weights (ReLU between layers)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYER_SCHEMA = "layer int, weights array<array<double>>, bias array<double>"
# A network is sent to every task, so its size is checked first.
MOST_PARAMETERS = 20_000_000

Layers = list[tuple[np.ndarray, np.ndarray]]


def load_layers(table: DataFrame) -> Layers:
    """Layers in order from (layer, weights as outputs x inputs, bias)."""
    size = table.select(
        F.sum(F.aggregate("weights", F.lit(0).cast("long"), lambda n, row: n + F.size(row)))
    ).first()[0]
    if not size or size > MOST_PARAMETERS:
        raise ValueError(f"a network needs between 1 and {MOST_PARAMETERS} weights, found {size}")
    rows = sorted(table.collect(), key=lambda r: r["layer"])
    return [(np.array(r["weights"], dtype=float), np.array(r["bias"], dtype=float)) for r in rows]


def score_dense(
    df: DataFrame, features: Sequence[str], layers: Layers, outputs: Sequence[str],
    keep: Sequence[str],
) -> DataFrame:
    """(keep..., outputs...): one matrix product per layer and Arrow batch."""
    if layers[-1][0].shape[0] != len(outputs):
        raise ValueError("the last layer must have one row per output")
    shared = df.sparkSession.sparkContext.broadcast(layers)
    features, outputs, keep = list(features), list(outputs), list(keep)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[features].to_numpy(dtype=float)
            for i, (weights, bias) in enumerate(shared.value):
                if i:
                    values = np.maximum(values, 0.0)
                values = values @ weights.T + bias
            result = batch[keep].reset_index(drop=True)
            for j, name in enumerate(outputs):
                result[name] = values[:, j]
            yield result

    used = df.select(*keep, *[c for c in features if c not in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
    schema = ", ".join([*fields, *[f"`{o}` double" for o in outputs]])
    return used.mapInPandas(score, schema)
