"""Regression estimators by name: ridge, forest and boosting, each for all targets at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from curveloom.operators.gram import column_moments
from curveloom.operators.trees import (
    Bins, Residuals, Tree, TreeSpec, binned_cells, binned_rows, drawn_cells, grow, walk, with_state,
)
from curveloom.session import stored


@dataclass(frozen=True)
class ModelConfig:
    """Defaults of the three estimators."""

    seed: int = 42
    ridge_alpha: float = 1.0
    forest_trees: int = 250
    forest_min_leaf: int = 5
    forest_leaves: int = 12_000
    forest_depth: int | None = None
    forest_features: float = 0.8
    forest_bootstrap: bool = True
    boosting_rounds: int = 250
    boosting_rate: float = 0.1
    boosting_leaves: int = 127
    boosting_min_leaf: int = 20
    boosting_depth: int | None = None
    boosting_patience: int = 25
    boosting_tolerance: float = 1e-7

    def as_dict(self) -> dict:
        return asdict(self)


MODEL_NAMES = ("ridge", "random_forest", "boosting")
# Numbers of trees that the driver holds while a group of them grows, and that one scoring pass broadcasts.
GROUP_NUMBERS = 12_000_000
# Rounds of boosting between two stored states of the predictions.
STATE_ROUNDS = 5

NODE_SCHEMA = ("part int, tree int, targets array<int>, node int, feature int, cut double, left int, right int, "
               "value array<double>")
HISTORY_SCHEMA = "model string, target string, iteration int, loss double, held_loss double"


def select_models(only: Sequence[str] | None = None) -> list[str]:
    if only is None:
        return list(MODEL_NAMES)
    unknown = sorted(set(only) - set(MODEL_NAMES))
    if unknown:
        raise ValueError(f"no model is called {unknown}; there are {list(MODEL_NAMES)}")
    return [name for name in MODEL_NAMES if name in only]


@dataclass
class TargetModels:
    """A fitted model of all targets: a constant each, and a matrix of coefficients or trees in a flat table of nodes."""

    name: str
    features: list[str]
    targets: list[str]
    base: np.ndarray
    coefficients: np.ndarray | None = None
    nodes: DataFrame | None = None
    history: list[tuple[str, str, int, float, float]] = field(default_factory=list)

    def predict(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Add ``prefix + target`` for each target."""
        return score_models(df, {prefix: self})

    def save(self, folder: str, spark: SparkSession) -> None:
        row = (self.name, self.features, self.targets, self.base.tolist(),
               [] if self.coefficients is None else self.coefficients.tolist())
        spark.createDataFrame(
            [row], "name string, features array<string>, targets array<string>, base array<double>, "
            "coefficients array<array<double>>").write.mode("overwrite").parquet(f"{folder}/{self.name}/facts")
        if self.nodes is not None:
            self.nodes.write.mode("overwrite").parquet(f"{folder}/{self.name}/nodes")

    @classmethod
    def load(cls, folder: str, name: str, spark: SparkSession) -> "TargetModels":
        row = spark.read.parquet(f"{folder}/{name}/facts").first()
        linear = np.array(row["coefficients"]) if row["coefficients"] else None
        nodes = None if linear is not None else spark.read.schema(NODE_SCHEMA).parquet(f"{folder}/{name}/nodes")
        return cls(name, list(row["features"]), list(row["targets"]), np.array(row["base"]), linear, nodes)


# -- scoring ------------------------------------------------------------------------------------


@dataclass
class _FlatTrees:
    """Trees of one part of a node table, in arrays; ``first`` is where each tree begins."""

    first: np.ndarray
    targets: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    values: list[np.ndarray]

    @classmethod
    def of(cls, rows: pd.DataFrame) -> "_FlatTrees":
        rows = rows.sort_values(["tree", "node"])
        first = np.flatnonzero(np.append(True, np.diff(rows["tree"].to_numpy()) != 0)) if len(rows) else np.empty(0, int)
        ends = [*first[1:], len(rows)]
        return cls(first, [np.array(rows["targets"].iloc[a]) for a in first],
                   *(rows[c].to_numpy() for c in ("feature", "cut", "left", "right")),
                   [np.array(rows["value"].iloc[a:b].tolist(), dtype=float) for a, b in zip(first, ends)])

    def add_to(self, out: np.ndarray, x: np.ndarray) -> None:
        for a, targets, values in zip(self.first, self.targets, self.values):
            b = a + len(values)
            leaf = walk(self.feature[a:b], self.cut[a:b], self.left[a:b], self.right[a:b], x)
            out[:, targets] += values[leaf]


def _passes(models: dict[str, TargetModels]) -> list[list[tuple[int, int]]]:
    """(model, part) of the node tables, dealt into passes of a bounded number of numbers."""
    passes, room = [[]], GROUP_NUMBERS
    for m, model in enumerate(models.values()):
        if model.nodes is None:
            continue
        sizes = model.nodes.groupBy("part").agg(F.sum(F.size("value") + 8).alias("n")).orderBy("part").collect()
        for row in sizes:
            if row["n"] > room and passes[-1]:
                passes.append([])
                room = GROUP_NUMBERS
            passes[-1].append((m, row["part"]))
            room -= row["n"]
    return passes


def _scores(shared: Broadcast):
    """A function of a struct of features that gives the sums of the broadcast trees and matrices as an array."""
    def score(x: pa.Array) -> pa.Array:
        trees, linear, width = shared.value
        values = np.array([c.to_numpy(zero_copy_only=False) for c in x.flatten()]).T
        out = np.zeros((len(x), width))
        for at, base, matrix in linear:
            out[:, at:at + len(base)] += base if matrix is None else base + values @ matrix
        for at, flat in trees:
            flat.add_to(out[:, at:], values)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(out.ravel()))

    return arrow_udf(score, "array<double>")


def score_models(df: DataFrame, models: dict[str, TargetModels]) -> DataFrame:
    """Add ``prefix + target`` of every model; all models with the same features are scored in one pass over the rows.

    The node tables are broadcast in parts of a bounded size. Where they do not fit one pass, each further pass adds
    its trees to the sums that the pass before it stored.
    """
    names = list(models)
    features = models[names[0]].features if names else []
    if any(m.features != features for m in models.values()):
        for prefix, model in models.items():
            df = score_models(df, {prefix: model})
        return df
    widths = np.cumsum([0, *[len(m.targets) for m in models.values()]])
    inputs = F.struct(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    total = None
    for number, parts in enumerate(_passes(models)):
        trees = [(int(widths[m]), _FlatTrees.of(list(models.values())[m].nodes.where(F.col("part") == p).toPandas()))
                 for m, p in parts]
        linear = [] if number else [(int(widths[i]), m.base, m.coefficients) for i, m in enumerate(models.values())]
        shared = df.sparkSession.sparkContext.broadcast((trees, linear, int(widths[-1])))

        scores = _scores(shared)(inputs)
        if total is None:
            df = df.withColumn("_scores", scores)
        else:
            df = stored(df).withColumn("_scores", F.zip_with("_scores", scores, lambda a, b: a + b))
        total = number
    columns = [(f"{prefix}{t}", at + i) for (prefix, m), at in zip(models.items(), widths) for i, t in enumerate(m.targets)]
    return df.withColumns({c: F.get("_scores", F.lit(int(i))) for c, i in columns}).drop("_scores")


# -- fitting ------------------------------------------------------------------------------------


def _node_rows(trees: Sequence[tuple[Tree, Sequence[int]]], bins: Bins, scale: float, first: int) -> Iterator[pd.DataFrame]:
    for i, (tree, targets) in enumerate(trees, first):
        inner = tree.feature >= 0
        cut = np.array([bins.cuts[f][b] if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin)])
        # Values are of use in leaves only.
        value = [v.tolist() if not s else [0.0] * len(v) for v, s in zip(tree.value * scale, inner)]
        yield pd.DataFrame({
            "tree": i, "targets": [list(map(int, targets))] * len(cut), "node": np.arange(len(cut)),
            "feature": tree.feature, "cut": cut, "left": tree.left, "right": tree.right, "value": value})


def _node_table(spark: SparkSession, groups: Iterator[list[pd.DataFrame]]) -> DataFrame:
    """A stored node table; each group of trees is a part, of a bounded size, and leaves the driver at once."""
    table = None
    for part, rows in enumerate(groups):
        own = pd.concat(rows, ignore_index=True).assign(part=part)[
            ["part", "tree", "targets", "node", "feature", "cut", "left", "right", "value"]]
        written = stored(spark.createDataFrame(own, NODE_SCHEMA))
        table = written if table is None else table.unionByName(written)
    return table if table is not None else spark.createDataFrame([], NODE_SCHEMA)


def _fit_ridge(train: DataFrame, features: Sequence[str], targets: Sequence[str], config: ModelConfig) -> TargetModels:
    """Closed form for all targets from one matrix of moments; the penalty is on the plain sum of squares."""
    found = column_moments(train, [*features, *targets])
    k = len(features)
    weights = np.linalg.solve(found.products[:k, :k] + config.ridge_alpha * np.eye(k), found.products[:k, k:])
    return TargetModels("ridge", list(features), list(targets), found.mean[k:] - found.mean[:k] @ weights, weights)


def _fit_forests(
    rows: DataFrame, bins: Bins, targets: Sequence[str], configs: Sequence[ModelConfig],
) -> list[TargetModels]:
    """Every tree predicts all targets; the trees of all candidates grow in common scans, a group of them at a time."""
    spark, n_rows = rows.sparkSession, rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    single = any(c.forest_bootstrap for c in configs)
    every = tuple(range(len(targets)))
    jobs = []
    for c, config in enumerate(configs):
        spec = TreeSpec(every, config.forest_leaves, config.forest_min_leaf, config.forest_depth, config.forest_features,
                        seed=config.seed)
        for i in range(config.forest_trees):
            jobs.append((c, i, replace(spec, bootstrap=config.seed * 100_003 + i if config.forest_bootstrap else None,
                                       seed=config.seed * 31 + i)))
    written: list[list[pd.DataFrame]] = [[] for _ in configs]
    tables: list[DataFrame | None] = [None] * len(configs)
    parts = [0] * len(configs)

    def leave(c: int) -> None:
        own = _node_table(spark, iter([written[c]])).withColumn("part", F.lit(parts[c]))
        tables[c] = own if tables[c] is None else tables[c].unionByName(own)
        written[c], parts[c] = [], parts[c] + 1

    while jobs:
        group, numbers = [], 0
        while jobs and (not group or numbers < GROUP_NUMBERS):
            group.append(jobs.pop(0))
            spec = group[-1][2]
            numbers += 2 * min(spec.leaves, n_rows // spec.min_leaf + 1 if single else n_rows, 2 ** (spec.depth or 30)) * (len(targets) + 8)
        specs = [spec for *_, spec in group]
        drawn = drawn_cells(rows, specs, len(bins.features), len(targets)) if any(s.bootstrap is not None for s in specs) else rows
        trees, _ = grow(drawn, specs, len(bins.features))
        for (c, i, _), tree in zip(group, trees):
            written[c] += _node_rows([(tree, every)], bins, 1 / configs[c].forest_trees, i)
        for c in {c for c, *_ in group}:
            leave(c)
    return [TargetModels("random_forest", list(bins.features), list(targets), np.zeros(len(targets)), nodes=t)
            for t in tables]


def _gains_nothing(losses: Sequence[float], patience: int, tolerance: float) -> bool:
    """Whether none of the last ``patience`` losses is below the one before them by more than the tolerance."""
    return len(losses) > patience and min(losses[-patience:]) > losses[-patience - 1] - tolerance


def _fit_boosting(
    rows: DataFrame, bins: Bins, targets: Sequence[str], configs: Sequence[ModelConfig], base: np.ndarray, early: bool,
) -> list[TargetModels]:
    """One model a target and candidate; the next tree of all of them grows in common scans.

    A model ends after its rounds, or after ``boosting_patience`` rounds that gain nothing on the rows held back.
    """
    spark = rows.sparkSession
    models = [(c, t) for c in range(len(configs)) for t in range(len(targets))]
    own = Residuals(np.array([t for _, t in models]), np.array([base[t] for _, t in models]), [[] for _ in models],
                    np.array([configs[c].boosting_rate for c, _ in models]))
    state = rows
    grown: list[list[Tree]] = [[] for _ in models]
    losses: list[list[tuple[float, float]]] = [[] for _ in models]
    active = list(range(len(models)))
    while active:
        specs = [TreeSpec((m,), configs[c].boosting_leaves, configs[c].boosting_min_leaf, configs[c].boosting_depth,
                          seed=configs[c].seed) for m in active for c in [models[m][0]]]
        trees, loss = grow(state, specs, len(bins.features), residuals=own)
        for m in range(len(models)):
            losses[m].append(tuple(loss[:, 1 + m] / np.maximum(loss[:, 0], 1)))
        left = []
        for m, tree in zip(active, trees):
            config = configs[models[m][0]]
            if early and _gains_nothing([h for _, h in losses[m]], config.boosting_patience, config.boosting_tolerance):
                continue
            grown[m].append(tree)
            own.trees[m].append(tree)
            if len(tree.feature) > 1 and len(grown[m]) < config.boosting_rounds:
                left.append(m)
        active = left
        if active and max(map(len, own.trees)) >= STATE_ROUNDS:
            state, own = with_state(state, own), replace(own, base=np.zeros(len(models)), trees=[[] for _ in models])
    fitted = []
    for c, config in enumerate(configs):
        history, parts, part, numbers, i = [], [], [], 0, 0
        for m in (m for m, (d, _) in enumerate(models) if d == c):
            t = models[m][1]
            history += [("boosting", targets[t], k, *pair) for k, pair in enumerate(losses[m][: len(grown[m]) + 1])]
            for tree in grown[m]:
                part += _node_rows([(tree, (t,))], bins, config.boosting_rate, i)
                numbers, i = numbers + 9 * len(tree.feature), i + 1
                if numbers > GROUP_NUMBERS // 2:
                    parts, part, numbers = [*parts, part], [], 0
        parts += [part] if part else []
        fitted.append(TargetModels("boosting", list(bins.features), list(targets), np.array(base, dtype=float),
                                   nodes=_node_table(spark, iter(parts)), history=history))
    return fitted


def fit_candidates(
    train: DataFrame, features: Sequence[str], targets: Sequence[str], name: str, configs: Sequence[ModelConfig],
    stopping: Column | None = None,
) -> list[TargetModels]:
    """One model a configuration, all fitted by the same scans of the rows.

    ``stopping`` marks the rows that boosting holds back to see when to stop; mark whole entities. Other models
    use all rows. Labels must not be missing; a missing feature value is above all cuts of a tree.
    """
    if name == "ridge":
        return [_fit_ridge(train, features, targets, c) for c in configs]
    bins = Bins.fit(train, features)
    held = F.coalesce(stopping, F.lit(False)) if stopping is not None and name == "boosting" else F.lit(False)
    if name == "random_forest":
        # Trees that draw no rows take the rows of a cell as one; those that do need each row.
        drawing = any(c.forest_bootstrap for c in configs)
        rows = (binned_rows(train, bins, targets, F.xxhash64(*features, *targets), held) if drawing
                else binned_cells(train, bins, targets, held))
        return _fit_forests(rows, bins, targets, configs)
    rows = binned_cells(train, bins, targets, held)
    sides = train.groupBy(held.alias("held")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(t).alias(t) for t in targets]).collect()
    known = {r["held"]: r for r in sides}
    # Without rows on both sides of the mark there is nothing to stop on: use all rows and rounds.
    early = set(known) == {True, False}
    if set(known) == {True}:
        rows, known = rows.withColumn("held", F.lit(False)), {False: known[True]}
    base = np.array([known[False][t] if known else 0.0 for t in targets], dtype=float)
    return _fit_boosting(rows, bins, targets, configs, base, early)


def fit_models(
    train: DataFrame, features: Sequence[str], targets: Sequence[str], name: str,
    config: ModelConfig = ModelConfig(), stopping: Column | None = None,
) -> TargetModels:
    """Fit one model of all targets on scaled rows; see ``fit_candidates``."""
    return fit_candidates(train, features, targets, name, [config], stopping)[0]


def training_history(fitted: TargetModels, spark: SparkSession) -> DataFrame:
    """(model, target, iteration, loss, held_loss): mean squared errors before each round, of a model that has rounds.

    They are found by the scans of the rounds themselves.
    """
    return spark.createDataFrame(
        [(m, t.removeprefix("y_"), i, float(a), float(b)) for m, t, i, a, b in fitted.history], HISTORY_SCHEMA)


def ridge_coefficients(fitted: TargetModels, spark: SparkSession) -> DataFrame:
    """(target, term, coefficient) with the intercept as a term."""
    rows = [(t, f, float(fitted.coefficients[i, j])) for j, t in enumerate(fitted.targets)
            for i, f in enumerate(fitted.features)]
    rows += [(t, "intercept", float(b)) for t, b in zip(fitted.targets, fitted.base)]
    return spark.createDataFrame(rows, "target string, term string, coefficient double")
