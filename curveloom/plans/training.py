"""Train, evaluate, stack and search: jobs composed of the operators."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveloom.functions.draws import uniform
from curveloom.functions.scalars import finite
from curveloom.functions.shape import DESCRIPTOR_COLUMNS
from curveloom.operators.features import (
    CONDITION_COLUMNS, Scaler, add_descriptors, log_label, unlog_label,
)
from curveloom.operators.metrics import (
    best_candidates, pair_targets, regression_metrics, relative_score,
)
from curveloom.operators.models import (
    ModelConfig, TargetModels, fit_candidates, fit_models, score_models, select_models, training_history,
)
from curveloom.operators.quality import (
    PROFILE_COLUMNS, PROFILE_POINTS, keep_recorded, require_columns, target_columns,
)
from curveloom.operators.split import (
    TEST, TRAIN, VALIDATION, entity_split, fixed_holdout_split, label_rows, rows_of,
    sample_entities,
)
from curveloom.operators.stacking import blend, fit_stacking, weighted_mean, weights_as_dict
from curveloom.session import stored
from curveloom.sources.store import RunStore
from curveloom.sources.tables import combine

SHAPE_FEATURES = [
    *[f"upper_{i}" for i in range(8)], *[f"lower_{i}" for i in range(8)], "le", "te",
]
ALL_FEATURES = [*SHAPE_FEATURES, *CONDITION_COLUMNS, *DESCRIPTOR_COLUMNS]
STOPPING_SHARE = 0.1


@dataclass(frozen=True)
class TrainingPlan:
    """What to train on; the columns are addressed by name throughout.

    Without ``targets`` every output and profile position of the table is a target.
    """

    features: tuple[str, ...] = tuple(ALL_FEATURES)
    targets: tuple[str, ...] | None = None
    entity: str = "entity_id"
    reynolds: str | None = "Re"
    drag: str = "CD"
    log_drag: bool = False
    seed: int = 42
    test_fraction: float = 0.2
    validation_fraction: float = 0.2

    def on(self, df: DataFrame) -> "TrainingPlan":
        """The plan with the targets it has on a table."""
        return self if self.targets is not None else replace(self, targets=all_targets(df))


def flatten_shapes(df: DataFrame) -> DataFrame:
    """Shape arrays to the 18 flat feature columns."""
    return df.withColumns({
        **{f"upper_{i}": F.get("upper", F.lit(i)) for i in range(8)},
        **{f"lower_{i}": F.get("lower", F.lit(i)) for i in range(8)},
    })


def with_features(df: DataFrame, plan: TrainingPlan, labelled: bool = True) -> DataFrame:
    """Derive whatever feature columns of the plan are missing, then check that all exist.

    Rows to be predicted have no targets: pass ``labelled=False``.
    """
    wanted = set(plan.features)
    if wanted & set(DESCRIPTOR_COLUMNS):
        df = add_descriptors(df, plan.entity)
    if wanted & set(SHAPE_FEATURES) - set(df.columns):
        df = flatten_shapes(df)
    require_columns(df, plan.features, "feature")
    if labelled:
        plan = plan.on(df)
        df = flatten_profiles(df, plan.targets)
        require_columns(df, plan.targets, "target")
    return df


def all_targets(df: DataFrame) -> tuple[str, ...]:
    """Names of everything a training table has to predict: the outputs it holds and every position
    of its profiles, whether these are arrays or already columns."""
    arrays = [c for c in PROFILE_COLUMNS if c in df.columns]
    wide = [f"{a}_{i}" for a in arrays for i in range(PROFILE_POINTS)]
    columns = [c for c in target_columns(df) if c in df.columns and c not in arrays]
    return tuple([*columns, *[c for c in wide if c not in columns]])


def flatten_profiles(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Profile arrays to columns, as far as positions of theirs are targets and not columns yet."""
    missing = set(targets) - set(df.columns)
    arrays = [a for a in PROFILE_COLUMNS if a in df.columns and any(t.startswith(f"{a}_") for t in missing)]
    return df.withColumns({
        f"{a}_{i}": F.get(F.col(a), F.lit(i)) for a in arrays for i in range(PROFILE_POINTS) if f"{a}_{i}" in missing
    }) if arrays else df


def scale_inputs(df: DataFrame, scaler: Scaler, plan: TrainingPlan) -> DataFrame:
    """Scaled copies ``z_*`` of the features; the originals stay for reports."""
    raw = df.withColumns({
        f"z_{c}": F.log10(F.col(c)) if c == plan.reynolds else F.col(c) for c in plan.features
    })
    return raw.withColumns({
        f"z_{c}": (F.col(f"z_{c}") - F.lit(scaler.statistics[c][0])) / F.lit(scaler.statistics[c][1])
        for c in plan.features
    })


def _scaled_names(plan: TrainingPlan) -> list[str]:
    return [f"z_{c}" for c in plan.features]


def fit_scaler(train: DataFrame, plan: TrainingPlan) -> Scaler:
    """Statistics of inputs and labels from training rows, in one pass."""
    logged = train
    if plan.reynolds in plan.features:
        logged = logged.withColumn(plan.reynolds, F.log10(F.col(plan.reynolds)))
    if plan.log_drag and plan.drag in plan.targets:
        logged = log_label(logged, plan.drag)
    return Scaler.fit(logged, [*plan.features, *plan.targets])


def scale_labels(df: DataFrame, scaler: Scaler, plan: TrainingPlan) -> DataFrame:
    """Scaled labels ``y_*``."""
    labelled = df.withColumns({f"y_{t}": F.col(t) for t in plan.targets})
    if plan.log_drag and plan.drag in plan.targets:
        labelled = log_label(labelled, f"y_{plan.drag}")
    return labelled.withColumns({
        f"y_{t}": (F.col(f"y_{t}") - F.lit(scaler.statistics[t][0])) / F.lit(scaler.statistics[t][1])
        for t in plan.targets
    })


def predict_physical(
    df: DataFrame, models: dict[str, TargetModels], scaler: Scaler, plan: TrainingPlan
) -> DataFrame:
    """Add ``name__target`` in physical units for all models, in one pass; ``df`` carries the scaled inputs."""
    scored = score_models(df, {f"_hat_{name}__": model for name, model in models.items()})
    hats = {f"{name}__{t}": (f"_hat_{name}__y_{t}", t) for name in models for t in plan.targets}
    scored = scored.withColumns({
        column: F.col(hat) * F.lit(scaler.statistics[t][1]) + F.lit(scaler.statistics[t][0])
        for column, (hat, t) in hats.items()
    }).drop(*[hat for hat, _ in hats.values()])
    if plan.log_drag and plan.drag in plan.targets:
        for name in models:
            scored = unlog_label(scored, f"{name}__{plan.drag}")
    return scored


def prediction_columns(models: Sequence[str], targets: Sequence[str]) -> dict[str, dict[str, str]]:
    return {m: {t: f"{m}__{t}" for t in targets} for m in models}


def train(
    df: DataFrame, store: RunStore, plan: TrainingPlan = TrainingPlan(),
    config: ModelConfig = ModelConfig(), only: Sequence[str] | None = None,
    holdout: DataFrame | None = None,
) -> DataFrame:
    """Split by entity, fit, score and persist; returns the metrics of this run.

    Written to the store: split, scaler, models, history, metrics (other models keep theirs),
    predictions on validation and test rows and the configuration.
    """
    names = select_models(only)
    plan = plan.on(df)
    df = with_features(df, plan)
    if holdout is None:
        split = entity_split(
            df, plan.entity, plan.test_fraction, plan.validation_fraction, plan.seed, strict=True
        )
    else:
        split = fixed_holdout_split(
            df, plan.entity, holdout, plan.validation_fraction, plan.seed, strict=True
        )
    split = store.save_split(split, plan.seed).drop("seed")

    used = [plan.entity, *plan.features, *plan.targets]
    # What identifies a row in the stored predictions; rows that agree in everything share it.
    keyed = df.select(*used, F.xxhash64(*used).alias("row_key"))
    labelled = label_rows(keyed, split, plan.entity)
    # The derived features are read by every fit, so they are kept as a table of the run.
    rows = store.write("training_rows", labelled)
    training = rows.where(F.col("split") == TRAIN)
    scaler = fit_scaler(training, plan)
    store.save_scaler(scaler)

    scaled = scale_labels(scale_inputs(training, scaler, plan), scaler, plan)
    stopping = uniform(F.col(plan.entity), plan.seed, "stopping") < F.lit(STOPPING_SHARE)
    labels = [f"y_{t}" for t in plan.targets]
    evaluated = scale_inputs(rows.where(F.col("split") != TRAIN), scaler, plan)
    models = {}
    for name in names:
        models[name] = fit_models(scaled, _scaled_names(plan), labels, name, config, stopping)
        models[name].save(store.path("models"), df.sparkSession)
    scored = predict_physical(evaluated, models, scaler, plan)
    kept = ["split", "row_key", plan.entity, *[c for c in CONDITION_COLUMNS if c in plan.features]]
    predictions = pair_targets(scored, prediction_columns(names, plan.targets), kept, plan.targets)
    store.write("history", combine([training_history(m, df.sparkSession) for m in models.values()]))
    # Rows are scored once, on their way into the predictions table; metrics read that table.
    stored = store.save_predictions(predictions)
    result = regression_metrics(
        stored.where(F.col("model").isin(*names)), ["model", "split", "target"]
    )
    store.save_config({
        "seed": plan.seed, "log_drag": plan.log_drag, "targets": list(plan.targets),
        "features": list(plan.features), "entity": plan.entity, "reynolds": plan.reynolds,
        "drag": plan.drag, "options": config.as_dict(),
    })
    return store.upsert_metrics(result).where(F.col("model").isin(*names))


def recorded_plan(store: RunStore, default: TrainingPlan = TrainingPlan()) -> TrainingPlan:
    """The plan a run was trained with; folders without a record use ``default``."""
    config = store.config()
    if config["targets"] is None:
        return replace(default, log_drag=config["log_drag"], seed=config["seed"])
    return replace(
        default, features=tuple(config["features"]), targets=tuple(config["targets"]),
        entity=config["entity"], reynolds=config["reynolds"], drag=config["drag"],
        log_drag=config["log_drag"], seed=config["seed"],
    )


def load_models(store: RunStore, names: Sequence[str]) -> dict[str, TargetModels]:
    return {n: TargetModels.load(store.path("models"), n, store.spark) for n in names}


def score_with_saved(
    df: DataFrame, store: RunStore, names: Sequence[str], plan: TrainingPlan | None = None
) -> DataFrame:
    """Physical predictions ``model__target`` of saved models for rows with raw features, in one pass."""
    plan = recorded_plan(store) if plan is None else plan
    scaler = store.scaler()
    scored = predict_physical(scale_inputs(df, scaler, plan), load_models(store, names), scaler, plan)
    return scored.drop(*_scaled_names(plan))


def evaluate(df: DataFrame, store: RunStore, name: str) -> DataFrame:
    """Metrics on exactly the entities recorded as test when the model was trained."""
    plan = recorded_plan(store)
    test = store.split().where(F.col("split") == TEST)
    rows = keep_recorded(with_features(df, plan), test, plan.entity, strict=True)
    scored = score_with_saved(rows, store, [name], plan)
    paired = pair_targets(scored, prediction_columns([name], plan.targets), [], plan.targets)
    return regression_metrics(paired, ["model", "target"])


def evaluate_mean(
    df: DataFrame, store: RunStore, names: Sequence[str], weights: Sequence[float] | None = None
) -> DataFrame:
    """Metrics of the (weighted) mean of saved models on the recorded test entities."""
    plan = recorded_plan(store)
    test = store.split().where(F.col("split") == TEST)
    rows = keep_recorded(with_features(df, plan), test, plan.entity, strict=True)
    scored = score_with_saved(rows, store, names, plan)
    mixed = weighted_mean(
        scored, plan.targets, prediction_columns(names, plan.targets), weights, "mean__"
    )
    paired = pair_targets(mixed, {"mean": {t: f"mean__{t}" for t in plan.targets}}, [], plan.targets)
    return regression_metrics(paired, ["model", "target"])


def stack(
    df: DataFrame, store: RunStore, names: Sequence[str], alpha: float = 1.0
) -> DataFrame:
    """Fit blending weights on the recorded validation entities, score them on the test ones."""
    plan = recorded_plan(store)
    featured = with_features(df, plan)
    split = store.split()
    columns = prediction_columns(names, plan.targets)
    validation = score_with_saved(
        rows_of(featured, split, plan.entity, VALIDATION), store, names, plan
    )
    weights = fit_stacking(validation, {t: t for t in plan.targets}, columns, alpha)
    store.save_weights(weights)
    test = score_with_saved(rows_of(featured, split, plan.entity, TEST), store, names, plan)
    blended = blend(test, weights_as_dict(weights), columns, "stack__")
    paired = pair_targets(
        blended, {"stack": {t: f"stack__{t}" for t in plan.targets}}, [], plan.targets
    )
    return regression_metrics(paired, ["model", "target"])


# -- search -------------------------------------------------------------------------------------

# Candidate settings of the published search (fixed values).
FOREST_CANDIDATES = [
    {"forest_trees": 250, "forest_min_leaf": 25, "forest_leaves": 5000, "forest_features": 0.7},
    {"forest_trees": 250, "forest_min_leaf": 10, "forest_leaves": 8000, "forest_features": 0.7},
    {"forest_trees": 400, "forest_min_leaf": 15, "forest_leaves": 8000, "forest_features": 0.8},
    {"forest_trees": 250, "forest_min_leaf": 5, "forest_leaves": 12000, "forest_features": 0.8},
]
BOOSTING_CANDIDATES = [
    {"boosting_rate": 0.08, "boosting_leaves": 31, "boosting_rounds": 200},
    {"boosting_rate": 0.10, "boosting_leaves": 63, "boosting_rounds": 300},
    {"boosting_rate": 0.05, "boosting_leaves": 63, "boosting_rounds": 400},
    {"boosting_rate": 0.10, "boosting_leaves": 127, "boosting_rounds": 250},
]
CANDIDATES = {"random_forest": FOREST_CANDIDATES, "boosting": BOOSTING_CANDIDATES}


def search(
    df: DataFrame, plan: TrainingPlan = TrainingPlan(), n_entities: int = 12_000,
    candidates: dict[str, list[dict]] | None = None, base: ModelConfig = ModelConfig(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit every candidate on a sample of entities and score it on held-out ones.

    Returns (metrics of each candidate and target, score of each candidate, best candidate of each model). All candidates of
    a model are fitted by the same scans, and all candidates are scored in one pass. What they predict
    is a table of its own, which the three results read.
    """
    candidates = CANDIDATES if candidates is None else candidates
    plan, spark = plan.on(df), df.sparkSession
    sampled = sample_entities(with_features(df, plan), plan.entity, n_entities, plan.seed)
    # Drawing the sample reads the whole table; the split and its labels read what was drawn.
    used = stored(sampled.select(plan.entity, *plan.features, *plan.targets))
    split = entity_split(used, plan.entity, plan.test_fraction, plan.validation_fraction, plan.seed)
    rows = stored(label_rows(used, split, plan.entity))
    training = rows.where(F.col("split") == TRAIN)
    scaler = fit_scaler(training, plan)
    scaled = scale_labels(scale_inputs(training, scaler, plan), scaler, plan)
    validation = scale_inputs(rows.where(F.col("split") == VALIDATION), scaler, plan)
    stopping = uniform(F.col(plan.entity), plan.seed, "stopping") < F.lit(STOPPING_SHARE)
    models, settings = {}, []
    for name in select_models(list(candidates)):
        fitted = fit_candidates(
            scaled, _scaled_names(plan), [f"y_{t}" for t in plan.targets], name,
            [replace(base, **s) for s in candidates[name]], stopping,
        )
        for i, model in enumerate(fitted):
            models[f"{name}#{i}"] = model
            settings.append((f"{name}#{i}", name, i, json.dumps(candidates[name][i], sort_keys=True)))
    scored = predict_physical(validation, models, scaler, plan)
    paired = stored(pair_targets(scored, prediction_columns(list(models), plan.targets), [], plan.targets))
    known = F.broadcast(spark.createDataFrame(settings, "id string, model string, candidate int, settings string"))
    named = paired.withColumnRenamed("model", "id")
    metrics = regression_metrics(named, ["id", "target"]).join(known, "id").drop("id", "settings")
    scores = relative_score(named, ["id"]).join(known, "id").select("model", "candidate", "settings", "score")
    return metrics, scores, best_candidates(scores, ["model"], "candidate")
