import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from curveloom.operators.models import ModelConfig
from curveloom.operators.synth import sentinel_rows
from curveloom.plans import assembly, dataset, prediction, training
from curveloom.sources import tables
from curveloom.sources.store import RunStore, merge_by_key
from curveloom.streaming.incremental import process_new_files, processed_rows

LIGHT = ModelConfig(forest_trees=5, forest_leaves=12, boosting_rounds=5, boosting_leaves=8)


@pytest.fixture(scope="module")
def table(spark):
    """Twelve shapes at nine angles and two Reynolds numbers with smooth outputs."""
    rng = np.random.default_rng(0)
    rows = []
    for e in range(12):
        upper, lower = rng.uniform(0.1, 0.3, 8).tolist(), rng.uniform(-0.3, -0.1, 8).tolist()
        for alpha in np.linspace(-4, 12, 9):
            for re in (1e5, 1e6):
                cl = 0.1 * alpha + upper[0]
                rows.append((f"e{e}", upper, lower, 0.01, 0.002, float(alpha), re, 0.0, 9.0, 1.0, 1.0,
                             float(cl), float(0.01 + 0.002 * cl**2 + 100 / re), float(-0.05 - 0.01 * cl)))
    return spark.createDataFrame(
        rows,
        "entity_id string, upper array<double>, lower array<double>, le double, te double, alpha double, Re double,"
        " mach double, n_crit double, xtr_upper double, xtr_lower double, CL double, CD double, CM double",
    )


@pytest.fixture(scope="module")
def trained(spark, table, tmp_path_factory):
    store = RunStore(spark, str(tmp_path_factory.mktemp("run")))
    plan = training.TrainingPlan(targets=("CL", "CD", "CM"), log_drag=True)
    first = training.train(table, store, plan, LIGHT, ["ridge", "random_forest"])
    return store, plan, first


def test_training_leaves_its_artefacts(trained, spark):
    store, plan, metrics = trained
    assert metrics.count() == 2 * 2 * 3
    for name in ("split", "scaler", "history", "metrics", "predictions", "training_config"):
        assert store.has(name)
    assert store.split().where("seed = 42").count() == 12
    assert training.recorded_plan(store) == plan
    split = {r["entity_id"]: r["split"] for r in store.split().collect()}
    tested = {r["entity_id"] for r in store.read("predictions").where("split = 'test'").select("entity_id").distinct().collect()}
    assert tested == {e for e, s in split.items() if s == "test"}
    assert store.read("predictions").where("split = 'train'").isEmpty()


def test_other_models_keep_their_metrics(trained, table):
    store, plan, _ = trained
    training.train(table, store, plan, LIGHT, ["boosting"])
    assert {r["model"] for r in store.read("metrics").collect()} == {"ridge", "random_forest", "boosting"}


def test_evaluation_repeats_the_test_metrics(trained, table):
    store, _, metrics = trained
    recorded = {r["target"]: r["mae"] for r in metrics.where("model = 'ridge' and split = 'test'").collect()}
    again = {r["target"]: r["mae"] for r in training.evaluate(table, store, "ridge").collect()}
    assert again == pytest.approx(recorded)
    with pytest.raises(ValueError, match="recorded ids"):
        training.evaluate(table.withColumn("entity_id", F.lit("other")), store, "ridge")


def test_stacking_and_prediction(trained, table, spark):
    store, _, _ = trained
    stacked = training.stack(table, store, ["ridge", "random_forest"])
    assert stacked.count() == 3
    weights = store.weights()
    assert set(weights) == {"CL", "CD", "CM"}
    assert all(w >= 0 for by in weights.values() for m, w in by.items() if m != "intercept")
    mean = training.evaluate_mean(table, store, ["ridge", "random_forest"], [2.0, 1.0])
    assert mean.count() == 3

    shape = table.where("entity_id = 'e3'").select("entity_id", "upper", "lower", "le", "te").limit(1)
    queries = prediction.query_rows(shape, {"alpha": [-30.0, 0.0, 4.0], "Re": 1e6})
    features = prediction.feature_rows(queries, training.TrainingPlan(targets=()))
    out = prediction.predict_table(features, store, ["entity_id"], per_model=True).orderBy("alpha").collect()
    assert [r["alpha"] for r in out] == [-30.0, 0.0, 4.0]
    assert [r["outside"] for r in out] == [["alpha"], [], []]
    for r in out:
        assert (r["n_crit"], r["xtr_upper"], r["mach"]) == (9.0, 1.0, 0.0)
        for t in ("CL", "CD", "CM"):
            expected = weights[t]["intercept"] + sum(weights[t][m] * r[f"{m}__{t}"] for m in ("ridge", "random_forest"))
            assert r[t] == pytest.approx(expected)
        assert r["L_over_D"] == pytest.approx(r["CL"] / r["CD"])


def test_conditions_must_fit_and_be_positive(table):
    shape = table.select("entity_id", "upper", "lower", "le", "te").limit(1)
    with pytest.raises(Exception, match="different lengths"):
        prediction.query_rows(shape, {"alpha": [0.0, 1.0], "Re": [1e5, 2e5, 3e5]}).collect()
    with pytest.raises(Exception, match="zero or below"):
        prediction.query_rows(shape, {"alpha": 0.0, "Re": 0.0}).collect()


def test_fixed_holdout_and_errors(spark, table, tmp_path):
    store = RunStore(spark, str(tmp_path))
    plan = training.TrainingPlan(features=("alpha", "Re"), targets=("CL",), log_drag=False)
    holdout = spark.createDataFrame([("e1",), ("e5",)], "entity_id string")
    training.train(table, store, plan, LIGHT, ["ridge"], holdout)
    test = {r["entity_id"] for r in store.split().where("split = 'test'").collect()}
    assert test == {"e1", "e5"}
    with pytest.raises(ValueError, match="nope"):
        training.train(table, store, plan, LIGHT, ["nope"])
    with pytest.raises(ValueError, match="lacks these target"):
        training.train(table.drop("CL"), store, plan, LIGHT, ["ridge"])


def test_profile_positions_are_targets(spark, table, tmp_path):
    names = [f"{s}_bl_{q}" for s in ("upper", "lower") for q in ("theta", "H", "ue_vinf")]
    rows = table.withColumns({n: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("CL") * i) for n in names})
    every = training.all_targets(rows)
    assert len(every) == 3 + 6 * 32 and every[:3] == ("CL", "CD", "CM") and "lower_bl_ue_vinf_31" in every
    assert training.all_targets(training.flatten_profiles(rows, every).drop(*names)) == every
    plan = training.TrainingPlan(features=("alpha", "Re"), targets=("CL", "upper_bl_theta_1", "lower_bl_H_2", "upper_bl_H_31"))
    scores = training.train(rows, RunStore(spark, str(tmp_path)), plan, LIGHT, ["ridge"]).where("split = 'test'").collect()
    assert {r["target"] for r in scores} == set(plan.targets)
    r2 = {r["target"]: r["r2"] for r in scores}
    assert r2["upper_bl_H_31"] == pytest.approx(r2["CL"])


def test_without_targets_everything_is_one(spark, table, tmp_path):
    names = [f"{s}_bl_{q}" for s in ("upper", "lower") for q in ("theta", "H", "ue_vinf")]
    rows = table.withColumns({n: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("CL") * i) for n in names})
    store = RunStore(spark, str(tmp_path))
    scores = training.train(rows, store, training.TrainingPlan(features=("alpha", "Re")), LIGHT, ["ridge", "random_forest"])
    assert scores.where("split = 'test'").count() == 2 * 195
    assert len(training.recorded_plan(store).targets) == 195
    assert training.evaluate(rows, store, "random_forest").count() == 195


def test_search_scores_every_candidate(table):
    grid = {"random_forest": [{"forest_trees": 2, "forest_leaves": 2}, {"forest_trees": 8, "forest_leaves": 40}],
            "boosting": [{"boosting_rounds": 2, "boosting_leaves": 4}]}
    plan = training.TrainingPlan(features=("alpha", "Re", "upper_0"), targets=("CL", "CD", "CM"))
    metrics, scores, best = training.search(table, plan, 10, grid, LIGHT)
    assert scores.count() == 3
    assert {r["model"]: r["candidate"] for r in best.collect()} == {"random_forest": 1, "boosting": 0}
    assert {(r["model"], r["candidate"], r["target"]) for r in metrics.collect()} == {
        (m, c, t) for m, c in (("random_forest", 0), ("random_forest", 1), ("boosting", 0)) for t in ("CL", "CD", "CM")}


def test_search_splits_and_labels_the_stored_sample(table, monkeypatch):
    read = []
    for name in ("entity_split", "label_rows"):
        monkeypatch.setattr(training, name, lambda df, *a, f=getattr(training, name), **k: read.append(
            (df.count(), "Join" in df._jdf.queryExecution().optimizedPlan().toString(), len(df.inputFiles()))) or f(df, *a, **k))
    plan = training.TrainingPlan(features=("alpha", "Re"), targets=("CL",))
    metrics, _, _ = training.search(table, plan, 6, {"ridge": [{"ridge_alpha": 1.0}]}, LIGHT)
    assert metrics.count() == 1
    assert len(read) == 2 and len({n for n, _, _ in read}) == 1 and 0 < read[0][0] < table.count()
    # Neither draws the sample again from the whole table.
    assert all(files and not joined for _, joined, files in read)


# -- assembly -----------------------------------------------------------------------------------


@pytest.fixture
def solved(spark):
    """Three cases at two conditions; one condition is not returned, one curve cannot be split."""
    cases, returned, samples = [], [], []
    x = [1, 0.8, 0.6, 0.4, 0.2, 0.0, 0.2, 0.4, 0.6, 0.8, 1]
    for c in ("TRAIN_000000", "TRAIN_000001", "TRAIN_000002"):
        for k, alpha in enumerate((0.0, 5.0)):
            cases.append((c, [0.2] * 8, [-0.1] * 8, 0.0, 0.0, alpha, 1e5, 0.0, 9.0, 1.0, 1.0))
            if c.endswith("1") and k:
                continue
            returned.append((c, k + 1, alpha + 0.0002, 0.5, 0.01, -0.02, 0.3, 0.9))
            xs = sorted(x) if c.endswith("2") and k else x
            samples += [(c, alpha + 0.0002, i + 1, float(v), 0.1 * v, 2.0 + v, 1.0 - v) for i, v in enumerate(xs)]
    return (
        spark.createDataFrame(cases, "entity_id string, upper array<double>, lower array<double>, le double, te double,"
                              " alpha double, Re double, mach double, n_crit double, xtr_upper double, xtr_lower double"),
        spark.createDataFrame(returned, "entity_id string, ord int, alpha double, CL double, CD double, CM double, Top_Xtr double, Bot_Xtr double"),
        spark.createDataFrame(samples, "entity_id string, alpha double, ord int, x double, theta double, H double, ue_vinf double"),
    )


def test_assembled_rows_and_failures(solved):
    done = assembly.assemble_training_rows(*solved)
    rows = {(r["entity_id"], r["alpha"]): r for r in done.rows.collect()}
    assert len(rows) == 4
    for r in rows.values():
        assert r["confidence"] == 1.0 and r["CL"] == 0.5
        np.testing.assert_allclose(r["upper_bl_theta"], [0.1 * (i + 0.5) / 32 for i in range(32)], atol=1e-12)
        np.testing.assert_allclose(r["lower_bl_H"], [2 + (i + 0.5) / 32 for i in range(32)], atol=1e-12)
    failures = {(r["entity_id"], r["alpha"]): r["reason"] for r in done.failures.collect()}
    assert failures == {
        ("TRAIN_000001", 5.0): "condition 5.000: not returned",
        ("TRAIN_000002", 5.0): "the curve does not turn into two sides",
    }


def test_build_resume_and_provenance(solved, spark, tmp_path):
    cases, returned, samples = solved
    folder = str(tmp_path)
    first = cases.where("entity_id = 'TRAIN_000000'")
    assembly.build_dataset(spark, folder, first, returned, samples, n_buckets=4)
    record = assembly.build_dataset(spark, folder, cases, returned, samples, resume=True, n_buckets=4).first()
    assert (record["n_rows"], record["n_entities"], record["n_sentinel_rows"], record["n_failed_cases"]) == (4, 3, 111, 2)
    assert json.loads(record["settings"])["seed"] == 42
    data = tables.read_parquet(spark, f"{folder}/training_data", tables.TRAINING_SCHEMA)
    assert data.count() == 115
    assert data.where("entity_id = 'TRAIN_000000'").count() == 2


def test_dataset_of_polars_and_outlines(spark, tmp_path):
    from curveloom.plans.dataset import load_dataset

    outline = "\n".join(f"{x} {y}" for x, y in [
        (1, 0), (0.7, 0.05), (0.4, 0.08), (0.1, 0.05), (0, 0), (0.1, -0.03), (0.4, -0.04), (0.7, -0.02), (1, 0)])
    folder = tmp_path / "shapes"
    folder.mkdir()
    for name in ("A1", "b2", "c3"):
        (folder / f"{name}.dat").write_text(f"{name}\n{outline}\n")
    rows = [(e, a, 1e5, 0.0, 0.5, 0.01, -0.1) for e in ("A1", "b2", "c3") for a in (0.0, 2.0)]
    polar = spark.createDataFrame(rows, tables.POLAR_SCHEMA)
    tables.write_table(polar, f"{tmp_path}/polar", "csv")
    data = load_dataset(spark, f"{tmp_path}/polar", str(folder), n_points=20)
    assert data.outlines.count() == 3 and data.rejects.count() == 0
    assert data.split().groupBy("split").count().count() == 3
    extra = polar.unionByName(spark.createDataFrame([("zz", 0.0, 1e5, 0.0, 0.5, 0.01, -0.1)], tables.POLAR_SCHEMA))
    tables.write_table(extra, f"{tmp_path}/extra", "csv")
    with pytest.raises(ValueError, match="zz"):
        load_dataset(spark, f"{tmp_path}/extra", str(folder))
    bad = polar.withColumn("cd", F.lit(-0.5))
    tables.write_table(bad, f"{tmp_path}/bad", "csv")
    with pytest.raises(ValueError, match="drag_negative"):
        load_dataset(spark, f"{tmp_path}/bad", str(folder))


def test_one_file_of_an_entity_is_read(spark):
    texts = spark.createDataFrame([
        ("/s/A.txt", "second"), ("/s/a.DAT", "first"), ("/s/b", "plain"), ("/s/b.txt", "text"), ("/s/c.d", "odd"),
        ("/s/c.d.dat", "data"), ("/s/x.dat", "none")], "path string, text string")
    wanted = spark.createDataFrame([("a",), ("B",), ("c.d",), ("a",), ("zz",)], "entity_id string")
    got = dataset.coordinate_texts(wanted, texts).collect()
    assert sorted(map(tuple, got)) == [("B", "text"), ("a", "first"), ("c.d", "data")]


def test_last_curve_of_a_rounded_condition_is_used(solved, spark):
    cases, returned, samples = solved
    first = samples.where("alpha < 1").withColumns({"alpha": F.col("alpha") + 0.0001, "theta": F.col("theta") * 3})
    done = assembly.assemble_training_rows(cases, returned, samples.unionByName(first))
    rows = {(r["entity_id"], r["alpha"]): r for r in done.rows.collect()}
    np.testing.assert_allclose(rows["TRAIN_000000", 0.0]["upper_bl_theta"], [0.3 * (i + 0.5) / 32 for i in range(32)], atol=1e-12)
    np.testing.assert_allclose(rows["TRAIN_000000", 5.0]["upper_bl_theta"], [0.1 * (i + 0.5) / 32 for i in range(32)], atol=1e-12)


def test_first_run_may_resume_and_an_empty_build_shows_failures(solved, spark, tmp_path):
    cases, returned, samples = solved
    record = assembly.build_dataset(spark, f"{tmp_path}/a", cases, returned, samples, resume=True, n_buckets=4, catalog_size=3).first()
    settings = json.loads(record["settings"])
    assert (settings["requested_cases"], settings["catalog_size"], settings["vector_size"]) == (3, 3, 222)
    by_case = {r["entity_id"]: r for r in spark.read.parquet(f"{tmp_path}/a/failures_by_case").collect()}
    assert by_case["TRAIN_000001"]["n_failures"] == 1
    with pytest.raises(RuntimeError, match="TRAIN_000000.*not returned"):
        assembly.build_dataset(spark, f"{tmp_path}/b", cases, returned.where("false"), samples, n_buckets=4)


def test_table_formats_round_trip(spark, tmp_path):
    polar = spark.createDataFrame([("a", 1.0, 1e5, 0.0, 0.5, 0.01, -0.1)], tables.POLAR_SCHEMA)
    tables.write_table(polar, f"{tmp_path}/csv", "csv")
    assert tables.read_csv(spark, f"{tmp_path}/csv", tables.POLAR_SCHEMA).collect() == polar.collect()
    tables.write_shards(polar, f"{tmp_path}/shards", "entity_id", 4, files_per_bucket=2)
    assert tables.read_shards(spark, f"{tmp_path}/shards").collect() == polar.collect()
    with pytest.raises(ValueError):
        tables.write_table(polar, f"{tmp_path}/x", "xml")
    assert sentinel_rows(spark).select("entity_id").distinct().count() == 1


def test_merge_by_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, merge_by_key(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_new_files_are_processed_once(spark, tmp_path):
    source, target, progress = (f"{tmp_path}/{n}" for n in ("source", "target", "progress"))
    schema = "entity_id string, v int"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        from pyspark.sql.types import StructType
        process_new_files(
            spark, source, StructType.fromDDL(schema), lambda b: b.withColumn("v", F.col("v") * 10),
            target, progress, "entity_id", 4,
        )
        return sorted(map(tuple, processed_rows(spark, target).select("entity_id", "v").collect()))

    add([("a", 1), ("b", 2)])
    assert run() == [("a", 10), ("b", 20)]
    add([("c", 3)])
    assert run() == [("a", 10), ("b", 20), ("c", 30)]
    assert run() == [("a", 10), ("b", 20), ("c", 30)]


def test_predictions_are_written_without_sorting(spark, tmp_path):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0")
    rows = spark.range(50).selectExpr("id", "if(id % 2 = 0, 'a', 'b') model", "id / 7 predicted")
    store = RunStore(spark, str(tmp_path))
    saved = store.save_predictions(rows)
    assert sorted(map(tuple, saved.select("id", "model", "predicted").collect())) == sorted(map(tuple, rows.collect()))
    assert all(f.endswith(".zstd.parquet") for f in saved.inputFiles()) and len(saved.inputFiles()) >= 2
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
