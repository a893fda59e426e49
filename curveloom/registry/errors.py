"""Registered queries: regression error reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from curveloom.functions.scalars import inclusive_sweep
from curveloom.operators import metrics
from curveloom.operators.curves import polar_table
from curveloom.operators.matching import sweep
from curveloom.operators.quality import join_intervals, regime_label, REGIMES
from curveloom.registry.book import Book, r6, rounded
from curveloom.registry.views import MODELS, OBS, REGIME, obs, paired_sql, spread_obs, table

book = Book()

E = "abs(actual - predicted)"
FLOOR = "CASE target WHEN 'cl' THEN 0.05e0 WHEN 'cd' THEN 0.005e0 WHEN 'cm' THEN 0.01e0 ELSE 1.0e0 END"
REL = f"({E} / greatest(abs(actual), {FLOOR}))"
R2 = """CASE WHEN var_pop(actual) * count(actual) > 0
  THEN 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(actual))
  WHEN sum((actual - predicted) * (actual - predicted)) = 0 THEN 1 ELSE 0 END"""


def percentage_sql(by: str, source: str) -> str:
    return f"""
SELECT {by}, target,
  {r6(f"coalesce(avg({E}), 0)", "mae")},
  CASE WHEN target <> 'ld' THEN {r6(f"sqrt(avg({E} * {E}))")} END AS rmse,
  {r6(f"coalesce(avg({REL}) * 100, 0)", "mape_percent")},
  {r6(f"coalesce(median({REL}) * 100, 0)", "median_ape_percent")},
  CASE WHEN target <> 'ld' THEN
    {r6(f"coalesce(avg(CASE WHEN abs(actual) >= 2 * {FLOOR} THEN {REL} END) * 100, 0)")} END
    AS mape_percent_defined,
  {r6(f"coalesce(quantile_cont({E}, 0.95), 0)", "p95_abs")},
  {r6(f"coalesce(max({E}), 0)", "max_abs")},
  count({E}) AS n, count(*) - count({E}) AS n_excluded,
  CASE WHEN target = 'cd' THEN {r6(f"avg({E}) * 1e4")} END AS mae_drag_counts,
  CASE WHEN target = 'cd' THEN {r6(f"quantile_cont({E}, 0.95) * 1e4")} END AS p95_drag_counts,
  CASE WHEN target = 'cd' THEN count(*) FILTER (WHERE predicted < 0) END AS n_negative_predictions
FROM {source} GROUP BY {by}, target"""


@book.add("regime_percentage_error", f"""
WITH {paired_sql("alpha, reynolds", ratio=True)},
labelled AS (SELECT *, {REGIME} AS regime FROM paired)
{percentage_sql("model, regime", "(SELECT * FROM labelled WHERE regime IS NOT NULL)")}""")
def regime_percentage_error(spark, folder):
    return _regime_report(spark, folder, metrics.LARGEST_BUFFERED_GROUP)


def _regime_report(spark, folder, largest_buffered_group):
    rows = spread_obs(spark, folder).withColumn("regime", regime_label(F.col("alpha"))).where(
        F.col("regime").isNotNull()
    )
    return rounded(metrics.percentage_report(rows, MODELS, ["regime"], True, largest_buffered_group))


@book.add("regime_percentage_error_multipass", f"""
WITH {paired_sql("alpha, reynolds", ratio=True)},
labelled AS (SELECT *, {REGIME} AS regime FROM paired)
{percentage_sql("model, regime", "(SELECT * FROM labelled WHERE regime IS NOT NULL)")}""")
def regime_percentage_error_multipass(spark, folder):
    """The same report by the plan for groups that do not fit one aggregation buffer."""
    return _regime_report(spark, folder, 0)


@book.add("regime_reynolds_slices", f"""
WITH {paired_sql("alpha, reynolds", ratio=True)},
sliced AS (
  SELECT 'regime' AS dimension, {REGIME} AS value, model, target, actual, predicted FROM paired
  WHERE {REGIME} IS NOT NULL
  UNION ALL
  SELECT 'reynolds', 're_' || CAST(CAST(trunc(reynolds) AS BIGINT) AS VARCHAR),
    model, target, actual, predicted FROM paired)
{percentage_sql("model, dimension, value", "sliced")}""")
def regime_reynolds_slices(spark, folder):
    sliced = metrics.slice_rows(spread_obs(spark, folder))
    return rounded(metrics.percentage_report(sliced, MODELS, ["dimension", "value"], True))


@book.add("regression_metrics", f"""
WITH {paired_sql("")}
SELECT model, target, {r6(f"avg({E})", "mae")}, {r6(f"sqrt(avg({E} * {E}))", "rmse")},
  {r6(R2, "r2")} FROM paired GROUP BY model, target""")
def regression_metrics(spark, folder):
    paired = metrics.pair_targets(obs(spark, folder), MODELS, [])
    return rounded(metrics.regression_metrics(paired, ["model", "target"]))


@book.add("pooled_r2", f"""
WITH {paired_sql("")}, sums AS (
  SELECT model, target, sum((actual - predicted) * (actual - predicted)) AS sse,
    var_pop(actual) * count(actual) AS sst FROM paired GROUP BY model, target)
SELECT model, {r6("1 - sum(sse) / sum(sst)", "pooled_r2")} FROM sums GROUP BY model""")
def pooled_r2(spark, folder):
    paired = metrics.pair_targets(obs(spark, folder), MODELS, [])
    return rounded(metrics.pooled_r2(paired, ["model"]))


def error_by_sql(key: str, shown: str) -> str:
    return f"""WITH {OBS} SELECT {shown} AS {key},
  {r6("avg(abs(cl - cl_a))", "cl_abs_error")}, {r6("avg(abs(cd - cd_a))", "cd_abs_error")},
  {r6("avg(abs(cm - cm_a))", "cm_abs_error")} FROM obs GROUP BY {key}"""


@book.add("error_by_condition", error_by_sql("alpha", r6("alpha")))
def error_by_condition(spark, folder):
    return rounded(metrics.mean_abs_error_by(obs(spark, folder), ["alpha"], MODELS["a"]))


@book.add("error_by_reynolds", error_by_sql("reynolds", r6("reynolds")))
def error_by_reynolds(spark, folder):
    return rounded(metrics.mean_abs_error_by(obs(spark, folder), ["reynolds"], MODELS["a"]))


@book.add("error_by_entity", error_by_sql("entity_id", "entity_id"))
def error_by_entity(spark, folder):
    return rounded(metrics.mean_abs_error_by(obs(spark, folder), ["entity_id"], MODELS["a"]))


@book.add("error_by_condition_bucket", f"""WITH {OBS}, b AS (
  SELECT *, floor(alpha / 0.5e0) * 0.5e0 AS bucket FROM obs)
SELECT {r6("bucket", "bucket")},
  {r6("avg(abs(cl - cl_a))", "cl_abs_error")}, {r6("avg(abs(cd - cd_a))", "cd_abs_error")},
  {r6("avg(abs(cm - cm_a))", "cm_abs_error")} FROM b GROUP BY bucket""")
def error_by_condition_bucket(spark, folder):
    rows = obs(spark, folder).withColumn("bucket", metrics.bucketed(F.col("alpha"), 0.5))
    return rounded(metrics.mean_abs_error_by(rows, ["bucket"], MODELS["a"]))


@book.add("relative_error_by_condition", f"""
WITH {paired_sql("alpha")}
SELECT model, target, {r6("alpha", "alpha")}, {r6(f"avg({REL}) * 100", "mape_percent")}
FROM paired GROUP BY model, target, alpha""")
def relative_error_by_condition(spark, folder):
    paired = metrics.pair_targets(spread_obs(spark, folder), MODELS, ["alpha"])
    return rounded(metrics.relative_error_by(paired, ["model", "target", "alpha"]))


def _drag_sql() -> str:
    parts = []
    for m in ("a", "b"):
        ok = f"cd <> 0 AND cd_{m} <> 0"
        base = (
            f"'{m}' AS model, cd AS actual, cd_{m} AS predicted,"
            f" CASE WHEN {ok} THEN abs(cl / cd - cl_{m} / cd_{m}) END AS re,"
            f" CASE WHEN {ok} THEN greatest(abs(cl / cd), 1e-6) END AS rs"
        )
        parts += [
            f"SELECT 'overall' AS dimension, 'all' AS value, {base} FROM obs",
            f"SELECT 'regime' AS dimension, {REGIME} AS value, {base} FROM obs WHERE {REGIME} IS NOT NULL",
            f"SELECT 'reynolds' AS dimension, 're_' || CAST(CAST(trunc(reynolds) AS BIGINT) AS VARCHAR)"
            f" AS value, {base} FROM obs",
        ]
    return f"""WITH {OBS}, s AS ({' UNION ALL '.join(parts)})
SELECT model, dimension, value, {r6(f"avg({E})", "mae")}, {r6(f"sqrt(avg({E} * {E}))", "rmse")},
  {r6(R2, "r2")}, {r6("avg(re)", "ld_mae")}, {r6("avg(re / rs)", "ld_relative_mae")},
  count(*) - count(re) AS n_ld_excluded FROM s GROUP BY model, dimension, value"""


@book.add("drag_summary", _drag_sql())
def drag_summary(spark, folder):
    return rounded(metrics.drag_summary(spread_obs(spark, folder), MODELS))


def drag_error_sql(by: str) -> str:
    return f"""WITH {paired_sql(by, targets=("cd",), ratio=True, guarded=False)}
SELECT model, {r6(by, by)}, {r6(f"avg(CASE WHEN target = 'cd' THEN {E} END)", "cd_abs_error")},
  {r6(f"avg(CASE WHEN target = 'ld' THEN {E} END)", "ld_abs_error")}
FROM paired GROUP BY model, {by}"""


@book.add("drag_error_by_condition", drag_error_sql("alpha"))
def drag_error_by_condition(spark, folder):
    return rounded(metrics.drag_error_by(obs(spark, folder), "alpha", MODELS))


@book.add("drag_error_by_reynolds", drag_error_sql("reynolds"))
def drag_error_by_reynolds(spark, folder):
    return rounded(metrics.drag_error_by(obs(spark, folder), "reynolds", MODELS))


@book.add("relative_dataset_error", f"""
WITH {paired_sql("")}
SELECT model, target,
  {r6(f"avg({E}) / greatest(avg(abs(actual)), 1e-8)", "relative_mae")},
  {r6(f"median({REL}) * 100", "median_ape_percent")} FROM paired GROUP BY model, target""")
def relative_dataset_error(spark, folder):
    paired = metrics.pair_targets(spread_obs(spark, folder), MODELS, [])
    return rounded(metrics.relative_dataset_error(paired, ["model", "target"]))


@book.add("parity_limits", f"""
WITH {paired_sql("")}
SELECT model, target, {r6("least(min(actual), min(predicted))", "low")},
  {r6("greatest(max(actual), max(predicted))", "high")} FROM paired GROUP BY model, target""")
def parity_limits(spark, folder):
    paired = metrics.pair_targets(obs(spark, folder), MODELS, [])
    return rounded(metrics.parity_limits(paired, ["model", "target"]))


@book.add("parity_upper_limit", f"""
WITH {paired_sql("")}
SELECT model, target, {r6("quantile_cont(actual, 0.995) * 1.05e0", "upper_limit")}
FROM paired GROUP BY model, target""")
def parity_upper_limit(spark, folder):
    paired = metrics.pair_targets(spread_obs(spark, folder), MODELS, [])
    return rounded(metrics.upper_limit(paired, ["model", "target"]))


@book.add("interval_join_counts", f"""
WITH {OBS}, bounds(low, high, label) AS (VALUES
  (-2.0e0, 0.0e0, 'negative lift'), (0.0e0, 4.0e0, 'attached flow'),
  (4.0e0, 8.0e0, 'drag rise'), (8.0e0, 11.0e0, 'near stall'))
SELECT label, count(*) AS n, {r6("avg(cl)", "mean_cl")}
FROM obs JOIN bounds ON alpha >= low AND alpha < high GROUP BY label""")
def interval_join_counts(spark, folder):
    bounds = spark.createDataFrame(REGIMES, "low double, high double, label string")
    joined = join_intervals(obs(spark, folder), "alpha", bounds)
    return rounded(
        joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("cl").alias("mean_cl"))
    )


_WIDE = """bounds AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 50 = 0 THEN CAST('-inf' AS DOUBLE) ELSE c_custkey % 97 * 0.1e0 - 2 END AS low,
    CASE WHEN c_custkey % 50 = 1 THEN CAST('inf' AS DOUBLE) ELSE c_custkey % 97 * 0.1e0 - 2 + c_custkey % 13 * 0.25e0 END AS high
  FROM customer WHERE c_custkey <= 300)"""


@book.add("interval_join_wide", f"""
WITH {OBS}, {_WIDE}, per AS (SELECT alpha, count(*) AS m, sum(cl) AS s FROM obs GROUP BY alpha)
SELECT id, sum(m)::BIGINT AS n, {r6("sum(s) / sum(m)", "mean_cl")} FROM per JOIN bounds ON alpha >= low AND alpha < high GROUP BY id""")
def interval_join_wide(spark, folder):
    """Open-ended, wide and overlapping intervals, some of them empty, each with its rows counted."""
    key, inf = F.col("c_custkey"), F.lit(float("inf"))
    start = key % 97 * F.lit(0.1) - 2
    bounds = table(spark, folder, "customer").where(key <= 300).select(
        key.cast("long").alias("id"), F.when(key % 50 == 0, -inf).otherwise(start).alias("low"),
        F.when(key % 50 == 1, inf).otherwise(start + key % 13 * F.lit(0.25)).alias("high"))
    joined = join_intervals(obs(spark, folder), "alpha", bounds)
    return rounded(joined.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg("cl").alias("mean_cl")))


def _polar_sql() -> str:
    return f"""WITH {OBS} SELECT l_orderkey, entity_id, alpha, cl, cd, cl_a AS pred_cl, cd_a AS pred_cd,
  CASE WHEN cd <> 0 THEN cl / cd END AS ratio, cl_a / greatest(cd_a, 1e-8) AS pred_ratio FROM obs"""


@book.add("polar_table", _polar_sql())
def polar(spark, folder):
    rows = obs(spark, folder)
    table = polar_table(
        rows.withColumn("entity_id", F.struct("l_orderkey", "entity_id")), "entity_id", "alpha",
        {"cl": "cl", "cd": "cd"}, {"cl": "cl_a", "cd": "cd_a"},
    )
    return table.select("entity_id.l_orderkey", "entity_id.entity_id", *table.columns[1:])


@book.add("best_candidate", f"""
WITH {OBS}, grid AS (SELECT unnest(range(0, 11)) AS candidate),
mixed AS (
  SELECT {REGIME} AS regime, candidate, cl, cd, cm,
    (candidate / 10.0e0) * cl_a + (1.0e0 - candidate / 10.0e0) * cl_b AS cl_m,
    (candidate / 10.0e0) * cd_a + (1.0e0 - candidate / 10.0e0) * cd_b AS cd_m,
    (candidate / 10.0e0) * cm_a + (1.0e0 - candidate / 10.0e0) * cm_b AS cm_m
  FROM obs, grid WHERE {REGIME} IS NOT NULL),
scores AS (
  SELECT regime, candidate,
    (avg(abs(cl - cl_m)) / greatest(avg(abs(cl)), 1e-8) + avg(abs(cd - cd_m)) / greatest(avg(abs(cd)), 1e-8)
     + avg(abs(cm - cm_m)) / greatest(avg(abs(cm)), 1e-8)) / 3 AS score
  FROM mixed GROUP BY regime, candidate)
SELECT regime, arg_min(candidate, score) AS candidate, {r6("min(score)", "score")}
FROM scores GROUP BY regime""")
def best_candidate(spark, folder):
    """Score a grid of blending weights per regime and keep the best."""
    weights = F.transform(
        inclusive_sweep(F.lit(0.0), F.lit(10.0), F.lit(1.0)), lambda w: w.cast("long")
    )
    rows = spread_obs(spark, folder).withColumn("regime", regime_label(F.col("alpha"))).where(
        F.col("regime").isNotNull()
    )
    tried = sweep(rows, candidate=weights)
    share = F.col("candidate") / F.lit(10.0)
    mixed = tried.withColumns({
        f"{t}_m": share * F.col(f"{t}_a") + (F.lit(1.0) - share) * F.col(f"{t}_b")
        for t in metrics.TARGETS
    })
    paired = metrics.pair_targets(
        mixed, {"m": {t: f"{t}_m" for t in metrics.TARGETS}}, ["regime", "candidate"]
    )
    scores = metrics.relative_score(paired, ["regime", "candidate"])
    return rounded(metrics.best_candidates(scores, ["regime"], "candidate"))
