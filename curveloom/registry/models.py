"""Registered queries: features, models, blending and synthetic cases."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from curveloom.functions.scalars import guarded_ratio, inclusive_sweep, numbered_id
from curveloom.functions.shape import DESCRIPTOR_COLUMNS, STATIONS
from curveloom.operators import features, stacking
from curveloom.operators.dense import LAYER_SCHEMA, load_layers, score_dense
from curveloom.operators.matching import broadcast_conditions, sweep
from curveloom.operators.models import ModelConfig, fit_models, ridge_coefficients
from curveloom.operators.quality import envelope_flags, fill_conditions
from curveloom.operators.synth import SamplingConfig, explode_conditions, operating_points, sample_shapes
from curveloom.plans.prediction import feature_rows, predict_table as predictions_of, query_rows
from curveloom.plans.training import (
    SHAPE_FEATURES, TrainingPlan, evaluate, evaluate_mean, flatten_shapes, search, stack, train,
)
from curveloom.registry.book import Book, r6, rounded
from curveloom.registry.entities import SPLIT
from curveloom.registry.views import MODELS, OBS, VEC, obs, spread_obs, table, vec, vec18
from curveloom.session import shared_folder
from curveloom.sources.store import RunStore, weights_table
from curveloom.sources.tables import spread_scan

book = Book()
TARGETS = ("cl", "cd", "cm")

# -- features -----------------------------------------------------------------------------------

SCALED = ["alpha", "log_re", "mach", "cl", "cd", "cm"]


def _logged(spark, folder):
    return obs(spark, folder).withColumn("log_re", F.log10("reynolds"))


LOGGED = f"{OBS}, logged AS (SELECT *, log10(reynolds) AS log_re FROM obs)"
STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg({c}) AS mean, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS std FROM logged"
    for c in SCALED
)


@book.add("scaler_stats", f"""WITH {LOGGED}, st AS ({STATS})
SELECT "column", round(mean, 9) + 0.0e0 AS mean, round(std, 9) + 0.0e0 AS std FROM st""")
def scaler_stats(spark, folder):
    return rounded(features.scaler_statistics(_logged(spark, folder), SCALED), 9)


@book.add("scaled_features", f"""WITH {LOGGED}, s AS (SELECT avg(alpha) AS ma, stddev_pop(alpha) AS sa,
  avg(log_re) AS mr, stddev_pop(log_re) AS sr FROM logged)
SELECT l_orderkey, entity_id, round((alpha - ma) / sa, 4) + 0.0e0 AS alpha,
  round((log_re - mr) / sr, 4) + 0.0e0 AS log_re FROM logged, s""")
def scaled_features(spark, folder):
    rows = _logged(spark, folder)
    scaler = features.Scaler.fit(rows, ["alpha", "log_re"])
    scaled = scaler.transform(rows, ["alpha", "log_re"])
    return rounded(scaled.select("l_orderkey", "entity_id", "alpha", "log_re"), 4)


@book.add("log_label_roundtrip", f"""WITH {OBS} SELECT l_orderkey, entity_id,
  {r6("ln(greatest(cd, 1e-6))", "logged")}, {r6("greatest(cd, 1e-6)", "restored")} FROM obs""")
def log_label_roundtrip(spark, folder):
    logged = features.log_label(obs(spark, folder), "cd").withColumn("logged", F.col("cd"))
    restored = features.unlog_label(logged, "cd").withColumnRenamed("cd", "restored")
    return rounded(restored.select("l_orderkey", "entity_id", "logged", "restored"))


@book.add("raw_inputs", f"""
WITH {VEC}, c AS (SELECT unnest([-5.0e0, 0.0e0, 5.0e0]) AS alpha)
SELECT entity_id, alpha, CAST(i - 1 AS INTEGER) AS i, round(list_concat(list_concat(upper, lower),
  [alpha, log10(100000.0e0 * (label + 1)), 0.0e0])[i], 6) + 0.0e0 AS value
FROM vec, c, (SELECT unnest(range(1, 20)) AS i)""")
def raw_inputs(spark, folder):
    swept = sweep(
        vec(spark, folder), alpha=inclusive_sweep(F.lit(-5.0), F.lit(5.0), F.lit(5.0))
    ).withColumn("Re", F.lit(100000.0) * (F.col("label") + 1))
    values = features.raw_inputs(F.concat("upper", "lower"), F.col("alpha"), F.col("Re"), F.lit(0.0))
    return rounded(swept.select("entity_id", "alpha", F.posexplode(values).alias("i", "value")))


@book.add("vector_mean", f"""WITH {VEC}
SELECT CAST(i - 1 AS INTEGER) AS i, {r6("avg(list_concat(list_concat(upper, lower), [le, te])[i])", "mean")}
FROM vec, (SELECT unnest(range(1, 19)) AS i) GROUP BY i""")
def vector_mean(spark, folder):
    return rounded(features.vector_mean(vec18(spark, folder), "vector", 18))


@book.add("vector_covariance", f"""WITH {VEC}, v AS (
  SELECT list_concat(list_concat(upper, lower), [le, te]) AS v FROM vec),
k AS (SELECT unnest(range(1, 19)) AS k)
SELECT CAST(a.k - 1 AS INTEGER) AS i, CAST(b.k - 1 AS INTEGER) AS j, {r6("covar_samp(v[a.k], v[b.k])", "covariance")}
FROM v, k a, k b WHERE a.k <= b.k GROUP BY a.k, b.k""")
def vector_covariance(spark, folder):
    return rounded(features.vector_covariance(vec18(spark, folder), "vector", 18))


def _embeddings(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.transform("embedding", lambda v: v.cast("double")).alias("vector"))


EMBEDDED = "v AS (SELECT list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings)"


@book.add("embedding_mean", f"""WITH {EMBEDDED}
SELECT CAST(i - 1 AS INTEGER) AS i, {r6("avg(v[i])", "mean")} FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY i""")
def embedding_mean(spark, folder):
    """The mean of all 64 elements; ``vector_mean`` is that of the 18 of a shape."""
    return rounded(features.vector_mean(_embeddings(spark, folder), "vector", 64))


@book.add("embedding_covariance", f"""WITH {EMBEDDED}, k AS (SELECT unnest(range(1, 65)) AS k)
SELECT CAST(a.k - 1 AS INTEGER) AS i, CAST(b.k - 1 AS INTEGER) AS j, {r6("covar_samp(v[a.k], v[b.k])", "covariance")}
FROM v, k a, k b WHERE a.k <= b.k GROUP BY a.k, b.k""")
def embedding_covariance(spark, folder):
    """The covariances of all 64 elements; ``vector_covariance`` has those of the 18 of a shape."""
    return rounded(features.vector_covariance(_embeddings(spark, folder), "vector", 64))


COMB = "[" + ", ".join(f"{math.comb(7, i)}.0e0" for i in range(8)) + "]"
BASIS = f"({COMB})[i + 1] * pow(x, i + 0.5e0) * pow(1.0e0 - x, 8 - i)"
NOSE = "le * x * pow(1.0e0 - x, 8.5e0)"


def _line_sql(name: str, grid: str) -> str:
    """Both surfaces of every shape at every station of a grid, as a table."""
    return f"""{name}_grid AS ({grid}),
{name} AS (SELECT entity_id, g.k, g.x,
  sum(upper[i + 1] * {BASIS}) + any_value(le * g.x * pow(1.0e0 - g.x, 8.5e0)) + any_value(te * g.x / 2) AS u,
  sum(lower[i + 1] * {BASIS}) + any_value(le * g.x * pow(1.0e0 - g.x, 8.5e0)) - any_value(te * g.x / 2) AS v
  FROM vec, {name}_grid g, (SELECT unnest(range(0, 8)) AS i) GROUP BY entity_id, g.k, g.x)"""


STATION_LIST = ", ".join(f"{x!r}e0" for x in STATIONS)
DESCRIBED = f"""{VEC},
{_line_sql("even", "SELECT k, k / 100.0e0 AS x FROM (SELECT unnest(range(0, 101)) AS k)")},
{_line_sql("cosine", "SELECT k, 0.5e0 * (1.0e0 - cos(pi() * k / 100.0e0)) AS x FROM (SELECT unnest(range(0, 101)) AS k)")},
{_line_sql("stations", f"SELECT CAST(round(x * 100, 0) AS INTEGER) AS k, x FROM (SELECT unnest([{STATION_LIST}]) AS x)")},
maxima AS (SELECT entity_id, max(u - v) AS thick, max((u + v) / 2) AS camber FROM even GROUP BY entity_id),
steps AS (SELECT entity_id, x - lag(x) OVER w AS dx, u - lag(u) OVER w AS du, v - lag(v) OVER w AS dv FROM cosine
  WINDOW w AS (PARTITION BY entity_id ORDER BY k)),
lengths AS (SELECT entity_id, sum(sqrt(dx * dx + du * du) + sqrt(dx * dx + dv * dv)) AS perimeter
  FROM steps GROUP BY entity_id),
places AS (SELECT entity_id, {", ".join(
    f"max(CASE WHEN k = {round(x * 100)} THEN u - v END) AS t{round(x * 100)}, "
    f"max(CASE WHEN k = {round(x * 100)} THEN (u + v) / 2 END) AS c{round(x * 100)}" for x in STATIONS
)} FROM stations GROUP BY entity_id),
nose AS (SELECT *, upper[1] * upper[1] / 2 AS ru, lower[1] * lower[1] / 2 AS rl FROM vec),
described AS (SELECT n.entity_id, ru + rl > 0 AS round_nose, thick AS geom_max_thickness, camber AS geom_max_camber,
  least(ru, rl) - 0.015e0 * (ru + rl) * ln(1 + exp((least(ru, rl) - greatest(ru, rl)) / (0.015e0 * (ru + rl)))) AS geom_le_radius,
  degrees(atan(upper[8] - te / 2) - atan(lower[8] + te / 2)) AS geom_te_angle,
  list_sum(list_transform(range(0, 8), lambda i: (upper[i + 1] - lower[i + 1]) * ({COMB})[i + 1]
    * gamma(i + 1.5e0) * gamma(9.0e0 - i) / gamma(10.5e0))) + te / 2 AS geom_area,
  perimeter AS geom_perimeter, {", ".join(f"t{round(x * 100)} AS geom_thickness_{round(x * 100)}" for x in STATIONS)},
  {", ".join(f"c{round(x * 100)} AS geom_camber_{round(x * 100)}" for x in STATIONS)}
  FROM nose n JOIN maxima USING (entity_id) JOIN lengths USING (entity_id) JOIN places USING (entity_id))"""
SHOWN = ", ".join(r6(f"CASE WHEN round_nose THEN {c} ELSE 0 END", c) for c in DESCRIPTOR_COLUMNS)


@book.add("shape_descriptors", f"WITH {DESCRIBED} SELECT entity_id, {SHOWN} FROM described")
def shape_descriptors(spark, folder):
    described = features.add_descriptors(vec(spark, folder), "entity_id")
    return rounded(described.select("entity_id", *DESCRIPTOR_COLUMNS))


@book.add("broadcast_back", f"""WITH {DESCRIBED}
SELECT l_orderkey, l_partkey, entity_id, {", ".join(r6(f"CASE WHEN round_nose THEN {c} ELSE 0 END", c) for c in DESCRIPTOR_COLUMNS[:6])}
FROM lineitem JOIN described ON l_suppkey = entity_id""")
def broadcast_back(spark, folder):
    """Descriptors computed once per entity and attached to its many rows."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(
        vec(spark, folder), F.col("l_suppkey") == F.col("entity_id")
    )
    described = features.add_descriptors(rows, "entity_id")
    return rounded(described.select("l_orderkey", "l_partkey", "entity_id", *DESCRIPTOR_COLUMNS[:6]))


# -- models -------------------------------------------------------------------------------------


def _ridge_sql() -> str:
    parts = []
    for t in TARGETS:
        parts.append(f"""SELECT '{t}' AS target, count(*) AS n, avg(alpha) AS m1, avg(log_re) AS m2, avg({t}) AS my,
  var_pop(alpha) * count(*) + 1 AS g11, var_pop(log_re) * count(*) + 1 AS g22, covar_pop(alpha, log_re) * count(*) AS g12,
  covar_pop(alpha, {t}) * count(*) AS c1, covar_pop(log_re, {t}) * count(*) AS c2 FROM logged""")
    return f"""WITH {LOGGED}, g AS ({" UNION ALL ".join(parts)}),
w AS (SELECT *, (c1 * g22 - c2 * g12) / (g11 * g22 - g12 * g12) AS w1,
  (c2 * g11 - c1 * g12) / (g11 * g22 - g12 * g12) AS w2 FROM g)
SELECT target, 'alpha' AS term, {r6("w1", "coefficient")} FROM w
UNION ALL SELECT target, 'log_re', {r6("w2")} FROM w
UNION ALL SELECT target, 'intercept', {r6("my - w1 * m1 - w2 * m2")} FROM w"""


@book.add("ridge_coefficients", _ridge_sql())
def ridge(spark, folder):
    rows = spread_obs(spark, folder).withColumn("log_re", F.log10("reynolds")).select(
        "alpha", "log_re", *TARGETS
    )
    fitted = fit_models(rows, ["alpha", "log_re"], TARGETS, "ridge")
    return rounded(ridge_coefficients(fitted, spark))


# Trees of one split over a feature of few values: SQL finds the same split by least squares.
STUMPS = ModelConfig(
    forest_trees=1, forest_leaves=2, forest_min_leaf=1, forest_features=1.0, forest_bootstrap=False,
    boosting_rounds=1, boosting_leaves=2, boosting_min_leaf=1, boosting_rate=1.0,
)
PLAN = TrainingPlan(
    features=("reynolds",), targets=TARGETS, reynolds="reynolds", drag="cd", log_drag=True,
)


def _labels_sql(extra: str = "") -> str:
    """Rows with their part of the split and the label a model is fitted on."""
    parts = " UNION ALL ".join(
        f"SELECT entity_id, split, reynolds, log10(reynolds) AS x, '{t}' AS target, {t} AS actual, "
        + ("ln(greatest(cd, 1e-6))" if t == "cd" else t) + " AS label FROM obs JOIN split USING (entity_id)"
        for t in TARGETS)
    return f"""WITH {OBS}, {SPLIT}, lab AS ({parts}){extra}"""


def _stump_sql(fitted: str) -> str:
    """The split with the least squared error over rows that meet ``fitted``, and what it predicts."""
    return f""", per AS (SELECT target, reynolds, count(*) AS n, sum(label) AS s FROM lab WHERE {fitted} GROUP BY ALL),
cuts AS (SELECT a.target, a.reynolds AS cut, sum(b.n) FILTER (WHERE b.reynolds <= a.reynolds) AS nl,
    sum(b.s) FILTER (WHERE b.reynolds <= a.reynolds) AS sl, sum(b.n) FILTER (WHERE b.reynolds > a.reynolds) AS nr,
    sum(b.s) FILTER (WHERE b.reynolds > a.reynolds) AS sr
  FROM per a JOIN per b USING (target) GROUP BY a.target, a.reynolds),
best AS (SELECT target, cut, sl / nl AS low, sr / nr AS high FROM cuts WHERE nr > 0
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY sl * sl / nl + sr * sr / nr DESC) = 1),
stump AS (SELECT lab.*, CASE WHEN reynolds <= cut THEN low ELSE high END AS fit FROM lab JOIN best USING (target)),
stumped AS (SELECT *, CASE WHEN target = 'cd' THEN exp(fit) ELSE fit END AS predicted FROM stump)"""


def _joint_stump_sql() -> str:
    """One cut for all targets: the least squared error of their scaled labels over training rows."""
    return """, zs AS (SELECT target, avg(label) AS my, stddev_pop(label) AS sy FROM lab WHERE split = 'train' GROUP BY target),
per AS (SELECT target, reynolds, count(*) AS n, sum((label - my) / sy) AS s FROM lab JOIN zs USING (target)
  WHERE split = 'train' GROUP BY ALL),
cuts AS (SELECT a.target, a.reynolds AS cut, sum(b.n) FILTER (WHERE b.reynolds <= a.reynolds) AS nl,
    sum(b.s) FILTER (WHERE b.reynolds <= a.reynolds) AS sl, sum(b.n) FILTER (WHERE b.reynolds > a.reynolds) AS nr,
    sum(b.s) FILTER (WHERE b.reynolds > a.reynolds) AS sr
  FROM per a JOIN per b USING (target) GROUP BY a.target, a.reynolds),
joint AS (SELECT cut FROM cuts WHERE nr > 0 GROUP BY cut ORDER BY sum(sl * sl / nl + sr * sr / nr) DESC LIMIT 1),
best AS (SELECT target, cut, my + sy * sl / nl AS low, my + sy * sr / nr AS high FROM cuts JOIN joint USING (cut) JOIN zs USING (target)),
stump AS (SELECT lab.*, CASE WHEN reynolds <= cut THEN low ELSE high END AS fit FROM lab JOIN best USING (target)),
stumped AS (SELECT *, CASE WHEN target = 'cd' THEN exp(fit) ELSE fit END AS predicted FROM stump)"""


def _scores_sql(model: str, source: str, by: str) -> str:
    e = "(actual - predicted)"
    sst = "var_pop(actual) * count(actual)"
    return f"""SELECT '{model}' AS model, {by}, {r6(f"avg(abs{e})", "mae")}, {r6(f"sqrt(avg({e} * {e}))", "rmse")},
  {r6(f"CASE WHEN {sst} > 0 THEN 1 - sum({e} * {e}) / ({sst}) WHEN sum({e} * {e}) = 0 THEN 1 ELSE 0 END", "r2")}
FROM {source} GROUP BY {by}"""


_STOPPING = "('0x' || substr(md5('42|' || entity_id || '|stopping|0'), 1, 13))::BIGINT + 0.5e0 < 0.1e0 * 4503599627370496.0e0"
# Ridge on one scaled input: the slope is the sum of products over the rows and the penalty.
_RIDGE = """, scale AS (SELECT target, avg(x) AS mx, stddev_pop(x) AS sx, avg(label) AS my, stddev_pop(label) AS sy,
  count(*) AS n, covar_pop(x, label) AS c FROM lab WHERE split = 'train' GROUP BY target),
line AS (SELECT lab.*, my + sy * (c * n / (sx * sy)) / (n + 1.0e0) * (x - mx) / sx AS fit FROM lab JOIN scale USING (target)),
ridged AS (SELECT *, CASE WHEN target = 'cd' THEN exp(fit) ELSE fit END AS predicted FROM line)"""
# Non-negative weights of two models: both if neither is negative, else the better of one alone.
_STACK = """, both_all AS (SELECT split, target, actual, a.predicted AS p1, b.predicted AS p2 FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, target ORDER BY actual, reynolds) AS r FROM ridged) a JOIN (
    SELECT *, row_number() OVER (PARTITION BY entity_id, target ORDER BY actual, reynolds) AS r FROM stumped) b
    USING (entity_id, target, r, split, actual)),
sums AS (SELECT target, avg(p1) AS m1, avg(p2) AS m2, avg(actual) AS my, covar_pop(p1, p1) * count(*) + 1 AS g11,
  covar_pop(p1, p2) * count(*) AS g12, covar_pop(p2, p2) * count(*) + 1 AS g22, covar_pop(p1, actual) * count(*) AS c1,
  covar_pop(p2, actual) * count(*) AS c2 FROM both_all WHERE split = 'validation' GROUP BY target),
solved AS (SELECT *, (c1 * g22 - c2 * g12) / (g11 * g22 - g12 * g12) AS u1, (c2 * g11 - c1 * g12) / (g11 * g22 - g12 * g12) AS u2 FROM sums),
weights AS (SELECT *, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN greatest(c1, 0) ^ 2 / g11 >= greatest(c2, 0) ^ 2 / g22 THEN greatest(c1, 0) / g11 ELSE 0 END AS w1,
  CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN greatest(c1, 0) ^ 2 / g11 >= greatest(c2, 0) ^ 2 / g22 THEN 0 ELSE greatest(c2, 0) / g22 END AS w2 FROM solved),
stacked AS (SELECT target, actual, my - w1 * m1 - w2 * m2 + w1 * p1 + w2 * p2 AS predicted
  FROM both_all JOIN weights USING (target) WHERE split = 'test')"""


def run_store(spark) -> RunStore:
    root = shared_folder(spark)
    return RunStore(spark, f"{root}/curveloom-{spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid()).first()[0]}")


def _training_rows(spark, folder):
    return obs(spark, folder).select(
        "entity_id", "alpha", "reynolds", F.col("l_suppkey").cast("double").alias("l_suppkey"),
        F.col("l_partkey").cast("double").alias("l_partkey"), *TARGETS,
    )


@book.add("forest_scores", _labels_sql(_joint_stump_sql())
          + _scores_sql("random_forest", "stumped WHERE split <> 'train'", "split, target"))
def forest_scores(spark, folder):
    return rounded(train(_training_rows(spark, folder), run_store(spark), PLAN, STUMPS, ["random_forest"]))


@book.add("boosted_scores", _labels_sql(_stump_sql(f"split = 'train' AND NOT ({_STOPPING})"))
          + _scores_sql("boosting", "stumped WHERE split <> 'train'", "split, target"))
def boosted_scores(spark, folder):
    return rounded(train(_training_rows(spark, folder), run_store(spark), PLAN, STUMPS, ["boosting"]))


@book.add("train_and_stack", _labels_sql(_joint_stump_sql() + _RIDGE + _STACK) + _scores_sql("stack", "stacked", "target"))
def train_and_stack(spark, folder):
    """Ridge and forest trained, then blended on validation entities; metrics on test entities."""
    rows, store = _training_rows(spark, folder), run_store(spark)
    train(rows, store, PLAN, STUMPS, ["ridge", "random_forest"])
    return rounded(stack(rows, store, ["ridge", "random_forest"]))


@book.add("saved_model_scores", _labels_sql(_RIDGE) + _scores_sql("ridge", "ridged WHERE split = 'test'", "target"))
def saved_model_scores(spark, folder):
    """A model trained, saved and loaded again, scored on the test entities on record."""
    rows, store = _training_rows(spark, folder), run_store(spark)
    train(rows, store, PLAN, STUMPS, ["ridge"])
    return rounded(evaluate(rows, store, "ridge"))


@book.add("mean_of_models_scores", _labels_sql(_joint_stump_sql() + _RIDGE + _STACK + """, mixed AS (
  SELECT target, actual, (2 * p1 + p2) / 3 AS predicted FROM both_all WHERE split = 'test')""") + _scores_sql("mean", "mixed", "target"))
def mean_of_models_scores(spark, folder):
    """Two saved models weighted two to one, scored on the test entities on record."""
    rows, store = _training_rows(spark, folder), run_store(spark)
    train(rows, store, PLAN, STUMPS, ["ridge", "random_forest"])
    return rounded(evaluate_mean(rows, store, ["ridge", "random_forest"], [2.0, 1.0]))


_LINE = "my + sy * (c * n / (sx * sy)) / (n + 1.0e0) * (log10(re) - mx) / sx"


@book.add("predicted_conditions", _labels_sql(_RIDGE) + f""", {VEC.removeprefix("WITH ")}, asked AS (
  SELECT entity_id, unnest([0.0e0, 30.0e0, 5.0e0]) AS alpha, unnest([1e3, 1e5, 1e6]) AS re FROM vec),
fits AS (SELECT entity_id, alpha, re, {", ".join(
    f"max(CASE WHEN target = '{t}' THEN {'exp' if t == 'cd' else ''}({_LINE}) END) AS {t}_fit" for t in TARGETS)}
  FROM asked CROSS JOIN scale GROUP BY ALL),
blended AS (SELECT *, 0.01e0 + 0.9e0 * cl_fit AS cl, 0.001e0 + 0.8e0 * cd_fit AS cd, 1.1e0 * cm_fit - 0.02e0 AS cm FROM fits)
SELECT entity_id, alpha, re AS "Re", {", ".join(r6(t, t) for t in TARGETS)}, {", ".join(r6(f"{t}_fit", f"ridge__{t}") for t in TARGETS)},
  {r6("CASE WHEN cd > 1e-9 THEN cl / cd END", '"L_over_D"')}, array_to_string(list_filter([
    CASE WHEN re < 1778.2794100389228e0 THEN 'reynolds' END, CASE WHEN alpha < -25 OR alpha > 25 THEN 'alpha' END],
    lambda f: f IS NOT NULL), ' ') AS outside FROM blended""")
def predicted_conditions(spark, folder):
    """The prediction job: a trained model, blending weights, all shapes of the catalog at listed conditions."""
    plan = TrainingPlan(features=("Re",), targets=TARGETS, reynolds="Re", drag="cd", log_drag=True)
    rows, store = _training_rows(spark, folder).withColumnRenamed("reynolds", "Re"), run_store(spark)
    train(rows, store, plan, STUMPS, ["ridge"])
    shapes = vec(spark, folder).select("entity_id", "upper", "lower", "le", "te")
    asked = query_rows(shapes, {"alpha": [0.0, 30.0, 5.0], "Re": [1e3, 1e5, 1e6]})
    weights = {"cl": {"ridge": 0.9, "intercept": 0.01}, "cd": {"ridge": 0.8, "intercept": 0.001},
               "cm": {"ridge": 1.1, "intercept": -0.02}}
    table = predictions_of(feature_rows(asked, plan), store, ["entity_id"], per_model=True, weights=weights)
    return rounded(table.select(
        "entity_id", "alpha", "Re", *TARGETS, *[f"ridge__{t}" for t in TARGETS], "L_over_D",
        F.array_join("outside", " ").alias("outside")))


HIDDEN = [[((o * 7 + i * 3) % 11 - 5) / 10 for i in range(18)] for o in range(6)]
OUTPUT = [[((o * 5 + i * 2) % 7 - 3) / 10 for i in range(6)] for o in range(3)]


def _sum_sql(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _dense_sql() -> str:
    inputs = [*[f"upper[{i + 1}]" for i in range(8)], *[f"lower[{i + 1}]" for i in range(8)], "le", "te"]
    hidden = ", ".join(
        f"greatest(0, {_sum_sql([f'{(o - 2) / 10}e0', *[f'({w}e0) * {x}' for w, x in zip(row, inputs)]])}) AS h{o}"
        for o, row in enumerate(HIDDEN)
    )
    out = ", ".join(
        r6(_sum_sql([f"{o / 10}e0", *[f"({w}e0) * h{i}" for i, w in enumerate(row)]]), t)
        for (o, row), t in zip(enumerate(OUTPUT), TARGETS)
    )
    return f"WITH {VEC}, h AS (SELECT entity_id, {hidden} FROM vec) SELECT entity_id, {out} FROM h"


@book.add("dense_scores", _dense_sql())
def dense_scores(spark, folder):
    layers = load_layers(spark.createDataFrame(
        [(0, HIDDEN, [(o - 2) / 10 for o in range(6)]), (1, OUTPUT, [o / 10 for o in range(3)])],
        LAYER_SCHEMA,
    ))
    flat = flatten_shapes(vec(spark, folder))
    return rounded(score_dense(flat, SHAPE_FEATURES, layers, TARGETS, ["entity_id"]))


# -- blending -----------------------------------------------------------------------------------


def _gram_sql() -> str:
    parts = []
    for t in TARGETS:
        names = [f"{t}_a", f"{t}_b", t]
        for i in range(3):
            for j in range(i, 3):
                parts.append(
                    f"SELECT '{t}' AS target, {i} AS i, {j} AS j,"
                    f" {r6(f'covar_pop({names[i]}, {names[j]}) * count(*)', 'product')}, count(*) AS n FROM obs"
                )
    return f"WITH {OBS} {' UNION ALL '.join(parts)}"


@book.add("gram_matrix", _gram_sql())
def gram_matrix(spark, folder):
    return rounded(stacking.gram_table(obs(spark, folder), {t: t for t in TARGETS}, MODELS))


def _stacking_sql() -> str:
    parts = []
    for t in TARGETS:
        a, b = f"{t}_a", f"{t}_b"
        parts.append(f"""SELECT '{t}' AS target, var_pop({a}) * count(*) + 1 AS g11, var_pop({b}) * count(*) + 1 AS g22,
  covar_pop({a}, {b}) * count(*) AS g12, covar_pop({a}, {t}) * count(*) AS c1, covar_pop({b}, {t}) * count(*) AS c2,
  avg({a}) AS m1, avg({b}) AS m2, avg({t}) AS my FROM obs""")
    return f"""WITH {OBS}, g AS ({" UNION ALL ".join(parts)}),
tries AS (
  SELECT *, (c1 * g22 - c2 * g12) / (g11 * g22 - g12 * g12) AS w1, (c2 * g11 - c1 * g12) / (g11 * g22 - g12 * g12) AS w2 FROM g
  UNION ALL SELECT *, c1 / g11, 0 FROM g UNION ALL SELECT *, 0, c2 / g22 FROM g UNION ALL SELECT *, 0, 0 FROM g),
best AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY
    w1 * w1 * g11 + 2 * w1 * w2 * g12 + w2 * w2 * g22 - 2 * (c1 * w1 + c2 * w2)) AS rn
  FROM tries WHERE w1 >= 0 AND w2 >= 0)
SELECT target, 'a' AS model, {r6("w1", "weight")} FROM best WHERE rn = 1
UNION ALL SELECT target, 'b', {r6("w2")} FROM best WHERE rn = 1
UNION ALL SELECT target, 'intercept', {r6("my - w1 * m1 - w2 * m2")} FROM best WHERE rn = 1"""


@book.add("stacking_weights", _stacking_sql())
def stacking_weights(spark, folder):
    return rounded(stacking.fit_stacking(obs(spark, folder), {t: t for t in TARGETS}, MODELS))


WEIGHTS = {
    "cl": {"a": 0.75, "b": 0.25, "intercept": 0.01},
    "cd": {"a": 0.5, "b": 0.4, "intercept": 0.002},
    "cm": {"a": 0.6, "b": 0.4, "intercept": -0.003},
}


def _blend_term(t: str) -> str:
    w = WEIGHTS[t]
    return f"({w['intercept']}e0 + {w['a']}e0 * {t}_a + {w['b']}e0 * {t}_b)"


@book.add("blend_fixed_weights", f"""WITH {OBS} SELECT l_orderkey, entity_id, alpha,
  {", ".join(f"{_blend_term(t)} AS blend_{t}" for t in TARGETS)} FROM obs""")
def blend_fixed_weights(spark, folder):
    mixed = stacking.blend(obs(spark, folder), WEIGHTS, MODELS, "blend_")
    return mixed.select("l_orderkey", "entity_id", "alpha", *[f"blend_{t}" for t in TARGETS])


@book.add("blend_by_weights_table", f"""WITH {OBS} SELECT entity_id, target,
  CAST(round(sum(CAST(predicted AS DECIMAL(24, 12))), 6) AS DOUBLE) AS sum_predicted, count(*) AS n FROM (
  {" UNION ALL ".join(f"SELECT entity_id, '{t}' AS target, {_blend_term(t)} AS predicted FROM obs" for t in TARGETS)}
) b GROUP BY entity_id, target""")
def blend_by_weights_table(spark, folder):
    """Weights looked up in a table by target and model; sums are exact decimals, so their rounding is too."""
    blended = stacking.blend_rows(obs(spark, folder), weights_table(spark, WEIGHTS), MODELS, ["entity_id"])
    exact = F.sum(F.col("predicted").cast("decimal(24,12)"))
    return blended.groupBy("entity_id", "target").agg(
        F.round(exact, 6).cast("double").alias("sum_predicted"), F.count(F.lit(1)).alias("n")
    )


@book.add("weighted_mean", f"""WITH {OBS} SELECT l_orderkey, entity_id, alpha,
  {", ".join(f"(2.0e0 * {t}_a + 1.0e0 * {t}_b) / 3.0e0 AS mean_{t}" for t in TARGETS)} FROM obs""")
def weighted_mean(spark, folder):
    mixed = stacking.weighted_mean(obs(spark, folder), TARGETS, MODELS, [2.0, 1.0], "mean_")
    return mixed.select("l_orderkey", "entity_id", "alpha", *[f"mean_{t}" for t in TARGETS])


# Fixed linear stand-ins for trained models: intercept, alpha, log10 Re, first upper coefficient.
LINEAR = {
    "a": {"cl": (0.1, 0.11, 0.0, 0.5), "cd": (0.03, 0.0005, -0.004, 0.01), "cm": (-0.05, 0.001, 0.0, -0.2)},
    "b": {"cl": (0.2, 0.10, -0.01, 0.4), "cd": (0.02, 0.0007, -0.003, 0.02), "cm": (-0.04, 0.0, 0.0, -0.1)},
}


def _predict_sql() -> str:
    pred = ", ".join(
        f"({c[0]}e0 + {c[1]}e0 * alpha + {c[2]}e0 * log10(re) + {c[3]}e0 * u0) AS {t}_{m}"
        for m, by in LINEAR.items() for t, c in by.items()
    )
    return f"""WITH {VEC}, q AS (SELECT entity_id, label, upper[1] AS u0, CAST(a AS DOUBLE) * 2.5e0 - 30.0e0 AS alpha, re
  FROM vec, (SELECT unnest(range(0, 24)) AS a), (SELECT unnest([1000.0e0, 100000.0e0, 1000000.0e0]) AS re)),
p AS (SELECT *, {pred} FROM q),
b AS (SELECT *, {", ".join(f"{_blend_term(t)} AS {t}" for t in TARGETS)} FROM p)
SELECT entity_id, alpha, re AS "Re", 0.0e0 AS mach, 9.0e0 AS n_crit, 1.0e0 AS xtr_upper, 1.0e0 AS xtr_lower,
  {", ".join(r6(t, t) for t in TARGETS)}, round(CASE WHEN cd > 1e-9 THEN cl / cd END, 4) + 0.0e0 AS "L_over_D",
  {", ".join(r6(f"{t}_{m}", f"{m}__{t}") for m in LINEAR for t in TARGETS)},
  array_to_string(list_filter([CASE WHEN re < 1778.2794100389228e0 THEN 'reynolds' END,
    CASE WHEN alpha < -25 OR alpha > 25 THEN 'alpha' END], lambda f: f IS NOT NULL), ' ') AS outside FROM b"""


@book.add("predict_table", _predict_sql())
def predict_table(spark, folder):
    """Every shape of the catalog swept over conditions and scored by a blended pair of models."""
    swept = sweep(
        vec(spark, folder),
        alpha=inclusive_sweep(F.lit(-30.0), F.lit(27.5), F.lit(2.5)),
        Re=F.array(F.lit(1e3), F.lit(1e5), F.lit(1e6)),
    )
    queries = flatten_shapes(fill_conditions(swept)).withColumn("log_re", F.log10("Re"))
    scored = queries.withColumns({
        f"{t}_{m}": F.lit(c[0]) + F.lit(c[1]) * F.col("alpha") + F.lit(c[2]) * F.col("log_re")
        + F.lit(c[3]) * F.col("upper_0")
        for m, by in LINEAR.items() for t, c in by.items()
    })
    blended = stacking.blend(scored, WEIGHTS, MODELS)
    flags = envelope_flags(F.col("alpha"), F.col("Re"), F.col("mach"))
    out = blended.select(
        "entity_id", "alpha", "Re", "mach", "n_crit", "xtr_upper", "xtr_lower",
        *[F.round(t, 6).alias(t) for t in TARGETS],
        F.round(guarded_ratio(F.col("cl"), F.col("cd")), 4).alias("L_over_D"),
        *[F.round(f"{t}_{m}", 6).alias(f"{m}__{t}") for m in LINEAR for t in TARGETS],
        F.array_join(flags, " ").alias("outside"),
    )
    return out


@book.add("broadcast_conditions", f"""WITH {VEC}
SELECT entity_id, CAST(i - 1 AS INTEGER) AS condition_no, [upper[1] * 10, upper[2] * 10, upper[3] * 10][i] AS alpha,
  100000.0e0 * (label + 1) AS "Re" FROM vec, (SELECT unnest(range(1, 4)) AS i)""")
def broadcast_condition_lists(spark, folder):
    """Condition lists of each shape against its single Reynolds number."""
    u = F.col("upper")
    listed = vec(spark, folder).select(
        "entity_id", F.transform(F.slice(u, 1, 3), lambda a: a * 10).alias("alpha"),
        F.array(F.lit(100000.0) * (F.col("label") + 1)).alias("Re"),
    )
    return broadcast_conditions(listed, ["alpha", "Re"])


# -- synthetic cases ----------------------------------------------------------------------------


def _u(stream: str, start: int = 1, seed: int = 42) -> str:
    return (
        f"((CAST(('0x' || substr(md5('{seed}|' || c_custkey || '|{stream}|0'), {start}, 13)) AS BIGINT) + 0.5e0)"
        " / 4503599627370496.0e0)"
    )


def _n(stream: str) -> str:
    return f"(sqrt(-2.0e0 * ln({_u(stream)})) * cos(2.0e0 * pi() * {_u(stream, 14)}))"


def _points_sql() -> str:
    c = SamplingConfig()
    shift = f"({-c.alpha_uniform}e0 + {_u('alpha.shift')} * {2 * c.alpha_uniform}e0 + {c.alpha_sigma}e0 * {_n('alpha.normal')})"

    def xtr(side: str) -> str:
        return (
            f"CASE WHEN {_u(side + '.free')} < {c.free_transition_probability}e0 THEN 1.0e0"
            f" ELSE {_u(side + '.place')} END"
        )

    return f"""SELECT printf('TRAIN_%06d', c_custkey) AS case_name, {r6(f"pow(10, {c.log10_reynolds_mean}e0 + {c.log10_reynolds_sigma}e0 * {_n('reynolds')}) / 1e6", "reynolds_millions")},
  0.0e0 AS mach, {r6(f"{c.n_crit_low}e0 + {_u('n_crit')} * {c.n_crit_high - c.n_crit_low}e0", "n_crit")},
  {r6(xtr("xtr_upper"), "xtr_upper")}, {r6(xtr("xtr_lower"), "xtr_lower")},
  CAST(g AS INTEGER) AS condition_no, {r6(f"g * 5.0e0 - 15.0e0 + {shift}", "alpha")}
FROM customer, (SELECT unnest(range(0, 7)) AS g)"""


@book.add("synth_operating_points", _points_sql())
def synth_operating_points(spark, folder):
    """One operating point per customer, exploded to its seven conditions."""
    cases = spread_scan(table(spark, folder, "customer").select("c_custkey"), "c_custkey")
    points = explode_conditions(operating_points(cases, "c_custkey"))
    return rounded(
        points.withColumn("reynolds_millions", F.col("reynolds") / 1e6).select(
            numbered_id("TRAIN_", F.col("c_custkey")).alias("case_name"), "reynolds_millions", "mach", "n_crit", "xtr_upper", "xtr_lower",
            "condition_no", "alpha",
        )
    )


@book.add("synth_shapes")
def synth_shapes(spark, folder):
    """One synthetic shape per customer, blended from the shapes of the catalog."""
    cases = spread_scan(table(spark, folder, "customer").select("c_custkey"), "c_custkey")
    shapes = sample_shapes(cases, "c_custkey", vec18(spark, folder), "entity_id", "vector")
    return shapes


# -- trees ----------------------------------------------------------------------------------------

_CUTS = """SELECT *, (x + lead(x) OVER w) / 2 AS cut, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
    sum(n) OVER p AS na, sum(s) OVER p AS sa FROM {per}
  WINDOW w AS (PARTITION BY {by}, feature ORDER BY x), p AS (PARTITION BY {by}, feature)"""
_GAIN = "sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na"


def _splits_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT l_orderkey, '{t}' AS target, {t} AS y, alpha, reynolds FROM obs" for t in TARGETS)
    unfolded = "CROSS JOIN LATERAL (VALUES ('alpha', alpha), ('reynolds', reynolds)) f(feature, x)"
    return f"""WITH {OBS}, lab AS ({rows}),
per1 AS (SELECT target, feature, x, count(*) AS n, sum(y) AS s FROM lab {unfolded} GROUP BY ALL),
cut1 AS ({_CUTS.format(per="per1", by="target")}),
one AS (SELECT target, feature AS f1, cut AS c1 FROM cut1 WHERE na > nl
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY {_GAIN} DESC) = 1),
sides AS (SELECT lab.*, f1, c1, CASE WHEN f1 = 'alpha' THEN alpha ELSE reynolds END <= c1 AS low FROM lab JOIN one USING (target)),
per2 AS (SELECT target, low, feature, x, count(*) AS n, sum(y) AS s FROM sides {unfolded} GROUP BY ALL),
cut2 AS ({_CUTS.format(per="per2", by="target, low")}),
two AS (SELECT target, low, feature, cut, sl / nl AS below, (sa - sl) / (na - nl) AS above FROM cut2 WHERE na > nl
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY {_GAIN} DESC) = 1)
SELECT target, f1 AS first_feature, {r6("c1", "first_cut")}, low AS second_is_low, feature AS second_feature,
  {r6("cut", "second_cut")}, {r6("below", "below")}, {r6("above", "above")} FROM two JOIN one USING (target)"""


@book.add("leafwise_splits", _splits_sql())
def leafwise_splits(spark, folder):
    """The first two splits of a tree a target, largest gain first, and the means of the leaves of the second."""
    config = ModelConfig(boosting_rounds=1, boosting_leaves=3, boosting_min_leaf=1, boosting_rate=1.0)
    names = ["alpha", "reynolds"]
    model = fit_models(obs(spark, folder).select(*names, *TARGETS), names, TARGETS, "boosting", config)
    base = F.element_at(F.lit(model.base.tolist()), F.get("targets", F.lit(0)) + 1)
    nodes = model.nodes.withColumn("feature_name", F.get(F.lit(names), F.col("feature"))).withColumn(
        "mean", base + F.get("value", F.lit(0)))
    root = nodes.where("node = 0").select(
        "tree", F.get(F.lit(list(TARGETS)), F.get("targets", F.lit(0))).alias("target"),
        F.col("feature_name").alias("first_feature"), F.col("cut").alias("first_cut"), F.col("left").alias("low_node"))
    second = nodes.where("node > 0 and feature >= 0").select(
        "tree", "node", F.col("feature_name").alias("second_feature"), F.col("cut").alias("second_cut"),
        F.col("left").alias("l"), F.col("right").alias("r"))
    leaves = nodes.select("tree", "node", "mean")
    both = root.join(second, "tree").join(
        leaves.select("tree", F.col("node").alias("l"), F.col("mean").alias("below")), ["tree", "l"]).join(
        leaves.select("tree", F.col("node").alias("r"), F.col("mean").alias("above")), ["tree", "r"])
    return rounded(both.select(
        "target", "first_feature", "first_cut", (F.col("node") == F.col("low_node")).alias("second_is_low"),
        "second_feature", "second_cut", "below", "above"))


ENSEMBLES = ModelConfig(
    forest_trees=20, forest_leaves=64, boosting_rounds=20, boosting_leaves=16, boosting_patience=5)
ENSEMBLE_PLAN = TrainingPlan(
    features=("alpha", "reynolds", "l_suppkey", "l_partkey"), targets=TARGETS, reynolds="reynolds", drag="cd",
    log_drag=True,
)


@book.add("forest_ensemble")
def forest_ensemble(spark, folder):
    """Twenty trees of up to 64 leaves, each for all targets, on drawn rows and features; metrics by part of the split."""
    return rounded(train(_training_rows(spark, folder), run_store(spark), ENSEMBLE_PLAN, ENSEMBLES, ["random_forest"]))


@book.add("boosted_ensemble")
def boosted_ensemble(spark, folder):
    """Up to twenty rounds of trees of 16 leaves a target, ended by rows held back; metrics by part of the split."""
    return rounded(train(_training_rows(spark, folder), run_store(spark), ENSEMBLE_PLAN, ENSEMBLES, ["boosting"]))


@book.add("candidate_search")
def candidate_search(spark, folder):
    """Metrics of every candidate and target on held-out entities; the candidates of a model share their scans."""
    grid = {"random_forest": [{"forest_trees": 4, "forest_leaves": 16}, {"forest_trees": 8, "forest_leaves": 64}],
            "boosting": [{"boosting_rounds": 4, "boosting_leaves": 8}, {"boosting_rounds": 6, "boosting_leaves": 4}]}
    metrics, _, _ = search(_training_rows(spark, folder), ENSEMBLE_PLAN, 12_000, grid, ENSEMBLES)
    return rounded(metrics.select("model", "candidate", "target", "mae", "rmse", "r2"))


@book.add("training_losses", _labels_sql(f""", known AS (SELECT *, NOT ({_STOPPING}) AS fitted FROM lab WHERE split = 'train'),
scale AS (SELECT target, var_pop(label) AS v, avg(label) FILTER (WHERE fitted) AS base FROM known GROUP BY target)
""") + f"""SELECT 'boosting' AS model, target, CAST(0 AS INTEGER) AS iteration,
  {r6("avg((label - base) ^ 2) FILTER (WHERE fitted) / any_value(v)", "loss")},
  {r6("avg((label - base) ^ 2) FILTER (WHERE NOT fitted) / any_value(v)", "held_loss")}
FROM known JOIN scale USING (target) GROUP BY target""")
def training_losses(spark, folder):
    """The recorded losses of a boosting run before its only round, on fitted rows and on those held back."""
    store = run_store(spark)
    train(_training_rows(spark, folder), store, PLAN, STUMPS, ["boosting"])
    return rounded(store.read("history"))


@book.add("stored_weights", _labels_sql(_joint_stump_sql() + _RIDGE + _STACK) + f"""
SELECT target, 'ridge' AS model, {r6("w1", "weight")} FROM weights UNION ALL SELECT target, 'random_forest', {r6("w2")} FROM weights
UNION ALL SELECT target, 'intercept', {r6("my - w1 * m1 - w2 * m2")} FROM weights""")
def stored_weights(spark, folder):
    """Blending weights as they are read back from the run that fitted them."""
    rows, store = _training_rows(spark, folder), run_store(spark)
    train(rows, store, PLAN, STUMPS, ["ridge", "random_forest"])
    stack(rows, store, ["ridge", "random_forest"])
    return rounded(weights_table(spark, store.weights()))


def _wide_ridge_sql() -> str:
    return f"""WITH {EMBEDDED}, t AS (SELECT unnest(range(3, 65)) AS k),
m AS (SELECT k, count(*) AS n, avg(v[1]) AS m1, avg(v[2]) AS m2, avg(v[k]) AS my, var_pop(v[1]) * count(*) + 1 AS g11,
  var_pop(v[2]) * count(*) + 1 AS g22, covar_pop(v[1], v[2]) * count(*) AS g12, covar_pop(v[1], v[k]) * count(*) AS c1,
  covar_pop(v[2], v[k]) * count(*) AS c2 FROM v, t GROUP BY k),
w AS (SELECT *, (c1 * g22 - c2 * g12) / (g11 * g22 - g12 * g12) AS w1, (c2 * g11 - c1 * g12) / (g11 * g22 - g12 * g12) AS w2 FROM m)
SELECT 'e' || (k - 1) AS target, 'e0' AS term, {r6("w1", "coefficient")} FROM w UNION ALL SELECT 'e' || (k - 1), 'e1', {r6("w2")} FROM w
UNION ALL SELECT 'e' || (k - 1), 'intercept', {r6("my - w1 * m1 - w2 * m2")} FROM w"""


@book.add("wide_ridge", _wide_ridge_sql())
def wide_ridge(spark, folder):
    """Ridge of 62 targets on two inputs: one pass over the rows, one solve."""
    wide = _embeddings(spark, folder).select(*[F.get("vector", F.lit(i)).alias(f"e{i}") for i in range(64)])
    fitted = fit_models(wide, ["e0", "e1"], [f"e{i}" for i in range(2, 64)], "ridge")
    return rounded(ridge_coefficients(fitted, spark))
