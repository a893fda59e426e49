"""Registered queries: whole jobs, and artefacts written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveloom.operators import curves, quality, split
from curveloom.operators.features import drop_overlap
from curveloom.operators.metrics import pair_targets
from curveloom.plans.assembly import Assembled, assemble_training_rows, failures_by_case
from curveloom.plans.dataset import coordinate_texts
from curveloom.plans.prediction import export_predictions
from curveloom.registry.book import Book, r6, rounded
from curveloom.registry.curves import STEP_SIGN, interpolation_sql
from curveloom.registry.entities import SPLIT
from curveloom.registry.models import run_store
from curveloom.registry.views import MODELS, OBS, TEXT, curve, obs, text, user_load
from curveloom.sources import tables

book = Book()
TARGETS = ("cl", "cd", "cm")


# -- assembly of training rows --------------------------------------------------------------------


def _assembled(spark: SparkSession, folder: str) -> Assembled:
    """Every user is a case asked for at two conditions. The second one comes back for even users
    only, and its curve for those divisible by four; returned conditions are a little off."""
    rows = curve(spark, folder, user_load(spark, folder)).select(
        F.col("curve_id").cast("string").alias("entity_id"), F.col("curve_id").alias("_u"), "ord", "x", "y")
    users = rows.select("entity_id", "_u").distinct()
    asked = users.select("*", F.explode(F.array(F.lit(0.0), F.lit(2.5))).alias("alpha"))
    weights = F.array(*[F.lit(0.1 * i) for i in range(8)])
    cases = asked.select(
        "entity_id", weights.alias("upper"), weights.alias("lower"), F.lit(0.0).alias("le"), F.lit(0.0).alias("te"),
        "alpha", F.lit(1e5).alias("Re"), F.lit(0.0).alias("mach"), F.lit(9.0).alias("n_crit"),
        F.lit(1.0).alias("xtr_upper"), F.lit(1.0).alias("xtr_lower"))
    off = F.col("alpha") + F.lit(0.0002)
    back = asked.where("alpha = 0 or _u % 2 = 0")
    returned = back.select(
        "entity_id", F.lit(1).alias("ord"), off.alias("alpha"), (F.col("_u") / 100.0).alias("CL"),
        F.lit(0.01).alias("CD"), F.lit(-0.02).alias("CM"), F.lit(0.3).alias("Top_Xtr"), F.lit(0.9).alias("Bot_Xtr"))
    samples = rows.select(
        "entity_id", F.explode(F.when(F.col("_u") % 4 == 0, F.array(F.lit(0.0002), F.lit(2.5002))).otherwise(
            F.array(F.lit(0.0002)))).alias("alpha"), "ord", "x",
        (F.col("y") / 100).alias("theta"), (F.col("y") * 2).alias("H"), (F.col("y") - 1).alias("ue_vinf"))
    return assemble_training_rows(cases, returned, samples)


_REQUESTS = f"""{STEP_SIGN}, users AS (SELECT DISTINCT curve_id FROM curve),
asked AS (SELECT curve_id, unnest([0.0e0, 2.5e0]) AS alpha FROM users)"""


@book.add("training_rows", f"""
WITH {_REQUESTS}, near AS (
  SELECT *, lag(x) OVER (PARTITION BY curve_id, surface ORDER BY x, ord) AS before FROM surfaces),
samples AS (SELECT curve_id, surface, x, y FROM near WHERE before IS NULL OR x - before > 1e-10),
{interpolation_sql("samples", "curve_id, surface", "SELECT i, (i + 0.5e0) / 32.0e0 AS p FROM (SELECT unnest(range(0, 32)) AS i)")},
wide AS (SELECT curve_id, i, max(CASE WHEN surface = 'upper' THEN v END) AS u, max(CASE WHEN surface = 'lower' THEN v END) AS l
  FROM resampled GROUP BY curve_id, i)
SELECT CAST(curve_id AS VARCHAR) AS entity_id, alpha, curve_id / 100.0e0 AS "CL", 1.0e0 AS confidence, CAST(i AS INTEGER) AS i,
  {r6("u / 100", "upper_bl_theta")}, {r6("u * 2", "upper_bl_H")}, {r6("u - 1", "upper_bl_ue_vinf")},
  {r6("l / 100", "lower_bl_theta")}, {r6("l * 2", "lower_bl_H")}, {r6("l - 1", "lower_bl_ue_vinf")}
FROM wide JOIN asked USING (curve_id) WHERE u IS NOT NULL AND l IS NOT NULL AND (alpha = 0 OR curve_id % 4 = 0)""")
def training_rows(spark, folder):
    """Rows of the assembly job: nearest condition, rounded key, split and resampled profiles."""
    names = [f"{s}_bl_{q}" for s in ("upper", "lower") for q in ("theta", "H", "ue_vinf")]
    rows = _assembled(spark, folder).rows
    return rounded(rows.select("entity_id", "alpha", "CL", "confidence", F.posexplode(F.arrays_zip(*names)).alias("i", "p")).select(
        "entity_id", "alpha", "CL", "confidence", "i", *[f"p.{n}" for n in names]), keep=("CL", "alpha", "confidence"))


_FAILED = f"""{_REQUESTS}, failed AS (SELECT CAST(curve_id AS VARCHAR) AS entity_id, alpha,
  CASE WHEN alpha > 0 AND curve_id % 2 = 1 THEN 'condition 2.500: not returned'
    WHEN alpha > 0 AND curve_id % 4 = 2 THEN 'no curve was produced'
    WHEN down IS NULL OR up IS NULL THEN 'the curve does not turn into two sides'
    WHEN down + 1 < 5 OR n + 1 - up < 5 THEN 'one side of the curve has too few samples' END AS reason
  FROM asked JOIN turn USING (curve_id))"""


@book.add("training_failures", f"WITH {_FAILED} SELECT entity_id, alpha, reason FROM failed WHERE reason IS NOT NULL")
def training_failures(spark, folder):
    """Conditions of the assembly job that gave no row, with reason."""
    return _assembled(spark, folder).failures.select("entity_id", "alpha", "reason")


@book.add("failures_by_case", f"""WITH {_FAILED} SELECT entity_id, count(*) AS n_failures,
  array_to_string(list(reason ORDER BY alpha, reason)[1:4], '; ') AS first_reasons
FROM failed WHERE reason IS NOT NULL GROUP BY entity_id""")
def failures_of_cases(spark, folder):
    counted = failures_by_case(_assembled(spark, folder).failures)
    return counted.withColumn("first_reasons", F.array_join("first_reasons", "; "))


@book.add("coordinate_texts", f"""WITH {TEXT} SELECT curve_id || '-' || chunk AS entity_id,
  CASE WHEN curve_id % 3 = 2 THEN 'p' ELSE '' END || text AS text FROM text""")
def texts_of_entities(spark, folder):
    """One coordinate text of each entity where some have three: ``.dat`` before ``.txt`` before none."""
    kind = F.col("curve_id") % 3
    texts = text(spark, folder, user_load(spark, folder)).withColumn(
        "entity_id", F.concat(F.col("curve_id").cast("string"), F.lit("-"), F.col("chunk").cast("string")))
    files = texts.withColumn("ending", F.explode(
        F.when(kind == 0, F.array(F.lit(".txt"), F.lit(".DAT"), F.lit(""))).when(kind == 1, F.array(F.lit(".txt"), F.lit("")))
        .otherwise(F.array(F.lit("")))))
    mark = F.when(F.col("ending") == "", "p").when((F.col("ending") == ".txt") & (kind == 0), "t").otherwise("")
    return coordinate_texts(texts.select("entity_id"), files.select(
        F.concat(F.lit("/shapes/"), "entity_id", "ending").alias("path"), F.concat(mark, "text").alias("text")))


# -- artefacts, written and read back -----------------------------------------------------------------


@book.add("csv_round_trip", f"""WITH {OBS} SELECT entity_id, alpha AS alpha_deg, reynolds, mach, cl, cd, cm FROM obs""")
def csv_round_trip(spark, folder):
    """The polar table as CSV, read back with its schema."""
    store = run_store(spark)
    polar = obs(spark, folder).select("entity_id", F.col("alpha").alias("alpha_deg"), "reynolds", "mach", *TARGETS)
    tables.write_table(polar, store.path("polar"), "csv")
    return tables.read_csv(spark, store.path("polar"), tables.POLAR_SCHEMA)


@book.add("shards_combined", f"""WITH {OBS} SELECT entity_id, l_orderkey, alpha, cl FROM obs""")
def shards_combined(spark, folder):
    """Rows in hash-bucketed shards, added in two runs of different entities, and combined again."""
    store = run_store(spark)
    rows = obs(spark, folder).select("entity_id", "l_orderkey", "alpha", "cl")
    first = rows.where(F.pmod(F.xxhash64("entity_id"), F.lit(3)) == 0)
    tables.write_shards(first, store.path("shards"), "entity_id", 8, mode="overwrite")
    done = tables.read_shards(spark, store.path("shards"))
    rest = tables.pending_cases(rows, done, "entity_id").select(*rows.columns)
    tables.write_shards(rest, store.path("shards"), "entity_id", 8, files_per_bucket=2)
    return tables.read_shards(spark, store.path("shards"))


@book.add("split_manifest", f"WITH {OBS}, {SPLIT} SELECT entity_id, split, 42 AS seed FROM split")
def split_manifest(spark, folder):
    return run_store(spark).save_split(split.entity_split(obs(spark, folder), "entity_id"), 42)


_PREDICTED = " UNION ALL ".join(
    f"SELECT l_orderkey, l_partkey, l_suppkey, '{t}' AS target, {t} AS actual, {t}_{m} AS predicted, '{m}' AS model FROM obs"
    for m in ("a", "b") for t in TARGETS)


@book.add("stored_predictions", f"WITH {OBS} {_PREDICTED}")
def stored_predictions(spark, folder):
    """Predictions of two models with the key of their row; the second run replaces one model."""
    store = run_store(spark)
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    paired = pair_targets(obs(spark, folder), MODELS, keys)
    store.save_predictions(paired.withColumn("predicted", F.lit(0.0)).where("model = 'a'"))
    store.save_predictions(paired.where("model = 'b'"))
    return store.save_predictions(paired.where("model = 'a'"))


@book.add("exported_predictions", f"""WITH {OBS} SELECT entity_id, l_orderkey, alpha, cl,
  CASE WHEN reynolds > 500000 THEN 'reynolds' || CASE WHEN alpha > 8 THEN ' alpha' ELSE '' END
    WHEN alpha > 8 THEN 'alpha' END AS outside FROM obs""")
def exported_predictions(spark, folder):
    """A prediction table as CSV with its list of warnings as text, read back."""
    path = run_store(spark).path("export")
    flags = F.filter(F.array(F.when(F.col("reynolds") > 500000, "reynolds"), F.when(F.col("alpha") > 8, "alpha")),
                     lambda f: f.isNotNull())
    export_predictions(obs(spark, folder).select("entity_id", "l_orderkey", "alpha", "cl", flags.alias("outside")), path)
    schema = T.StructType.fromDDL("entity_id string, l_orderkey long, alpha double, cl double, outside string")
    return tables.read_csv(spark, path, schema)


# -- projections and filters --------------------------------------------------------------------------


@book.add("selected_doubles", """SELECT CAST(l_suppkey AS DOUBLE) AS l_suppkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
  CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem""")
def selected_doubles(spark, folder):
    rows = tables.read_parquet(spark, f"{folder}/lineitem.parquet")
    quality.require_columns(rows, ["l_suppkey"], "key")
    return quality.select_doubles(rows, ["l_suppkey", "l_linenumber", "l_quantity"])


@book.add("polar_names", f"""WITH {OBS} SELECT entity_id, alpha AS alpha_deg, reynolds, cl, cd, cm FROM obs""")
def polar_names(spark, folder):
    """Training-table names to polar names, after columns that would overlap are dropped."""
    rows = obs(spark, folder).select(
        "entity_id", "alpha", F.col("reynolds").alias("Re"), F.col("cl").alias("CL"), F.col("cd").alias("CD"),
        F.col("cm").alias("CM"), F.lit(1).alias("camber"))
    return quality.as_polar(drop_overlap(rows, ["camber", "thickness"]))


@book.add("finite_rows", f"""WITH {OBS}, r AS (SELECT l_orderkey, alpha, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE cl END AS cl FROM obs)
SELECT l_orderkey, alpha, cl FROM r WHERE cl IS NOT NULL AND l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0""")
def finite(spark, folder):
    """Rows whose numbers are all finite, where some are null, not a number or infinite."""
    value = (F.when(F.col("l_orderkey") % 7 == 0, float("nan")).when(F.col("l_orderkey") % 11 == 0, float("-inf"))
             .when(F.col("l_partkey") % 5 == 0, None).otherwise(F.col("cl")))
    return quality.finite_rows(obs(spark, folder).select("l_orderkey", "alpha", value.alias("cl")), ["alpha", "cl"])


@book.add("export_order", f"""WITH {OBS} SELECT entity_id, alpha, cl, CAST(0 AS BIGINT) AS n_descents FROM obs""")
def export_order(spark, folder):
    """Rows as written in export order, with the number of steps back inside each written file."""
    path = run_store(spark).path("ordered")
    rows = obs(spark, folder).select("entity_id", "alpha", "cl")
    tables.write_table(curves.sorted_for_export(rows, "entity_id", "alpha"), path)
    back = spark.read.parquet(path).withColumn("_at", F.monotonically_increasing_id())
    order = Window.partitionBy(F.spark_partition_id(), "entity_id").orderBy("_at")
    steps = back.withColumn("_down", (F.lag("alpha").over(order) > F.col("alpha")).cast("int"))
    total = steps.agg(F.coalesce(F.sum("_down"), F.lit(0)).cast("long").alias("n_descents"))
    return back.drop("_at").withColumn("n_descents", F.lit(total.first()[0]))
