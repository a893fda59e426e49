"""Registered queries: checks, splits, samples and dataset bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from curveloom.operators import quality, split
from curveloom.operators.synth import SENTINEL, sentinel_rows
from curveloom.registry.book import Book, r6, rounded
from curveloom.registry.views import CURVE, OBS, VEC, curve, obs, table, user_load, vec
from curveloom.sources.store import merge_by_key
from curveloom.sources.tables import combine, pending_cases

book = Book()

FINITE = "alpha IS NOT NULL AND isfinite(alpha) AND isfinite(cl) AND isfinite(cd_a) AND isfinite(cm)"


@book.add("quality_report", f"""
WITH {OBS}, c AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE NOT ({FINITE})) AS v1, count(*) FILTER (WHERE NOT (reynolds > 0)) AS v2,
  count(*) FILTER (WHERE cd_a < 0) AS v3, count(*) FILTER (WHERE cd_a < -1e-6) AS v4 FROM obs)
SELECT 'non_finite' AS rule, n AS n_rows, v1 AS n_violations FROM c
UNION ALL SELECT 'reynolds_not_positive', n, v2 FROM c
UNION ALL SELECT 'drag_negative', n, v3 FROM c
UNION ALL SELECT 'drag_not_loggable', n, v4 FROM c""")
def quality_report(spark, folder):
    rows = obs(spark, folder)
    rules = quality.polar_rules(["alpha", "reynolds", "mach", "cl", "cd_a", "cm"], drag="cd_a")
    return quality.rule_report(rows, rules)


@book.add("orphan_entities", f"""
WITH {OBS} SELECT DISTINCT entity_id FROM obs
WHERE entity_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)""")
def orphan_entities(spark, folder):
    catalog = table(spark, folder, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").cast("string").alias("entity_id")
    )
    return quality.orphans(obs(spark, folder), catalog, "entity_id")


WIDE_OBS = f"""{OBS}, w AS (
  SELECT l_orderkey, entity_id, alpha * 2.5e0 AS alpha,
    CASE WHEN l_partkey % 10 = 0 THEN reynolds * 0.01e0 ELSE reynolds END AS reynolds,
    CASE WHEN l_suppkey % 4 = 0 THEN 0.1e0 ELSE 0.0e0 END AS mach FROM obs)"""
R_LOW, R_HIGH = (repr(v) for v in quality.REYNOLDS_ENVELOPE)


def _wide_obs(spark, folder):
    return obs(spark, folder).select(
        "l_orderkey", "entity_id", (F.col("alpha") * 2.5).alias("alpha"),
        F.when(F.col("l_partkey") % 10 == 0, F.col("reynolds") * 0.01)
        .otherwise(F.col("reynolds")).alias("reynolds"),
        F.when(F.col("l_suppkey") % 4 == 0, F.lit(0.1)).otherwise(F.lit(0.0)).alias("mach"),
    )


@book.add("envelope_flags", f"""
WITH {WIDE_OBS} SELECT l_orderkey, entity_id, alpha, reynolds, mach,
  array_to_string(list_filter([
    CASE WHEN reynolds < {R_LOW} OR reynolds > {R_HIGH} THEN 'reynolds' END,
    CASE WHEN alpha < -25 OR alpha > 25 THEN 'alpha' END,
    CASE WHEN abs(mach) > 0 THEN 'mach' END], lambda f: f IS NOT NULL), ' ') AS outside FROM w""")
def envelope_flags(spark, folder):
    flags = quality.envelope_flags(F.col("alpha"), F.col("reynolds"), F.col("mach"))
    return _wide_obs(spark, folder).withColumn("outside", F.array_join(flags, " "))


@book.add("envelope_warnings", f"""
WITH {WIDE_OBS} SELECT min(reynolds) < {R_LOW} OR max(reynolds) > {R_HIGH} AS reynolds_outside,
  min(alpha) < -25 OR max(alpha) > 25 AS alpha_outside, max(abs(mach)) > 0 AS mach_outside FROM w""")
def envelope_warnings(spark, folder):
    return quality.envelope_warnings(_wide_obs(spark, folder), "alpha", "reynolds", "mach")


@book.add("pattern_projection", f"""
WITH {OBS} SELECT entity_id, alpha, cl_a, cd_a, cm_a, cl_b, cd_b, cm_b FROM obs""")
def pattern_projection(spark, folder):
    rows = obs(spark, folder)
    wanted = quality.columns_like(rows, r"^c[dlm]_", ["entity_id", "alpha"])
    return quality.normalise_types(rows.select(*wanted), "entity_id", wanted[1:])


@book.add("profile_wide", f"""
WITH {VEC} SELECT entity_id, label, {", ".join(f"upper[{i + 1}] AS upper_{i}" for i in range(8))} FROM vec""")
def profile_wide(spark, folder):
    shapes = vec(spark, folder).select("entity_id", "label", "upper")
    wide = quality.profiles_to_columns(shapes, ["upper"], 8)
    # There and back again: the wide form must hold everything the array held.
    return quality.profiles_to_columns(
        quality.columns_to_profiles(wide, ["upper"], 8), ["upper"], 8
    )


# -- splits -------------------------------------------------------------------------------------


def digest_sql(key: str, seed: int, stream: str = "") -> str:
    return f"md5('{seed}|' || {key} || '|{stream}|0')"


SPLIT = f"""ids AS (SELECT DISTINCT entity_id FROM obs),
ranked AS (SELECT entity_id, row_number() OVER (ORDER BY {digest_sql("entity_id", 42)}, entity_id) AS pos,
  count(*) OVER () AS n FROM ids),
sizes AS (SELECT *, greatest(1, round_even(n * 0.2e0, 0)) AS nt, greatest(1, round_even(n * 0.2e0, 0)) AS nv
  FROM ranked),
split AS (SELECT entity_id, CASE
  WHEN pos <= CASE WHEN nt + nv >= n THEN 1 ELSE nt END THEN 'test'
  WHEN pos <= CASE WHEN nt + nv >= n THEN 2 ELSE nt + nv END THEN 'validation'
  ELSE 'train' END AS split FROM sizes)"""


@book.add("grouped_split", f"WITH {OBS}, {SPLIT} SELECT entity_id, split FROM split")
def grouped_split(spark, folder):
    return split.entity_split(obs(spark, folder), "entity_id")


@book.add("split_counts", f"""
WITH {OBS}, {SPLIT}
SELECT split, count(DISTINCT entity_id) AS n_entities, count(*) AS n_rows
FROM obs JOIN split USING (entity_id) GROUP BY split""")
def split_counts(spark, folder):
    rows = obs(spark, folder).select("entity_id")
    return split.split_counts(rows, split.entity_split(rows, "entity_id"), "entity_id")


@book.add("labelled_rows", f"""
WITH {OBS}, {SPLIT} SELECT entity_id, alpha, reynolds, split FROM obs JOIN split USING (entity_id)""")
def labelled_rows(spark, folder):
    rows = obs(spark, folder).select("entity_id", "alpha", "reynolds")
    return split.label_rows(rows, split.entity_split(rows, "entity_id"), "entity_id")


@book.add("split_defects", f"""
WITH {OBS}, {SPLIT} SELECT entity_id, count(DISTINCT split) AS n_splits FROM ids
LEFT JOIN split USING (entity_id) GROUP BY entity_id HAVING count(DISTINCT split) <> 1""")
def split_defects(spark, folder):
    rows = obs(spark, folder).select("entity_id")
    return split.split_defects(split.entity_split(rows, "entity_id"), rows, "entity_id")


@book.add("fixed_holdout_split", f"""
WITH {OBS}, ids AS (SELECT DISTINCT entity_id FROM obs),
given AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS entity_id FROM supplier WHERE s_nationkey < 5),
ranked AS (SELECT entity_id, row_number() OVER (ORDER BY {digest_sql("entity_id", 42)}, entity_id) AS pos,
  count(*) OVER () AS n FROM ids WHERE entity_id NOT IN (SELECT entity_id FROM given)),
sizes AS (SELECT *, greatest(1, round_even(n * 0.2e0, 0)) AS nv FROM ranked)
SELECT entity_id, CASE WHEN pos <= CASE WHEN nv >= n THEN 1 ELSE nv END THEN 'validation' ELSE 'train' END AS split
FROM sizes UNION ALL SELECT entity_id, 'test' FROM given WHERE entity_id IN (SELECT entity_id FROM ids)""")
def fixed_holdout_split(spark, folder):
    holdout = table(spark, folder, "supplier").where("s_nationkey < 5").select(
        F.col("s_suppkey").cast("string").alias("entity_id")
    )
    return split.fixed_holdout_split(obs(spark, folder), "entity_id", holdout)


def sample_sql(n: int, seed: int) -> str:
    return f"""WITH {OBS}, ids AS (SELECT DISTINCT entity_id FROM obs),
picked AS (SELECT entity_id FROM ids ORDER BY {digest_sql("entity_id", seed)}, entity_id LIMIT {n})
SELECT entity_id, alpha, cl FROM obs WHERE entity_id IN (SELECT entity_id FROM picked)"""


@book.add("entity_sample", sample_sql(25, 42))
def entity_sample(spark, folder):
    rows = obs(spark, folder).select("entity_id", "alpha", "cl")
    return split.sample_entities(rows, "entity_id", 25)


@book.add("report_sample", sample_sql(10, 0))
def report_sample(spark, folder):
    rows = obs(spark, folder).select("entity_id", "alpha", "cl")
    return split.report_sample(rows, "entity_id", 10)


@book.add("recorded_rows", f"""
WITH {OBS}, {SPLIT} SELECT entity_id, alpha, cl FROM obs
WHERE entity_id IN (SELECT entity_id FROM split WHERE split = 'test')""")
def recorded_rows(spark, folder):
    rows = obs(spark, folder).select("entity_id", "alpha", "cl")
    test = split.entity_split(rows, "entity_id").where(F.col("split") == "test")
    return quality.keep_recorded(rows, test, "entity_id")


@book.add("first_per_entity", f"WITH {CURVE} SELECT curve_id, event_id, event_type, y FROM curve WHERE ord = 1")
def first_per_entity(spark, folder):
    rows = curve(spark, folder, user_load(spark, folder))
    return split.first_per_entity(
        rows.select("curve_id", "ord", "event_id", "event_type", "y"), ["curve_id"], ["ord"]
    ).drop("ord")


@book.add("resume_pending", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def resume_pending(spark, folder):
    cases = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return pending_cases(cases, done, "o_orderkey")


@book.add("distinct_conditions", f"WITH {OBS} SELECT DISTINCT alpha FROM obs")
def distinct_conditions(spark, folder):
    return quality.sorted_distinct(obs(spark, folder), "alpha")


# -- bookkeeping --------------------------------------------------------------------------------

UNION = f"""{OBS}, rows AS (
  SELECT entity_id, alpha, reynolds AS "Re", mach, cl AS "CL", cd AS "CD", cm AS "CM" FROM obs
  UNION ALL
  SELECT 'CYLINDER', -180.0e0 + 10.0e0 * a, CAST(r AS DOUBLE), 0, 0, 1, 0
  FROM (SELECT unnest(range(0, 37)) AS a) x, (VALUES (1e4), (1e5), (1e6)) t(r))"""


def _with_sentinel(spark, folder):
    rows = obs(spark, folder).select(
        "entity_id", "alpha", F.col("reynolds").alias("Re"), "mach",
        F.col("cl").alias("CL"), F.col("cd").alias("CD"), F.col("cm").alias("CM"),
    )
    return combine([rows, sentinel_rows(spark).select(*rows.columns)])


@book.add("union_sentinel", f'WITH {UNION} SELECT entity_id, alpha, "Re", mach, "CL", "CD", "CM" FROM rows')
def union_sentinel(spark, folder):
    return _with_sentinel(spark, folder)


@book.add("dataset_counts", f"""
WITH {UNION} SELECT count(*) FILTER (WHERE entity_id <> 'CYLINDER') AS n_rows,
  count(DISTINCT CASE WHEN entity_id <> 'CYLINDER' THEN entity_id END) AS n_entities,
  count(*) FILTER (WHERE entity_id = 'CYLINDER') AS n_sentinel_rows FROM rows""")
def dataset_counts(spark, folder):
    return quality.dataset_counts(_with_sentinel(spark, folder), "entity_id", SENTINEL)


@book.add("metrics_upsert", f"""
WITH {OBS}, old AS (SELECT l_suppkey % 7 AS model, {r6("avg(abs(cl - cl_a))", "mae")} FROM obs GROUP BY 1),
new AS (SELECT l_suppkey % 3 AS model, {r6("avg(abs(cl - cl_b))", "mae")} FROM obs GROUP BY 1)
SELECT model, mae FROM old WHERE model NOT IN (SELECT model FROM new) UNION ALL SELECT model, mae FROM new""")
def metrics_upsert(spark, folder):
    """Metrics of seven models, three of which were trained again."""
    rows = obs(spark, folder)
    old = rows.groupBy((F.col("l_suppkey") % 7).alias("model")).agg(
        F.avg(F.abs(F.col("cl") - F.col("cl_a"))).alias("mae")
    )
    new = rows.groupBy((F.col("l_suppkey") % 3).alias("model")).agg(
        F.avg(F.abs(F.col("cl") - F.col("cl_b"))).alias("mae")
    )
    return rounded(merge_by_key(old, new, ["model"]))
