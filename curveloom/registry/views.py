"""Views over the given tables that put them into the shape the operators expect.

Each view exists twice: as a DataFrame and as SQL text for the independent check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curveloom.functions.scalars import ratio_or_null
from curveloom.operators.ordered import OrderedRows, number
from curveloom.operators.skew import HotKeys, find_hot_keys, with_facts
from curveloom.sources.tables import spread_scan

MODELS = {m: {t: f"{t}_{m}" for t in ("cl", "cd", "cm")} for m in ("a", "b")}
LINES_PER_TEXT = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# -- observations with the predictions of two models --------------------------------------------


def spread_obs(spark: SparkSession, folder: str) -> DataFrame:
    """For reports that do much work per row."""
    return spread_scan(obs(spark, folder), "l_orderkey", "l_partkey")


def obs(spark: SparkSession, folder: str) -> DataFrame:
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        supp.cast("string").alias("entity_id"),
        (F.col("l_quantity") * 0.26 - 2.0).alias("alpha"),
        (F.lit(100000.0) * F.col("l_linenumber")).alias("reynolds"),
        F.lit(0.0).alias("mach"),
        (F.col("l_extendedprice") / 100000.0 - 0.2).alias("cl"),
        (F.lit(0.005) + F.col("l_tax") / 4.0).alias("cd"),
        (F.col("l_discount") - 0.06).alias("cm"),
    ).withColumns({
        "cl_a": F.col("cl") * 1.03 + F.lit(0.01) * (part % 7 - 3),
        "cd_a": F.col("cd") + F.lit(0.0012) * (part % 11 - 5),
        "cm_a": F.col("cm") * 0.95 + F.lit(0.002) * (supp % 5 - 2),
        "cl_b": F.col("cl") * 0.98 - F.lit(0.02) * (supp % 3 - 1),
        "cd_b": F.col("cd") * 1.1,
        "cm_b": F.col("cm") + F.lit(0.004) * (order % 9 - 4),
    })


OBS = """
obs0 AS (
  SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_suppkey AS VARCHAR) AS entity_id,
    l_quantity * 0.26e0 - 2.0e0 AS alpha, 100000.0e0 * l_linenumber AS reynolds,
    0.0e0 AS mach, l_extendedprice / 100000.0e0 - 0.2e0 AS cl,
    0.005e0 + l_tax / 4.0e0 AS cd, l_discount - 0.06e0 AS cm
  FROM lineitem),
obs AS (
  SELECT *, cl * 1.03e0 + 0.01e0 * (l_partkey % 7 - 3) AS cl_a,
    cd + 0.0012e0 * (l_partkey % 11 - 5) AS cd_a,
    cm * 0.95e0 + 0.002e0 * (l_suppkey % 5 - 2) AS cm_a,
    cl * 0.98e0 - 0.02e0 * (l_suppkey % 3 - 1) AS cl_b,
    cd * 1.1e0 AS cd_b, cm + 0.004e0 * (l_orderkey % 9 - 4) AS cm_b
  FROM obs0)"""


def paired_sql(
    keep: str, targets: tuple[str, ...] = ("cl", "cd", "cm"), ratio: bool = False,
    guarded: bool = True,
) -> str:
    keep = f"{keep}, " if keep else ""
    parts = []
    for m in ("a", "b"):
        parts += [
            f"SELECT {keep}'{m}' AS model, '{t}' AS target, {t} AS actual, {t}_{m} AS predicted FROM obs"
            for t in targets
        ]
        if ratio:
            ok = f"cd >= 1e-4 AND cd_{m} > 0" if guarded else f"cd <> 0 AND cd_{m} <> 0"
            parts.append(
                f"SELECT {keep}'{m}' AS model, 'ld' AS target, CASE WHEN {ok} THEN cl / cd END AS actual,"
                f" CASE WHEN {ok} THEN cl_{m} / cd_{m} END AS predicted FROM obs"
            )
    return f"{OBS}, paired AS ({' UNION ALL '.join(parts)})"


REGIME = """CASE WHEN alpha >= -2 AND alpha < 0 THEN 'negative lift'
  WHEN alpha >= 0 AND alpha < 4 THEN 'attached flow'
  WHEN alpha >= 4 AND alpha < 8 THEN 'drag rise'
  WHEN alpha >= 8 AND alpha < 11 THEN 'near stall' END"""


# -- one curve per user -------------------------------------------------------------------------


def user_load(spark: SparkSession, folder: str) -> HotKeys:
    """Users whose events need splitting, under the name the curve view gives them."""
    return find_hot_keys(
        table(spark, folder, "events").select(F.col("user_id").alias("curve_id")), ["curve_id"]
    )


def events_in_order(spark: SparkSession, folder: str, hot: HotKeys) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("curve_id"), "event_id", "event_type", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    return OrderedRows(events, ["curve_id"], ["at", "event_id"], hot).add(ord=number())


def curve(spark: SparkSession, folder: str, hot: HotKeys) -> DataFrame:
    rows = with_facts(
        events_in_order(spark, folder, hot), {"_start": F.min("at"), "_end": F.max("at")}, hot
    )
    place = ratio_or_null(
        (F.col("at") - F.col("_start")).cast("double"), (F.col("_end") - F.col("_start")).cast("double")
    )
    return rows.select(
        "curve_id", "ord", F.abs(F.lit(2.0) * place - 1.0).alias("x"),
        F.col("value").alias("y"), "event_id", "event_type",
    )


CURVE = """
curve0 AS (
  SELECT user_id AS curve_id, event_id, event_type, value AS y, epoch_us(ts) AS micros,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord,
    min(epoch_us(ts)) OVER (PARTITION BY user_id) AS s,
    max(epoch_us(ts)) OVER (PARTITION BY user_id) AS f
  FROM events),
curve AS (
  SELECT curve_id, ord, event_id, event_type, y,
    CASE WHEN f > s THEN abs(2.0e0 * (CAST(micros - s AS DOUBLE) / CAST(f - s AS DOUBLE)) - 1.0e0) END AS x
  FROM curve0)"""


# -- coefficient vectors ------------------------------------------------------------------------


def vec(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding")

    def part(start: int) -> Column:
        return F.transform(F.slice(e, start, 8), lambda v: v.cast("double"))

    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("entity_id"), "label", part(1).alias("upper"), part(9).alias("lower"),
        F.get(e, F.lit(16)).cast("double").alias("le"),
        F.abs(F.get(e, F.lit(17)).cast("double")).alias("te"),
    )


def vec18(spark: SparkSession, folder: str) -> DataFrame:
    return vec(spark, folder).select(
        "entity_id", "label", F.concat("upper", "lower", F.array("le", "te")).alias("vector")
    )


VEC = """
vec AS (
  SELECT vec_id AS entity_id, label,
    list_transform(embedding[1:8], lambda v: CAST(v AS DOUBLE)) AS upper,
    list_transform(embedding[9:16], lambda v: CAST(v AS DOUBLE)) AS lower,
    CAST(embedding[17] AS DOUBLE) AS le, abs(CAST(embedding[18] AS DOUBLE)) AS te
  FROM embeddings)"""


# -- texts of at most 64 lines built from consecutive events --------------------------------------


def text(spark: SparkSession, folder: str, hot: HotKeys) -> DataFrame:
    """Pair texts: every second one within small numbers and with a count line in front."""
    rows = curve_lines(spark, folder, hot)
    small = F.col("chunk") % 2 == 0
    x = F.when(small, F.col("ord") % 3).otherwise(F.col("ord"))
    y = F.when(small, F.col("whole") % 3).otherwise(F.col("whole"))
    line = F.concat_ws(" ", x.cast("string"), y.cast("string"))
    head = F.when(small, F.lit("49 49\n")).otherwise(F.lit(""))
    return join_lines(rows, line).select(
        "curve_id", "chunk",
        F.concat(F.lit("curve "), F.col("curve_id").cast("string"), F.lit("\n"), head, F.col("body"))
        .alias("text"),
    )


def dump_text(spark: SparkSession, folder: str, hot: HotKeys) -> DataFrame:
    """Texts with seven numbers per line; the momentum column is sometimes zero."""
    rows = curve_lines(spark, folder, hot)
    o, w = F.col("ord"), F.col("whole")
    line = F.concat_ws("  ", *[c.cast("string") for c in (
        o, F.abs(o - 32), w, o + 1, w * 3 + 1, o % 5, F.lit(7)
    )])
    return join_lines(rows, line).select(
        "curve_id", "chunk", F.concat(F.lit("  s x y u d t c\n"), F.col("body")).alias("text")
    )


def curve_lines(spark: SparkSession, folder: str, hot: HotKeys) -> DataFrame:
    return events_in_order(spark, folder, hot).select(
        "curve_id", "ord", F.floor((F.col("ord") - 1) / LINES_PER_TEXT).alias("chunk"),
        F.floor("value").alias("whole"),
    )


def join_lines(rows: DataFrame, line: Column) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return rows.groupBy("curve_id", "chunk").agg(
        F.array_join(F.transform(lines, lambda e: e["line"]), "\n").alias("body")
    )


LINES = CURVE + """,
lines AS (
  SELECT curve_id, ord, (ord - 1) // 64 AS chunk, CAST(floor(y) AS BIGINT) AS whole FROM curve0)"""

TEXT = LINES + """,
text AS (
  SELECT curve_id, chunk, 'curve ' || curve_id || chr(10)
    || CASE WHEN chunk % 2 = 0 THEN '49 49' || chr(10) ELSE '' END
    || string_agg(CASE WHEN chunk % 2 = 0 THEN (ord % 3) || ' ' || (whole % 3)
                       ELSE ord || ' ' || whole END, chr(10) ORDER BY ord) AS text
  FROM lines GROUP BY curve_id, chunk)"""
