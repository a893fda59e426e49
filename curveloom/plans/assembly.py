"""Assembling the training table from cases, returned conditions and sampled curves."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curveloom.functions.scalars import midcell_stations
from curveloom.operators.curves import (
    LOWER, UPPER, resample_surface, split_at_minimum, split_by_step_sign, thousandths,
)
from curveloom.operators.matching import nearest_match, unmatched
from curveloom.operators.quality import (
    PROFILE_COLUMNS, PROFILE_POINTS, dataset_counts, first_failures,
)
from curveloom.operators.skew import HotKeys, cut_lineage, find_hot_keys, with_facts
from curveloom.operators.synth import SENTINEL, SamplingConfig, sentinel_rows
from curveloom.sources.store import provenance, table_exists
from curveloom.sources.tables import TRAINING_SCHEMA, pending_cases, write_shards, write_table

QUANTITIES = ("theta", "H", "ue_vinf")
# Coefficients of one side of a shape.
N_SIDE = 8


@dataclass(frozen=True)
class Assembled:
    rows: DataFrame
    failures: DataFrame


def surface_profiles(
    samples: DataFrame, keys: list[str], split_rule: str = "step_sign",
    points: int = PROFILE_POINTS, hot: HotKeys | None = None,
) -> Assembled:
    """Six resampled profile arrays per curve, from samples (keys, ord, x, quantities).

    ``split_rule`` is ``step_sign`` (default) or ``minimum``.
    """
    hot = find_hot_keys(samples, keys) if hot is None else hot
    if split_rule == "step_sign":
        surfaces, unsplit = split_by_step_sign(samples, keys, "x", "ord", hot=hot)
    elif split_rule == "minimum":
        surfaces, unsplit = split_at_minimum(samples, keys, "x", "ord", hot=hot)
    else:
        raise ValueError(f"unknown split rule: {split_rule}")
    # Read once for each quantity: kept, instead of splitting the curves again.
    surfaces = cut_lineage(surfaces)
    stations = midcell_stations(points)
    sides = [*keys, "surface"]
    within = hot.finer(sides) or find_hot_keys(surfaces, sides)
    tables, short = None, []
    for quantity in QUANTITIES:
        # Each quantity drops its own unusable samples.
        values, rejected = resample_surface(
            surfaces, sides, "x", "ord", [quantity], stations, within
        )
        short.append(rejected.select(*keys, "reason"))
        tables = values if tables is None else tables.join(values, sides)
    wide = tables.groupBy(*keys).agg(*[
        F.max(F.when(F.col("surface") == side, F.col(q))).alias(f"{side}_bl_{q}")
        for side in (UPPER, LOWER) for q in QUANTITIES
    ])
    complete = F.lit(True)
    for side in (UPPER, LOWER):
        for q in QUANTITIES:
            complete = complete & F.col(f"{side}_bl_{q}").isNotNull()
    failures = unsplit
    for part in short:
        failures = failures.unionByName(part)
    return Assembled(wide.where(complete), failures.distinct())


def assemble_training_rows(
    cases: DataFrame, returned: DataFrame, samples: DataFrame, split_rule: str = "step_sign",
) -> Assembled:
    """Training rows of all cases, and a failure row with reason for every condition that has none.

    ``cases``: entity_id, upper, lower, le, te, Re, mach, n_crit, xtr_upper, xtr_lower, alpha (one
    row per requested condition). ``returned``: entity_id, ord, alpha and outputs. ``samples``:
    entity_id, alpha, ord, x and the quantities, one curve per returned condition. Of curves whose
    conditions round to the same thousandth the last one, by condition, is used.
    """
    outputs = ["CL", "CD", "CM", "Top_Xtr", "Bot_Xtr"]
    matched = nearest_match(cases, returned, ["entity_id"], "alpha", outputs, "ord")
    missing = unmatched(matched, ["entity_id"], "alpha")
    keys = ["entity_id", "_key"]
    keyed = samples.withColumn("_key", thousandths(F.col("alpha")))
    hot = find_hot_keys(keyed, keys)
    last = with_facts(keyed, {"_last": F.max("alpha")}, hot).where(F.col("alpha") == F.col("_last"))
    found = surface_profiles(last.drop("alpha", "_last"), keys, split_rule, hot=hot)
    # Read twice: kept, instead of splitting and resampling the curves again.
    profiles = Assembled(cut_lineage(found.rows), found.failures)
    hits = matched.where(F.col("matched").isNotNull()).withColumn(
        "_key", thousandths(F.col("matched"))
    )
    rows = hits.join(profiles.rows, ["entity_id", "_key"]).withColumn(
        "confidence", F.lit(1.0)
    ).drop("_key", "matched")
    lost = (
        hits.select("entity_id", "alpha", "_key")
        .join(profiles.rows.select("entity_id", "_key"), ["entity_id", "_key"], "left_anti")
        .join(
            profiles.failures.groupBy("entity_id", "_key").agg(F.min("reason").alias("reason")),
            ["entity_id", "_key"], "left",
        )
        .select(
            "entity_id", "alpha",
            F.coalesce("reason", F.lit("no curve was produced")).alias("reason"),
        )
    )
    return Assembled(rows, missing.unionByName(lost))


def failures_by_case(failures: DataFrame, shown: int = 4) -> DataFrame:
    """(entity_id, n_failures, first_reasons): failures of each case, the first few with condition."""
    place = Window.partitionBy("entity_id").orderBy("alpha", "reason")
    numbered = failures.withColumn("_n", F.row_number().over(place))
    return numbered.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_failures"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_n") <= shown, F.struct("_n", "reason")))),
            lambda r: r["reason"],
        ).alias("first_reasons"),
    )


def vector_size() -> int:
    """Numbers in a training row: shape, conditions, confidence, outputs and profiles."""
    arrays = {"upper": N_SIDE, "lower": N_SIDE, **{c: PROFILE_POINTS for c in PROFILE_COLUMNS}}
    return sum(arrays.get(f.name, 1) for f in TRAINING_SCHEMA.fields if f.name != "entity_id")


def build_dataset(
    spark: SparkSession, folder: str, cases: DataFrame, returned: DataFrame, samples: DataFrame,
    seed: int = 42, resume: bool = False, sentinel: bool = True,
    config: SamplingConfig = SamplingConfig(), n_buckets: int = 64, files_per_bucket: int = 1,
    catalog_size: int | None = None,
) -> DataFrame:
    """Append new cases to the shards, combine them and write the provenance record (returned).

    A first run may resume too. ``n_buckets`` times ``files_per_bucket`` tasks write the shards:
    choose them so that each has a file's worth of rows.
    """
    shards = f"{folder}/shards"
    requested = cases
    resume = resume and table_exists(spark, shards)
    if resume:
        cases = pending_cases(cases, spark.read.parquet(shards), "entity_id")
    assembled = assemble_training_rows(cases, returned, samples)
    write_shards(
        assembled.rows, shards, "entity_id", n_buckets, files_per_bucket,
        mode="append" if resume else "overwrite",
    )
    write_table(assembled.failures, f"{folder}/failures")
    failures = spark.read.parquet(f"{folder}/failures")
    write_table(failures_by_case(failures), f"{folder}/failures_by_case")
    written = table_exists(spark, shards)
    if not written or spark.read.parquet(shards).isEmpty():
        shown = first_failures(spark.read.parquet(f"{folder}/failures_by_case"), "entity_id").collect()
        listed = "; ".join(f"{r['entity_id']}: {', '.join(r['first_reasons'])}" for r in shown)
        raise RuntimeError(f"not one training row came out of the build ({listed or 'and no failure'})")
    combined = spark.read.parquet(shards).drop("bucket")
    if sentinel:
        combined = combined.unionByName(sentinel_rows(spark))
    write_table(combined, f"{folder}/training_data")
    table = spark.read.parquet(f"{folder}/training_data")
    record = provenance(
        dataset_counts(table, "entity_id", SENTINEL), failures,
        {
            "seed": seed, "profile_points": PROFILE_POINTS, "sampling": asdict(config),
            "requested_cases": requested.select("entity_id").distinct().count(),
            "catalog_size": catalog_size, "vector_size": vector_size(),
        },
    )
    write_table(record, f"{folder}/provenance", "json")
    return record
