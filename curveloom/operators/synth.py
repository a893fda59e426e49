"""Seeded synthetic cases: shapes blended from parents, operating points and sentinel rows.

Every number is drawn from the case key (see ``draws``), so cases can be generated anywhere, in
any order and again after a lost task with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveloom.functions.draws import normal, normal_columns, normals, uniform, uniform_between
from curveloom.functions.scalars import convex_weights, dot, line_grid, literal_array, power_of_ten
from curveloom.operators.features import vector_covariance
from curveloom.operators.quality import LOG10_REYNOLDS
from curveloom.operators.ranking import rank_by_digest

N_COEFFICIENTS = 18
N_SURFACE = 8
# The one case that marks a dataset as complete (fixed values).
SENTINEL = "CYLINDER"
SENTINEL_CONFIDENCE = 0.1
SENTINEL_REYNOLDS = (1e4, 1e5, 1e6)


@dataclass(frozen=True)
class SamplingConfig:
    """Parameters of the sampler (fixed values of the published dataset)."""

    parents: int = 3
    alpha_grid: tuple[float, ...] = (-15.0, -10.0, -5.0, 0.0, 5.0, 10.0, 15.0)
    alpha_uniform: float = 2.5
    alpha_sigma: float = 2.5
    log10_reynolds_mean: float = LOG10_REYNOLDS[0]
    log10_reynolds_sigma: float = LOG10_REYNOLDS[1]
    n_crit_low: float = 0.0
    n_crit_high: float = 18.0
    free_transition_probability: float = 0.8
    scale_log_sigma: float = 0.25
    mach: float = 0.0
    most_tries: int = 100


# -- operating points ---------------------------------------------------------------------------


def operating_points(
    cases: DataFrame, case_id: str, seed: int = 42, config: SamplingConfig = SamplingConfig()
) -> DataFrame:
    """Add the condition columns of each case; ``alphas`` is the grid moved as a whole."""
    key = F.col(case_id)
    shift = uniform_between(
        -config.alpha_uniform, config.alpha_uniform, key, seed, "alpha.shift"
    ) + F.lit(config.alpha_sigma) * normal(key, seed, "alpha.normal")

    def transition(side: str) -> Column:
        free = uniform(key, seed, f"{side}.free") < F.lit(config.free_transition_probability)
        return F.when(free, F.lit(1.0)).otherwise(uniform(key, seed, f"{side}.place"))

    def moved(by: Column) -> Column:
        return F.transform(literal_array(config.alpha_grid), lambda a: a + by)

    return cases.withColumns({
        # Bound to a lambda variable, the shift is drawn once for the whole grid.
        "alphas": F.get(F.transform(F.array(shift), moved), F.lit(0)),
        "reynolds": power_of_ten(
            F.lit(config.log10_reynolds_mean)
            + F.lit(config.log10_reynolds_sigma) * normal(key, seed, "reynolds")
        ),
        "mach": F.lit(config.mach),
        "n_crit": uniform_between(config.n_crit_low, config.n_crit_high, key, seed, "n_crit"),
        "xtr_upper": transition("xtr_upper"),
        "xtr_lower": transition("xtr_lower"),
    })


def explode_conditions(points: DataFrame) -> DataFrame:
    others = [c for c in points.columns if c != "alphas"]
    return points.select(*others, F.posexplode("alphas").alias("condition_no", "alpha"))


# -- shapes -------------------------------------------------------------------------------------


def covariance_factor(parents: DataFrame, vector: str, size: int = N_COEFFICIENTS) -> np.ndarray:
    """Lower-triangular factor of the vectors' covariance; the driver sees a size x size matrix."""
    matrix = np.zeros((size, size))
    for r in vector_covariance(parents, vector, size).collect():
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["covariance"]
    # Sums of floats differ in the last bits with the partitioning. Rounding them away keeps the
    # factor, and so every drawn shape, the same; directions without spread get none.
    digits = 12 - int(np.floor(np.log10(np.abs(matrix).max() or 1.0)))
    values, vectors = np.linalg.eigh(np.round(matrix, digits))
    root = vectors * np.sqrt(np.where(values > 1e-11 * max(values.max(), 0.0), values, 0.0))
    # The R factor of root' gives a triangular L with L L' = matrix, also for a singular matrix.
    return np.linalg.qr(root.T, mode="r").T


def numbered_parents(parents: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(parent_no from 1, n_parents, vector), numbered independently of the partitioning.

    An id that occurs more than once is one parent, with the smallest of its vectors.
    """
    parents = parents.groupBy(id_column).agg(F.min(vector).alias(vector))
    ranks = rank_by_digest(parents, id_column, 0, "parents")
    return parents.select(id_column, vector).join(ranks, id_column).select(
        F.col("position").alias("parent_no"), F.col("n_ids").alias("n_parents"),
        F.col(vector).alias("parent"),
    )


def _with_first_sound(df: DataFrame, rows: np.ndarray, most: int) -> DataFrame:
    """Replace the key texts ``_prefix`` and ``_gaps`` by ``_try``: the first one whose noise leaves every gap open, else null."""
    pairs = N_COEFFICIENTS // 2

    def first(texts: list[bytes], open_gaps: np.ndarray) -> np.ndarray:
        found = np.full(len(texts), -1, np.int32)
        sizes = np.array([len(t) for t in texts])
        for size in np.unique(sizes):
            left = np.flatnonzero(sizes == size)
            heads = np.frombuffer(b"".join(texts[i] for i in left), np.uint8).reshape(len(left), size)
            for attempt in range(most):
                z = np.concatenate(
                    [normal_columns(heads, str(attempt * pairs + i).encode()) for i in range(pairs)], axis=1)
                sound = (open_gaps[left] + z @ rows.T > 0).all(axis=1)
                found[left[sound]] = attempt
                left, heads = left[~sound], heads[~sound]
                if not len(left):
                    break
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch["_prefix"].to_pylist()]
            gaps = batch["_gaps"].flatten().to_numpy(zero_copy_only=False).reshape(len(texts), len(rows))
            found = first(texts, gaps)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(found, mask=found < 0)], names=[*batch.schema.names[:-2], "_try"])

    kept = df.drop("_prefix", "_gaps")
    schema = T.StructType([*kept.schema.fields, T.StructField("_try", T.IntegerType())])
    return df.select(*kept.columns, "_prefix", "_gaps").mapInArrow(run, schema)


def sample_shapes(
    cases: DataFrame, case_id: str, parents: DataFrame, parent_id: str, vector: str,
    seed: int = 42, config: SamplingConfig = SamplingConfig(),
) -> DataFrame:
    """One shape per case: (case id, upper, lower, le, te, accepted).

    A convex combination of random parents plus correlated noise. The noise is drawn again, up to
    ``most_tries`` times, until the upper coefficients all exceed the lower ones; ``accepted``
    tells whether that succeeded (the last try is kept otherwise). Tries are made for the rows of an
    Arrow batch at once and only as far as needed, so no rounds of joins are run.
    """
    key = F.col(case_id)
    factor = covariance_factor(parents, vector)
    numbered = numbered_parents(parents, parent_id, vector)
    n_parents = parents.select(parent_id).distinct().count()
    if n_parents == 0:
        raise ValueError("at least one parent is required")

    cuts = F.transform(
        F.sequence(F.lit(1), F.lit(config.parents - 1)),
        lambda i: uniform(key, seed, "weight", i),
    ) if config.parents > 1 else F.array().cast("array<double>")
    draws = F.transform(
        F.sequence(F.lit(1), F.lit(config.parents)),
        lambda i: F.floor(uniform(key, seed, "parent", i) * F.lit(n_parents)) + 1,
    )
    picked = cases.select(
        case_id,
        F.posexplode(F.arrays_zip(convex_weights(cuts).alias("weight"), draws.alias("no")))
        .alias("_at", "_p"),
    ).select(case_id, "_at", "_p.weight", F.col("_p.no").alias("parent_no"))
    # Drawing is heavy on few bytes, so the partition count is fixed instead of left to be merged.
    n_partitions = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = picked.join(numbered, "parent_no").repartition(n_partitions, case_id)
    # The few parents of a case are added in the order they were drawn.
    blended = parts.groupBy(case_id).agg(
        F.array_sort(F.collect_list(F.struct("_at", "weight", "parent"))).alias("_parts")
    ).select(case_id, F.transform(
        F.sequence(F.lit(0), F.lit(N_COEFFICIENTS - 1)),
        lambda i: F.aggregate(
            "_parts", F.lit(0.0), lambda total, p: total + p["weight"] * F.get(p["parent"], i)
        ),
    ).alias("blend"))

    factor_rows = F.array(*[literal_array(row) for row in factor])

    def noise(attempt: Column) -> Column:
        return normals(key, seed, "noise", attempt, N_COEFFICIENTS)

    def shaped(z: Column) -> Column:
        deviation = F.transform(factor_rows, lambda row: dot(row, z))
        return F.zip_with(F.col("blend"), deviation, lambda b, d: b + d)

    # How far the surfaces lie apart without noise, and the noise of that at each station.
    gaps = F.zip_with(
        F.slice("blend", 1, N_SURFACE), F.slice("blend", N_SURFACE + 1, N_SURFACE), lambda u, v: u - v)
    prefix = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit("noise"), F.lit(""))
    tried = _with_first_sound(
        blended.withColumns({"_prefix": prefix, "_gaps": gaps}), factor[:N_SURFACE] - factor[N_SURFACE:2 * N_SURFACE],
        config.most_tries)
    scale = F.exp(F.lit(config.scale_log_sigma) * normal(key, seed, "scale"))
    drawn = (
        # Bound to a lambda variable, the noise is drawn once for all elements of the shape.
        tried.withColumn("_vector", F.get(F.transform(
            F.array(noise(F.coalesce("_try", F.lit(config.most_tries - 1)))), shaped), F.lit(0)))
        .withColumn("_scale", scale)
    )
    v = F.col("_vector")

    def scaled(c: Column) -> Column:
        return F.transform(c, lambda x: x * F.col("_scale"))

    return drawn.select(
        case_id,
        scaled(F.slice(v, 1, N_SURFACE)).alias("upper"),
        scaled(F.slice(v, N_SURFACE + 1, N_SURFACE)).alias("lower"),
        (F.get(v, F.lit(16)) * F.col("_scale")).alias("le"),
        (F.greatest(F.lit(0.0), F.get(v, F.lit(17))) * F.col("_scale")).alias("te"),
        F.col("_try").isNotNull().alias("accepted"),
    )


# -- sentinel rows ------------------------------------------------------------------------------


def sentinel_rows(spark, profile_points: int = 32) -> DataFrame:
    """Rows of a round body: every Reynolds number with every angle of a full turn."""
    flat = F.array_repeat(F.lit(0.0), profile_points)
    return (
        spark.range(1)
        .select(F.explode(literal_array(SENTINEL_REYNOLDS)).alias("Re"))
        .select("Re", F.explode(line_grid(-180.0, 180.0, 37)).alias("alpha"))
        .select(
            F.lit(SENTINEL).alias("entity_id"),
            F.array_repeat(F.lit(0.0), N_SURFACE).alias("upper"),
            F.array_repeat(F.lit(0.0), N_SURFACE).alias("lower"),
            F.lit(0.0).alias("le"), F.lit(0.0).alias("te"),
            "alpha", "Re", F.lit(0.0).alias("mach"), F.lit(9.0).alias("n_crit"),
            F.lit(1.0).alias("xtr_upper"), F.lit(1.0).alias("xtr_lower"),
            F.lit(SENTINEL_CONFIDENCE).alias("confidence"),
            F.lit(0.0).alias("CL"), F.lit(1.0).alias("CD"), F.lit(0.0).alias("CM"),
            F.lit(0.5).alias("Top_Xtr"), F.lit(0.5).alias("Bot_Xtr"),
            *[flat.alias(c) for c in (
                "upper_bl_theta", "upper_bl_H", "upper_bl_ue_vinf",
                "lower_bl_theta", "lower_bl_H", "lower_bl_ue_vinf",
            )],
        )
    )
