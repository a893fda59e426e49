"""Model inputs: descriptors per entity, scaling with training statistics, label transforms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveloom.functions.scalars import LOG_FLOOR, floored_log, standardise, unstandardise
from curveloom.functions.shape import (
    DESCRIPTOR_COLUMNS, N_WEIGHTS, coefficient, describe_shapes,
)
from curveloom.operators.gram import moments
from curveloom.operators.quality import drop_overlap
from curveloom.operators.skew import attach, find_hot_keys
from curveloom.session import stored

# Descriptors of up to so many entities are broadcast (about 20 MB).
MOST_BROADCAST_ENTITIES = 100_000
# Condition columns of the published tables (fixed values).
CONDITION_COLUMNS = ["alpha", "Re", "mach", "n_crit", "xtr_upper", "xtr_lower"]


def add_descriptors(
    df: DataFrame, entity: str, upper: str = "upper", lower: str = "lower", le: str = "le",
    te: str = "te",
) -> DataFrame:
    """Shape descriptors, computed once per entity and joined back to its rows.

    Nothing is done when all descriptor columns exist; a partial set is dropped and redone.
    """
    if all(c in df.columns for c in DESCRIPTOR_COLUMNS):
        return df
    df = drop_overlap(df, DESCRIPTOR_COLUMNS)
    # One shape per entity, picked by the smallest hash. Plain numbers keyed by a number are
    # aggregated in hash tables; arrays would make every task sort its rows first.
    order = F.xxhash64(upper, lower, le, te)
    coefficients = {
        **{coefficient("upper", i): F.get(F.col(upper), F.lit(i)) for i in range(N_WEIGHTS)},
        **{coefficient("lower", i): F.get(F.col(lower), F.lit(i)) for i in range(N_WEIGHTS)},
        "le": F.col(le), "te": F.col(te),
    }
    shapes = stored(df.groupBy(entity).agg(
        *[F.min_by(c, order).alias(name) for name, c in coefficients.items()]
    ))
    # Much work on few bytes: keep the partition count instead of letting small ones be merged.
    n_partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    described = describe_shapes(shapes.repartition(n_partitions, entity), [entity])
    # The rows of few entities stay where they are: neither shuffled nor sorted.
    if shapes.count() <= MOST_BROADCAST_ENTITIES:
        return df.join(F.broadcast(described), entity, "left")
    return attach(df, described, find_hot_keys(df, [entity]), "left")


def raw_inputs(vector: Column, alpha: Column, reynolds: Column, mach: Column) -> Column:
    """Input array: shape ordinates, then alpha, log10 Reynolds number and mach."""
    return F.concat(vector, F.array(alpha, F.log10(reynolds), mach))


# -- scaler -------------------------------------------------------------------------------------


def scaler_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std) with the population deviation; one pass for all columns.

    A constant column gets deviation 1.
    """
    wide = df.agg(
        *[F.avg(c).alias(f"_m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"_s_{i}") for i, c in enumerate(columns)],
    )
    entries = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"_m_{i}").alias("mean"),
            F.when(F.col(f"_s_{i}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{i}")).alias("std"),
        )
        for i, c in enumerate(columns)
    ]))
    return wide.select(entries.alias("_e")).select("_e.column", "_e.mean", "_e.std")


class Scaler:
    """Statistics of named columns applied as literals (one row per column, on the driver)."""

    def __init__(self, statistics: dict[str, tuple[float, float]]) -> None:
        self.statistics = statistics

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "Scaler":
        return cls.from_table(scaler_statistics(df, columns))

    @classmethod
    def from_table(cls, table: DataFrame) -> "Scaler":
        return cls({r["column"]: (r["mean"], r["std"]) for r in table.collect()})

    def to_table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(c, m, s) for c, (m, s) in self.statistics.items()],
            "column string, mean double, std double",
        )

    def transform(self, df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
        return df.withColumns({
            f"{c}{suffix}": standardise(F.col(c), *map(F.lit, self.statistics[c])) for c in columns
        })

    def inverse(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """Undo the scaling; ``columns`` maps a scaled column to the statistics it was scaled with."""
        return df.withColumns({
            c: unstandardise(F.col(c), *map(F.lit, self.statistics[source]))
            for c, source in columns.items()
        })


# -- labels -------------------------------------------------------------------------------------


def log_label(df: DataFrame, column: str) -> DataFrame:
    """Natural log of a label, floored at 1e-6; a value below -1e-6 is an error."""
    c = F.col(column)
    return df.withColumn(
        column,
        F.when(
            c < F.lit(-LOG_FLOOR), F.raise_error(F.lit(f"a value of {column} is below zero and has no logarithm"))
        ).otherwise(floored_log(c)),
    )


def unlog_label(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.exp(F.col(column)))


# -- vector statistics --------------------------------------------------------------------------


def vector_mean(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(i, mean) of each vector element, in one aggregation row."""
    wide = df.agg(*[F.avg(F.get(F.col(vector), F.lit(i))).alias(f"m_{i}") for i in range(size)])
    entries = F.posexplode(F.array(*[f"m_{i}" for i in range(size)]))
    return wide.select(entries.alias("i", "mean"))


def vector_covariance(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(i, j, covariance) with n - 1, for i <= j, over the rows whose vector is complete.

    Each task multiplies its batches; see ``gram``. The result is a small table made from the merged matrix.
    """
    found = moments(df, F.col(vector), size)
    i, j = np.triu_indices(size)
    with np.errstate(divide="ignore", invalid="ignore"):
        values = found.covariance()[i, j] if found.n > 1 else np.full(len(i), np.nan)
    table = pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "covariance": values})
    return df.sparkSession.createDataFrame(table, "i int, j int, covariance double").withColumn(
        "covariance", F.when(~F.isnan("covariance"), F.col("covariance")))
