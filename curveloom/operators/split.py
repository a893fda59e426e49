"""Splitting and sampling by entity, so that no entity is on both sides.

Entities are put in the order of their seeded md5 and cut by position. Only the table of distinct
ids is ranked (see ``ranking``); rows meet their label in an equi-join on the id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveloom.functions.scalars import half_even
from curveloom.operators.quality import require_none
from curveloom.operators.ranking import rank_by_digest
from curveloom.operators.skew import attach, find_hot_keys

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def _check_fractions(test_fraction: float, validation_fraction: float) -> None:
    if test_fraction <= 0 or validation_fraction <= 0 or test_fraction + validation_fraction >= 1:
        raise ValueError(
            f"test and validation need a share each and must leave some to train on: {test_fraction}, {validation_fraction}"
        )


def _share(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1).cast("long"), half_even(n * F.lit(float(fraction))))


def entity_split(
    df: DataFrame, id_column: str, test_fraction: float = 0.2, validation_fraction: float = 0.2,
    seed: int = 42, strict: bool = False,
) -> DataFrame:
    """(id, split) for every entity: test first, then validation, the rest train."""
    _check_fractions(test_fraction, validation_fraction)
    ids = df.select(F.col(id_column).cast("string").alias(id_column))
    if strict and ids.distinct().limit(3).count() < 3:
        raise ValueError("at least three distinct entities are required")
    n = F.col("n_ids")
    n_test, n_validation = _share(n, test_fraction), _share(n, validation_fraction)
    too_many = n_test + n_validation >= n
    n_test = F.when(too_many, F.lit(1)).otherwise(n_test)
    n_validation = F.when(too_many, F.lit(1)).otherwise(n_validation)
    at = F.col("position")
    return rank_by_digest(ids, id_column, seed).select(
        id_column,
        F.when(at <= n_test, F.lit(TEST)).when(at <= n_test + n_validation, F.lit(VALIDATION))
        .otherwise(F.lit(TRAIN)).alias("split"),
    )


def fixed_holdout_split(
    df: DataFrame, id_column: str, holdout: DataFrame, validation_fraction: float = 0.2,
    seed: int = 42, strict: bool = False,
) -> DataFrame:
    """Exactly the given ids are test; the others are cut into validation and train."""
    ids = df.select(F.col(id_column).cast("string").alias(id_column)).distinct()
    given = holdout.select(F.col(id_column).cast("string").alias(id_column)).distinct()
    if strict:
        require_none(given.join(ids, id_column, "left_anti"), "held-out entities without rows")
    remaining = rank_by_digest(ids.join(given, id_column, "left_anti"), id_column, seed)
    n = F.col("n_ids")
    n_validation = _share(n, validation_fraction)
    n_validation = F.when(n_validation >= n, F.lit(1)).otherwise(n_validation)
    rest = remaining.select(
        id_column,
        F.when(F.col("position") <= n_validation, F.lit(VALIDATION)).otherwise(F.lit(TRAIN))
        .alias("split"),
    )
    return rest.unionByName(
        given.join(ids, id_column, "left_semi").withColumn("split", F.lit(TEST))
    )


def label_rows(df: DataFrame, split: DataFrame, id_column: str) -> DataFrame:
    """Rows with their split label; safe when one entity holds much of the table."""
    return attach(df, split, find_hot_keys(df, [id_column]))


def rows_of(df: DataFrame, split: DataFrame, id_column: str, *labels: str) -> DataFrame:
    wanted = split.where(F.col("split").isin(*labels)).select(id_column)
    return df.join(wanted, id_column, "left_semi")


def split_counts(df: DataFrame, split: DataFrame, id_column: str) -> DataFrame:
    """Entities and rows per split. Rows are counted per entity before they meet the labels."""
    per_entity = df.groupBy(id_column).agg(F.count(F.lit(1)).alias("_rows"))
    return per_entity.join(split, id_column).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_entities"), F.sum("_rows").alias("n_rows")
    )


def split_defects(split: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Ids with more than one label, without any, or unknown; empty for a sound split."""
    labels = split.groupBy(id_column).agg(F.count_distinct("split").alias("n_splits"))
    known = ids.select(id_column).distinct().withColumn("_known", F.lit(1))
    joined = known.join(labels, id_column, "full_outer")
    return joined.where(
        F.col("_known").isNull() | F.col("n_splits").isNull() | (F.col("n_splits") > 1)
    ).select(id_column, F.coalesce("n_splits", F.lit(0)).alias("n_splits"))


def sample_entities(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """All rows of ``n`` entities drawn without replacement; every row when there are fewer."""
    if n < 0:
        raise ValueError("n must not be negative")
    chosen = rank_by_digest(df, id_column, seed).where(F.col("position") <= n).select(id_column)
    return df.join(chosen, id_column, "left_semi")


def report_sample(df: DataFrame, id_column: str, most: int | None, seed: int = 0) -> DataFrame:
    """Entities to report on: all for None, none for 0 or less, else a sample of ``most``."""
    if most is None:
        return df
    if most <= 0:
        return df.where(F.lit(False))
    return sample_entities(df, id_column, most, seed)


def first_per_entity(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each entity, as a combinable minimum instead of a sort per entity."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    ).select(*keys, *[F.col("_row")[c].alias(c) for c in others])
