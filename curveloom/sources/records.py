"""Nested JSON records of shapes and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE_RECORD = (
    "name string, upper_weights array<double>, lower_weights array<double>, "
    "leading_edge_weight double, TE_thickness double"
)


def decode(column: Column, schema: str) -> Column:
    return F.from_json(column, schema)


def shapes_from_json(df: DataFrame, json: str) -> DataFrame:
    """Shape columns from JSON text; the name and the two scalars have defaults.

    A record without its two arrays is marked with a reason.
    """
    record = decode(F.col(json), SHAPE_RECORD)
    others = [c for c in df.columns if c != json]
    return df.select(*others, record.alias("_r")).select(
        *others,
        F.coalesce("_r.name", F.lit("airfoil")).alias("name"),
        F.col("_r.upper_weights").alias("upper"),
        F.col("_r.lower_weights").alias("lower"),
        F.coalesce("_r.leading_edge_weight", F.lit(0.0)).alias("le"),
        F.coalesce("_r.TE_thickness", F.lit(0.0)).alias("te"),
        F.when(
            F.col("_r.upper_weights").isNull() | F.col("_r.lower_weights").isNull(),
            F.lit("record lacks its coefficients"),
        ).alias("reason"),
    )


def shapes_to_json(name: Column, upper: Column, lower: Column, le: Column, te: Column) -> Column:
    return F.to_json(F.struct(
        name.cast("string").alias("name"), upper.alias("upper_weights"),
        lower.alias("lower_weights"), le.alias("leading_edge_weight"), te.alias("TE_thickness"),
    ))
