"""Typed scans and sinks of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveloom.operators.quality import PROFILE_COLUMNS

POLAR_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType()),
    *[
        T.StructField(c, T.DoubleType())
        for c in ("alpha_deg", "reynolds", "mach", "cl", "cd", "cm")
    ],
])

SHAPE_FIELDS = [
    T.StructField("upper", T.ArrayType(T.DoubleType())),
    T.StructField("lower", T.ArrayType(T.DoubleType())),
    T.StructField("le", T.DoubleType()),
    T.StructField("te", T.DoubleType()),
]

TRAINING_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType()),
    *SHAPE_FIELDS,
    *[
        T.StructField(c, T.DoubleType())
        for c in (
            "alpha", "Re", "mach", "n_crit", "xtr_upper", "xtr_lower", "confidence",
            "CL", "CD", "CM", "Top_Xtr", "Bot_Xtr",
        )
    ],
    *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in PROFILE_COLUMNS],
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; the schema is given, so the files are read once."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores; larger scans stay as they are.

    For heavy work on a file that cannot be split. A table of more splits than cores is not
    shuffled.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)


def entity_bucket(df: DataFrame, id_column: str, n_buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(id_column), F.lit(n_buckets)).cast("int"))


def write_shards(
    df: DataFrame, path: str, id_column: str, n_buckets: int = 64, files_per_bucket: int = 1,
    mode: str = "append",
) -> None:
    """Parquet partitioned by a hash bucket of the id.

    Rows of a bucket go to ``files_per_bucket`` tasks, so that a bucket with a very large entity is
    still written in parallel.
    """
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_bucket))
    (
        entity_bucket(df, id_column, n_buckets)
        .withColumn("_spread", spread)
        .repartition("bucket", "_spread")
        .drop("_spread")
        .write.mode(mode).partitionBy("bucket").parquet(path)
    )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def pending_cases(cases: DataFrame, done: DataFrame, id_column: str) -> DataFrame:
    """Cases whose id is not in the finished shards yet."""
    return cases.join(done.select(id_column).distinct(), id_column, "left_anti")


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Parquet, or CSV / JSON lines on request."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("parquet", "json"):
        getattr(writer, fmt)(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
