"""Resume as a stream: process the case files that arrived since the last run, then stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from curveloom.sources.tables import entity_bucket


def process_new_files(
    spark: SparkSession, source: str, schema: StructType, process: Callable[[DataFrame], DataFrame],
    target: str, progress: str, id_column: str, n_buckets: int = 64,
) -> None:
    """Run ``process`` over files not seen before and write its rows to bucketed shards.

    ``progress`` (in the shared folder) remembers which files are done. A batch writes to its own
    sub-folder and overwrites it when it is repeated, so a batch that failed halfway and runs again
    leaves every row once.
    """
    arrivals = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        (
            entity_bucket(process(batch), id_column, n_buckets)
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number}")
        )

    query = (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def processed_rows(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch", "bucket")
