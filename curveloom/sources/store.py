"""Artefacts of a run as tables in one folder.

``folder/split``, ``folder/metrics``, ``folder/predictions`` and so on are Parquet tables, so later
jobs read them with pushed-down filters instead of loading a document into the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from curveloom.operators.features import Scaler
from curveloom.operators.stacking import WEIGHTS_SCHEMA, Weights, weights_as_dict

CONFIG_SCHEMA = (
    "seed int, log_drag boolean, targets array<string>, features array<string>, "
    "entity string, reynolds string, drag string, options string"
)


# Files that a task has open at once while it writes predictions by model.
OPEN_FILES = 8
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException:
        return False


class RunStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        return table_exists(self.spark, self.path(name))

    def read(self, name: str) -> DataFrame:
        if not self.has(name):
            raise FileNotFoundError(f"no table {name!r} in {self.folder}")
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    # -- split manifest ---------------------------------------------------------------------

    def save_split(self, split: DataFrame, seed: int) -> DataFrame:
        return self.write("split", split.withColumn("seed", F.lit(seed)))

    def split(self) -> DataFrame:
        return self.read("split")

    # -- metrics ----------------------------------------------------------------------------

    def upsert_metrics(self, metrics: DataFrame) -> DataFrame:
        """Replace the rows of the models in ``metrics``; the other models keep theirs."""
        with_model = metrics.select(*[c for c in metrics.columns if c != "model"], "model")
        (
            with_model.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("model").parquet(self.path("metrics"))
        )
        return self.spark.read.parquet(self.path("metrics"))

    # -- predictions, one partition per model -------------------------------------------------

    def save_predictions(self, predictions: DataFrame) -> DataFrame:
        """Each task writes the files of its models side by side; for more models than ``OPEN_FILES`` it sorts its rows.

        The targets of a row follow one another, so their common keys take next to nothing as differences.
        """
        before = self.spark.conf.get(_OPEN_FILES, "0")
        self.spark.conf.set(_OPEN_FILES, str(OPEN_FILES))
        try:
            (
                predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .option("compression", "zstd").option("parquet.writer.version", "v2")
                .partitionBy("model").parquet(self.path("predictions"))
            )
        finally:
            self.spark.conf.set(_OPEN_FILES, before)
        return self.spark.read.parquet(self.path("predictions"))

    # -- scaler, weights, configuration ---------------------------------------------------------

    def save_scaler(self, scaler: Scaler) -> None:
        self.write("scaler", scaler.to_table(self.spark))

    def scaler(self) -> Scaler:
        return Scaler.from_table(self.read("scaler"))

    def save_weights(self, weights: DataFrame) -> None:
        self.write("stacking_weights", weights)

    def weights(self) -> Weights:
        return weights_as_dict(self.read("stacking_weights"))

    def save_config(self, config: dict) -> None:
        row = {**config, "options": json.dumps(config.get("options", {}), sort_keys=True)}
        self.write("training_config", self.spark.createDataFrame([row], CONFIG_SCHEMA))

    def config(self) -> dict:
        """Recorded configuration, or the defaults of folders without one."""
        if not self.has("training_config"):
            return {"seed": 42, "log_drag": False, "targets": None, "features": None, "options": {}}
        row = self.read("training_config").first().asDict()
        row["options"] = json.loads(row["options"])
        return row


def weights_table(spark: SparkSession, weights: Weights) -> DataFrame:
    rows = [(t, m, float(w)) for t, by_model in weights.items() for m, w in by_model.items()]
    return spark.createDataFrame(rows, WEIGHTS_SCHEMA)


def merge_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` plus the rows of ``old`` whose key is not in ``new``."""
    replaced = new.select(*keys).distinct()
    return old.join(replaced, list(keys), "left_anti").unionByName(new)


def provenance(counts: DataFrame, failures: DataFrame, facts: dict) -> DataFrame:
    """One row: counts, number of failures and the settings of the run as JSON."""
    failed = failures.agg(F.count(F.lit(1)).alias("n_failed_cases"))
    return counts.withColumn("_one", F.lit(1)).join(
        failed.withColumn("_one", F.lit(1)), "_one"
    ).drop("_one").withColumn("settings", F.lit(json.dumps(facts, sort_keys=True, default=str)))
