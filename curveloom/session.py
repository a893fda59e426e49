"""Session settings the operators are designed for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "curveloom", master: str | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where it is unset and all runs in one process,
    as in tests, a temporary folder is used; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if configured:
        return configured
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(_own_folders[context.applicationId])
    return _own_folders[context.applicationId]


def stored(df: DataFrame, options: dict[str, object] | None = None) -> DataFrame:
    """``df`` as a new table in the shared folder: its lineage ends there, whatever executors are lost."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
