"""Session factory with the settings that every query assumes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lakeward", **conf: str) -> SparkSession:
    """Build or fetch a session: UTC, AQE, Arrow. Settings of a running session are kept."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(frame: DataFrame) -> DataFrame:
    """The frame, written to the checkpoint folder that all executors share; its lineage ends there."""
    _checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lakeward-"))
    return context.getCheckpointDir()
