"""Session settings that the operators assume."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(name: str = "eventloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; keyword arguments give more, with ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors share: one for each application under ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made, but only on a local master: executors elsewhere would not see it.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="eventloom-scratch-")
        context.setCheckpointDir(shared)
        shared = context.getCheckpointDir() or shared
    return f"{shared.rstrip('/')}/eventloom-{context.applicationId}"
