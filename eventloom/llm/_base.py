"""Helpers shared by the text operators: scratch tables, table paths, worker state."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from eventloom.session import scratch_dir

_WORKER_STATE: dict[Any, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the shared tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ids, hashes and signatures that one task gathers into a file, if every core has a task.
FILE_ROWS = 20_000


def files_for(df: DataFrame) -> int:
    """Files for tables of about as many rows as ``df``, which is written already and counted by its footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // FILE_ROWS))


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    The files survive the loss of any executor, are compressed, and later reads prune columns.  With ``files``, small partitions
    are gathered into so many at most.  On a local or mounted folder without Hadoop's native library each file costs the executor three processes
    (``chmod`` of the attempt's folder, the file and its checksum), and until its program is loaded such a process counts as large as the JVM.
    """
    if files:
        df = df.coalesce(files)
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of tables that :func:`written` made and that no later result reads."""
    for df in frames:
        if path := getattr(df, "scratch_path", None):
            jvm = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm, True)


def worker_state(key: Any, build: Callable[[], Any]) -> Any:
    """One object per Python worker, so that memos survive from task to task of one operator.

    Another operator's object makes way, so that a worker never holds the memos of several.
    """
    if key not in _WORKER_STATE:
        _WORKER_STATE.clear()
        _WORKER_STATE[key] = build()
    return _WORKER_STATE[key]
