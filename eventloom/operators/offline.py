"""The feature matrix of a folder of logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.timestamps import as_timestamp
from eventloom.model import ROW_ID, EventLogSpec
from eventloom.operators.traces import offline_features
from eventloom.sources.tables import list_csv, quoted, read_csv, resolve_log_columns, write_csv


def features_from_folder(spark: SparkSession, folder: str, max_rows: int | None = None, output: str | None = None) -> DataFrame:
    """A row of features per CSV file in ``folder`` whose columns have known names; other files are passed over.

    Logs of one kind (with or without times) share a plan, so that the number of files adds no jobs besides reading
    their headers.  ``output`` is a folder for the result as CSV.
    """
    timed: list[DataFrame] = []
    untimed: list[DataFrame] = []
    for path in list_csv(spark, folder):
        df = read_csv(spark, path, max_rows)
        found = resolve_log_columns(df.columns)
        if found is None:
            continue
        case, activity, time = found
        name = F.lit(path.rsplit("/", 1)[-1]).alias("file")
        when = as_timestamp(F.col(quoted(time)), dict(df.dtypes)[time]) if time else F.lit(None).cast("timestamp")
        rows = df.select(name, ROW_ID, F.col(quoted(case)).cast("string").alias("case"), F.col(quoted(activity)).cast("string").alias("activity"), when.alias("time"))
        (timed if time else untimed).append(rows)
    parts = []
    for logs, column in ((timed, "time"), (untimed, None)):
        if logs:
            parts.append(offline_features(reduce(DataFrame.unionByName, logs), EventLogSpec("case", "activity", column), "file"))
    if not parts:
        raise ValueError(f"no log in {folder}")
    found = reduce(DataFrame.unionByName, parts)
    if output:
        write_csv(found, output)
    return found
