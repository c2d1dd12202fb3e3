"""Reading tables, finding files and columns, and writing feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.model import LOG_FEATURES, ROW_ID

# Names under which a log's columns are known, best first.
CASE_NAMES = ("case:concept:name", "case_id", "Case_ID")
ACTIVITY_NAMES = ("concept:name", "activity")
TIME_NAMES = ("time:timestamp",)


def quoted(name: str) -> str:
    """``name`` for use in ``F.col``, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def with_row_id(df: DataFrame) -> DataFrame:
    """Attach the order of rows; a table that has one keeps it."""
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number becomes null in float columns, so that counts and distinct counts leave it out."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*(F.nanvl(F.col(quoted(c)), F.lit(None)).alias(c) if c in floats else F.col(quoted(c)) for c in df.columns))


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """A CSV file with a header, inferred types and a row order."""
    df = with_row_id(nan_to_null(spark.read.csv(path, header=True, inferSchema=True)))
    return df if max_rows is None else first_rows(df, max_rows)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in row order."""
    return df.orderBy(ROW_ID).limit(n)


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """CSV files right in a folder, by name; any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().toString() for s in found if s.isFile() and s.getPath().getName().endswith(".csv"))


def resolve_column(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first of ``names`` that is a column."""
    return next((n for n in names if n in columns), None)


def resolve_log_columns(columns: list[str]) -> tuple[str, str, str | None] | None:
    """Case, activity and time columns of a log with known names; None without case or activity."""
    case, activity = resolve_column(columns, CASE_NAMES), resolve_column(columns, ACTIVITY_NAMES)
    return (case, activity, resolve_column(columns, TIME_NAMES)) if case and activity else None


def training_matrix(df: DataFrame) -> DataFrame:
    """The features of ``LOG_FEATURES`` as doubles, by name and in order; a missing one is null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c) for c in LOG_FEATURES))


def read_training_matrix(spark: SparkSession, path: str) -> DataFrame:
    return training_matrix(spark.read.csv(path, header=True, inferSchema=True))


def write_csv(df: DataFrame, path: str) -> None:
    """A small table as one CSV file in the folder ``path``."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_means(means: DataFrame, path: str) -> None:
    """Mean feature vectors, one row per label."""
    means.write.mode("overwrite").parquet(path)


def read_means(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
