"""The public functions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventloom.model import EventLogSpec
from eventloom.operators.scoring import suggest_columns
from eventloom.operators.traces import log_statistics, standard_log
from eventloom.operators.validate import validate_event_log
from eventloom.sources.catalog import search_data_platform
from eventloom.sources.tables import with_row_id

__all__ = ["convert_to_event_log", "get_event_log_statistic", "search_data_platform", "suggest_mandatory_column_candidates", "validate_event_log"]


def suggest_mandatory_column_candidates(df: DataFrame, **options) -> list[tuple[str, str, str]]:
    """Combinations (timestamp, case, activity) that the columns suggest."""
    return suggest_columns(with_row_id(df), **options)


def get_event_log_statistic(df: DataFrame, case: str, activity: str, timestamp: str | None = None) -> dict:
    """The log's statistics as a dictionary."""
    return log_statistics(with_row_id(df), EventLogSpec(case, activity, timestamp)).first().asDict()


def convert_to_event_log(df: DataFrame, case: str, activity: str, timestamp: str) -> DataFrame:
    """The log's three columns under their standard names."""
    return standard_log(df, case, activity, timestamp)
