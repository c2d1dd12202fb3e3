"""Descriptions that the operators pass around; data itself stays in lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Name of the column that fixes the order of a table's rows.
ROW_ID = "_row_id"

#: Columns of a standardised event log.
STANDARD_CASE = "case:concept:name"
STANDARD_ACTIVITY = "concept:name"
STANDARD_TIME = "time:timestamp"

#: The feature vector of an event log, in order.
LOG_FEATURES = (
    "unique_case_count",
    "unique_activity_count",
    "avg_events_per_case",
    "variant_count",
    "avg_unique_acts_per_trace",
    "dfg_density",
)
#: The feature vector of a column, in order.
COLUMN_FEATURES = ("n_unique_ratio", "max_freq", "entropy", "sim", "std_length")


@dataclass(frozen=True)
class EventLogSpec:
    """Which columns of a table play the roles of an event log; ``order`` breaks ties and is the row order."""

    case: str
    activity: str
    timestamp: str | None = None
    order: tuple[str, ...] = (ROW_ID,)


@dataclass
class CandidateTable:
    """A table that may be an event log: ``path`` is event-level, event-level-multi or case-level-melt."""

    df: DataFrame
    timestamp: str
    path: str
    needs_candidates: bool
    case: str | None = None
    activity: str | None = None


@dataclass
class ValidationInfo:
    passed: bool
    messages: list[str] = field(default_factory=list)


@dataclass
class CombinationResult:
    """What was found out about one choice of columns; ``anomaly`` is the vote of the novelty tests."""

    timestamp: str | None
    case: str
    activity: str
    valid_share: float | None
    features: dict[str, float] | None
    tests: dict[str, dict]
    anomaly: bool
    validation: ValidationInfo
