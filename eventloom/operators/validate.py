"""Is a table an event log?  Candidate tables, combinations of columns, structural rules and novelty tests together."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.timestamps import as_timestamp
from eventloom.model import LOG_FEATURES, ROW_ID, CombinationResult, EventLogSpec
from eventloom.operators import novelty
from eventloom.operators.reshape import candidate_tables
from eventloom.operators.scoring import case_activity_combinations, suggest_columns
from eventloom.operators.traces import validated_features
from eventloom.sources.tables import quoted, with_row_id

log = logging.getLogger(__name__)
ALL_TESTS = ("lof", "isoforest", "ocsvm", "dbscan")


def evaluate_combination(
    df: DataFrame,
    case: str,
    activity: str,
    timestamp: str | None,
    matrix: DataFrame | None = None,
    tests: tuple[str, ...] = ("lof",),
    vote: str = "majority",
    raw_order: bool = False,
) -> CombinationResult:
    """Features, structural validation and novelty of one choice of columns.

    Text timestamps are parsed for the order of events, or left to sort as text with ``raw_order``.  Without a
    matrix (``id`` and the log features), or with a feature missing, no test runs.
    """
    order = (ROW_ID,) if ROW_ID in df.columns else (case, activity)
    if timestamp and not raw_order and dict(df.dtypes)[timestamp] == "string":
        df = df.withColumn(timestamp, F.coalesce(as_timestamp(F.col(quoted(timestamp)), "string").cast("string"), F.col(quoted(timestamp))))
    features, share, info = validated_features(df, EventLogSpec(case, activity, timestamp, order))
    if features is None:
        return CombinationResult(timestamp, case, activity, share, None, {}, False, info)
    found = features.select(*LOG_FEATURES).first().asDict()
    outcome: dict[str, dict] = {}
    if matrix is not None and all(v is not None for v in found.values()):
        point = df.sparkSession.createDataFrame([("new", *(float(found[c]) for c in LOG_FEATURES))], "id string, " + ", ".join(f"{c} double" for c in LOG_FEATURES))
        known = matrix.select(F.col("id").cast("string").alias("id"), *LOG_FEATURES)
        outcome = {r["test"]: {"score": r["score"], "outlier": r["outlier"]} for r in novelty.run_tests(known, point, tests).collect()}
    return CombinationResult(timestamp, case, activity, share, found, outcome, _voted([t["outlier"] for t in outcome.values()], vote), info)


def _voted(flags: list[bool], kind: str) -> bool:
    n, k = len(flags), sum(flags)
    if not n:
        return False
    return {"majority": k >= n // 2 + 1, "all": k == n, "any": k > 0, "half": k >= n // 2}.get(kind, False)


def evaluate_combinations(df: DataFrame, cases: list[str], activities: list[str], timestamps: list[str], **options) -> list[CombinationResult]:
    """Each pair of case and activity with the first timestamp."""
    time = timestamps[0] if timestamps else None
    return [evaluate_combination(df, c, a, time, **options) for c, a in case_activity_combinations(cases, activities)]


def combination_results(df: DataFrame, results: list[CombinationResult]) -> DataFrame:
    """A row per evaluated combination: its columns, share of valid traces, verdict, features, and the tests' vote."""
    kinds = ", ".join(f"{c} double" for c in LOG_FEATURES)
    figure = lambda r, c: None if r.features is None or r.features[c] is None else float(r.features[c])
    rows = [(r.timestamp, r.case, r.activity, r.valid_share, r.validation.passed, r.anomaly, *(figure(r, c) for c in LOG_FEATURES)) for r in results]
    return df.sparkSession.createDataFrame(rows, f"timestamp string, case string, activity string, valid_share double, passed boolean, anomaly boolean, {kinds}")


def validate_event_log(
    df: DataFrame,
    candidates: list[tuple[str, str, str]] | None = None,
    matrix: DataFrame | None = None,
    tests: tuple[str, ...] = ALL_TESTS,
    vote: str = "half",
    method: str = "baseline",
    classifiers=None,
    strict: bool = False,
) -> tuple[bool, list[dict[str, str]]]:
    """Does some combination of columns make the table an event log, and which?

    A combination is accepted if it is structurally valid, and with ``strict`` if the tests find no anomaly besides.
    ``candidates`` (timestamp, case, activity) are evaluated as given instead of being searched for.
    """
    df = with_row_id(df)
    if candidates is not None:
        plans = [(df, candidates)]
    else:
        try:
            tables = candidate_tables(df)
        except ValueError:
            return False, []
        plans = []
        for table in tables:
            if table.needs_candidates:
                plans.append((table.df, suggest_columns(table.df, method=method, classifiers=classifiers)))
            else:
                plans.append((table.df, [(table.timestamp, table.case, table.activity)]))
    accepted = []
    for table, combinations in plans:
        for time, case, activity in combinations:
            result = evaluate_combination(table, case, activity, time, matrix, tests if strict else (), vote)
            if result.validation.passed and not (strict and result.anomaly):
                accepted.append({"timestamp": time, "case": case, "activity": activity})
    return bool(accepted), accepted
