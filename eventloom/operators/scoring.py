"""Ranking columns as case or activity, and suggesting combinations."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.measures import min_max
from eventloom.operators.profile import column_features
from eventloom.operators.screening import DEFAULT_BLACKLIST, collect_profiles, least_null_timestamp, screen_fields, timestamp_columns, without_datetimes
from eventloom.sources.tables import first_rows

log = logging.getLogger(__name__)
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Weights:
    """Signed weights of the heuristic; negative ones apply to complements."""

    case_unique: float = 0.4
    case_freq: float = -0.2
    case_entropy: float = 0.2
    case_sim: float = -0.2
    act_unique: float = 0.3
    act_freq: float = 0.2
    act_entropy: float = -0.2
    act_sim: float = 0.3


def heuristic_scores(features: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``case_score`` and ``act_score`` of each column from its features, scaled to [0, 1] among the columns."""
    w = weights or Weights()
    scaled = features.select(
        "ordinal", "column", min_max(F.col("n_unique_ratio")).alias("u"), min_max(F.col("max_freq")).alias("f"), min_max(F.col("entropy")).alias("e"), min_max(F.col("sim")).alias("s")
    )
    u, f, e, s = map(F.col, "ufes")
    case = w.case_unique * u + w.case_freq * (1 - f) + w.case_entropy * e + w.case_sim * (1 - s)
    act = w.act_unique * (1 - F.abs(u - 0.1)) + w.act_freq * f + w.act_entropy * (1 - e) + w.act_sim * s
    return scaled.withColumn("case_score", case).withColumn("act_score", act)


def top_columns(scores: DataFrame, score: str, k: int = 2) -> list[str]:
    """The ``k`` best columns, best first; ties go to the earlier column."""
    return [r["column"] for r in scores.orderBy(F.col(score).desc(), "ordinal").limit(k).collect()]


def case_activity_combinations(cases: list[str], activities: list[str]) -> list[tuple[str, str]]:
    """Pairs of different columns, in order."""
    return [(c, a) for c, a in product(cases, activities) if c != a]


def suggest_columns(
    df: DataFrame,
    blacklist: tuple[str, ...] | None = None,
    weights: Weights | None = None,
    method: str = "baseline",
    classifiers=None,
    case_k: int = 2,
    act_k: int = 2,
    free_form: bool = False,
) -> list[tuple[str, str, str]]:
    """Combinations ``(timestamp, case, activity)`` worth a closer look, from the first ``SAMPLE_ROWS`` rows.

    ``baseline`` ranks by :func:`heuristic_scores`; with ``classifiers`` (see ``classify``) columns are ranked by
    their probabilities, and the best comes last, as ``k`` largest in ascending order.  Another method without classifiers
    falls back to ``baseline``, with a warning.  ``free_form`` recognises timestamps in no known pattern, by a general parser.
    """
    if method != "baseline" and classifiers is None:
        log.warning("there are no classifiers for method %r: columns are ranked by the heuristic", method)
        method = "baseline"
    sample = first_rows(df, SAMPLE_ROWS).cache()  # SAMPLE_ROWS rows at most
    try:
        profiles = collect_profiles(sample, free_form)
        timestamps = timestamp_columns(sample, profiles)
        if not timestamps:
            return []
        fields = screen_fields(sample, profiles, timestamps, DEFAULT_BLACKLIST if blacklist is None else blacklist)
        fields = without_datetimes(sample, fields, timestamps, profiles)
        if len(fields) < 2:
            return []
        features = column_features(sample, fields)
        if method == "baseline":
            scores = heuristic_scores(features, weights).cache()
            cases, activities = top_columns(scores, "case_score"), top_columns(scores, "act_score")
        else:
            scores = classifiers.score(features).cache()
            cases, activities = top_columns(scores, "p_case", case_k)[::-1], top_columns(scores, "p_activity", act_k)[::-1]
        scores.unpersist()
        best = least_null_timestamp(timestamps, profiles)
        return [(best, c, a) for c, a in case_activity_combinations(cases, activities) if best not in (c, a)]
    finally:
        sample.unpersist()
