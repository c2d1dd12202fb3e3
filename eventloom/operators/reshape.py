"""From one case per row to one event per row, and deciding whether that is needed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.timestamps import as_timestamp
from eventloom.model import ROW_ID, CandidateTable
from eventloom.operators.screening import Profiles, collect_profiles, primary_timestamp, screen_fields, timestamp_columns
from eventloom.sources.tables import first_rows, quoted

GATE_ROWS = 500
GATE_SECONDS = 120.0
GATE_SHORT = 0.8
GATE_IDENTICAL = 0.85
FILL_LEAST = 0.7
FILL_SPREAD = 0.3


def _alike(df: DataFrame, columns: list[str]) -> list[Column]:
    """Columns of one type: as they are if they agree, else as text."""
    kinds = {dict(df.dtypes)[c] for c in columns}
    return [F.col(quoted(c)) if len(kinds) == 1 else F.col(quoted(c)).cast("string").alias(c) for c in columns]


def _melted(df: DataFrame, case: Column, columns: list[str]) -> DataFrame:
    rows = df.select(case.alias("case"), *(c.alias(f"_t{i}") for i, c in enumerate(_alike(df, columns))))
    cells = F.array(*(F.struct(F.lit(c).alias("activity"), F.col(f"_t{i}").alias("timestamp")) for i, c in enumerate(columns)))
    return rows.select("case", F.inline(cells)).where("timestamp is not null").dropDuplicates(["case", "activity", "timestamp"])


def wide_to_long(df: DataFrame, timestamps: list[str], case: str) -> DataFrame:
    """``case, activity, timestamp``: one event per filled timestamp column, named after the column; no repeats."""
    return _melted(df, F.col(quoted(case)), timestamps)


def melt_case_level(df: DataFrame, timestamps: list[str]) -> DataFrame:
    """As :func:`wide_to_long` with each row a case of its own, named by the row order."""
    return _melted(df, F.col(ROW_ID), timestamps)


def case_id_candidates(df: DataFrame, profiles: Profiles, timestamps: list[str]) -> list[str]:
    """Screened columns that are no timestamps: those that may name a case."""
    return screen_fields(df, profiles, timestamps)


def table_type(df: DataFrame, profiles: Profiles | None = None) -> str:
    """``No`` (no timestamp), ``long`` or ``wide``.

    With three timestamps or more a table is wide if a candidate is unique in every row, or if all of them are
    mostly filled, and evenly so.
    """
    profiles = profiles or collect_profiles(df)
    timestamps = timestamp_columns(df, profiles)
    if len(timestamps) < 3:
        return "long" if timestamps else "No"
    whole = profiles.whole
    if any(whole[c]["n_unique"] == whole[c]["n_rows"] for c in case_id_candidates(df, profiles, timestamps)):
        return "wide"
    filled = [whole[c]["non_null"] for c in timestamps]
    n, mean = whole[timestamps[0]]["n_rows"], sum(filled) / len(filled)
    spread = (sum((x - mean) ** 2 for x in filled) / (len(filled) - 1)) ** 0.5 / (n + 1e-9)
    return "wide" if all(x > FILL_LEAST * n for x in filled) and spread < FILL_SPREAD else "long"


def ensure_long(df: DataFrame, candidates: list[str] | None = None, profiles: Profiles | None = None) -> DataFrame:
    """The table with one event per row; a wide one is melted on its best case column."""
    profiles = profiles or collect_profiles(df)
    kind = table_type(df, profiles)
    if kind == "No":
        raise ValueError("there is no timestamp column")
    if kind == "long":
        return df
    timestamps, whole = timestamp_columns(df, profiles), profiles.whole
    own = candidates or case_id_candidates(df, profiles, timestamps)
    if own:
        case = max(own, key=lambda c: whole[c]["n_unique"])
    else:
        named = [c for c in whole if "id" in c.lower() and c not in timestamps]
        if not named:
            raise ValueError("no column can name the cases of a wide table")
        case = max(named, key=lambda c: whole[c]["n_unique_ratio"])
    return wide_to_long(df, timestamps, case)


def interval_figures(df: DataFrame, timestamps: list[str]) -> DataFrame:
    """Over the first ``GATE_ROWS`` rows: gaps between a row's times in order, the share under ``GATE_SECONDS``, rows of equal times."""
    kinds = dict(df.dtypes)
    times = F.array_sort(F.filter(F.array(*(as_timestamp(F.col(quoted(c)), kinds[c]) for c in timestamps)), lambda t: t.isNotNull()))
    micros = F.transform(times, F.unix_micros)
    n = F.size(micros)
    # slices of several times only; the others have no gaps
    gaps = F.when(n > 1, F.zip_with(F.slice(micros, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(micros, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: (b - a) / 1e6))
    rows = first_rows(df, GATE_ROWS).select(gaps.alias("gaps"), (F.array_min(micros) == F.array_max(micros)).alias("same"))
    short = F.size(F.filter("gaps", lambda g: g < GATE_SECONDS))
    return rows.agg(
        F.coalesce(F.sum(F.when(F.col("gaps").isNotNull(), F.size("gaps"))), F.lit(0)).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("gaps").isNotNull(), short)), F.lit(0)).alias("short"),
        F.count_if(F.col("same") & F.col("gaps").isNotNull()).alias("identical"),
        F.count("*").alias("rows"),
    )


def passes_interval_gate(df: DataFrame, timestamps: list[str]) -> bool:
    """May a table be read as one case per row?  Not if most gaps are short or most rows hold one time only."""
    f = interval_figures(df, timestamps).first()
    return bool(f["gaps"]) and f["short"] / f["gaps"] <= GATE_SHORT and f["identical"] / f["rows"] <= GATE_IDENTICAL


def candidate_tables(df: DataFrame, profiles: Profiles | None = None) -> list[CandidateTable]:
    """Tables that may be an event log: the table itself, and its melted form if it has three timestamps and passes the gate."""
    profiles = profiles or collect_profiles(df)
    timestamps = timestamp_columns(df, profiles)
    best, _ = primary_timestamp(timestamps, profiles)
    if len(timestamps) < 3:
        return [CandidateTable(ensure_long(df, profiles=profiles), best, "event-level", True)]
    found = [CandidateTable(df, best, "event-level-multi", True)]
    if passes_interval_gate(df, timestamps):
        found.append(CandidateTable(melt_case_level(df, timestamps), "timestamp", "case-level-melt", False, "case", "activity"))
    return found


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, filled``: the share of rows in which each column has a value, from one pass."""
    counted = df.agg(*(F.avg(F.col(quoted(c)).isNotNull().cast("int")).alias(f"_{i}") for i, c in enumerate(columns)))
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("filled")) for i, c in enumerate(columns)]
    return counted.select(F.inline(F.array(*cells)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
