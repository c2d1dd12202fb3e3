"""Deciding which columns can be timestamps, cases and activities.

Figures come from the two profiles of ``profile``; what follows is a few rules over one row per column.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.model import ROW_ID
from eventloom.operators.profile import column_profile, first_values, sample_profile, simple_columns
from eventloom.sources.tables import quoted

# Names (or parts of names) of columns that describe rather than identify.
DEFAULT_BLACKLIST = ("comment", "note", "description", "remark", "frequency")
DURATION_LIMIT = 0.3
DATETIME_LEAST = 0.6
FILLED_LEAST = 0.8
LONG_LIMIT = 0.1
LENGTH_LIMIT = 100
UNIQUE_LEAST = 3


@dataclass
class Profiles:
    """One dictionary per column from either job, by column name, in column order."""

    whole: dict[str, dict]
    sample: dict[str, dict]


def collect_profiles(df: DataFrame, free_form: bool = False) -> Profiles:
    """Both profiles; the driver gets one row per column from each.  ``free_form`` as in ``sample_profile``."""
    if not simple_columns(df):
        return Profiles({}, {})
    rows = lambda d: {r["column"]: r.asDict() for r in d.orderBy("ordinal").collect()}
    return Profiles(rows(column_profile(df)), rows(sample_profile(first_values(df, 50), free_form)))


def is_duration_column(sample: dict | None, field: str = "duration_share") -> bool:
    return sample is not None and (sample[field] or 0.0) > DURATION_LIMIT


def timestamp_columns(df: DataFrame, profiles: Profiles) -> list[str]:
    """Columns that hold points in time: not durations, and at least ``DATETIME_LEAST`` of the first values read as such.

    Of three or more, the largest group written alike stays (the first seen of equal groups).
    """
    native = {f.name: isinstance(f.dataType, T.DateType) for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))}
    found = [
        c for c in profiles.whole
        if (s := profiles.sample.get(c)) and not is_duration_column(s, "duration_share_30") and (c in native or s["datetime_share"] >= DATETIME_LEAST)
    ]
    return found if len(found) < 3 else _written_alike(found, profiles, native)


def _written_alike(columns: list[str], profiles: Profiles, native: dict[str, bool]) -> list[str]:
    """The columns whose signature (length, dashes, spaces) most of them share; of equally common ones, that of the earliest column.

    ``native`` columns, by whether they are dates, are alike whatever values they hold (as text a fraction loses its last zeros): all have
    the largest figures among them.
    """
    signature = {c: tuple(profiles.sample[c][k] for k in ("first_length", "dashes", "spaces")) for c in columns}
    for dates in (False, True):
        same = [c for c in columns if native.get(c) is dates]
        signature |= dict.fromkeys(same, tuple(map(max, zip(*(signature[c] for c in same)))))
    often = Counter(signature.values())
    usual = max(often, key=often.get)  # a Counter keeps the order in which signatures were met
    return [c for c in columns if signature[c] == usual]


def without_datetimes(df: DataFrame, columns: list[str], timestamps: list[str], profiles: Profiles) -> list[str]:
    """Leave out timestamp columns, and text columns all of whose first values read as points in time."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    known = {t.lower() for t in timestamps}

    def stays(c: str) -> bool:
        s = profiles.sample.get(c)
        return c in numeric or (c.lower() not in known and (s is None or not s["n_20"] or s["datetimes_20"] < s["n_20"]))

    return [c for c in columns if stays(c)]


def duplicate_columns(df: DataFrame) -> dict[str, str]:
    """Columns whose texts equal an earlier column's in every row (null reads as "-9999"), and that column.

    One pass gives an order-sensitive fingerprint of each column; those that agree are compared exactly in a second.
    """
    columns = simple_columns(df)
    if not columns:
        return {}
    text = {c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit("-9999")) for c in columns}
    prints = df.agg(*(F.sum(F.xxhash64(ROW_ID, text[c]).cast("decimal(20,0)")).alias(f"f{i}") for i, c in enumerate(columns))).first()
    same: dict[object, list[str]] = {}
    for c, value in zip(columns, prints):
        same.setdefault(value, []).append(c)
    pairs = [(group[0], c) for group in same.values() for c in group[1:]]
    if not pairs:
        return {}
    differing = df.agg(*(F.count_if(text[a] != text[b]).alias(f"d{i}") for i, (a, b) in enumerate(pairs))).first()
    return {b: a for (a, b), n in zip(pairs, differing) if n == 0}


def screen_fields(df: DataFrame, profiles: Profiles, timestamps: list[str], blacklist: tuple[str, ...] = DEFAULT_BLACKLIST, remove_duplicates: bool = True) -> list[str]:
    """Columns that may be a case or an activity, in column order.

    Left out, in this order: copies of other columns, black-listed names, timestamps, durations, types other than text
    and numbers, sparse columns, columns of few values, of mixed types, and texts that are long in words or characters.
    """
    copies = duplicate_columns(df) if remove_duplicates else {}
    listed, known = [b.lower() for b in blacklist], {t.lower() for t in timestamps}
    kinds = {f.name: f.dataType for f in df.schema}
    out = []
    for c, whole in profiles.whole.items():
        sample = profiles.sample.get(c)
        text = isinstance(kinds[c], (T.StringType, T.VarcharType, T.CharType))
        if c in copies or any(b in c.lower() for b in listed) or c.lower() in known or is_duration_column(sample, "duration_share_30"):
            continue
        if not text and not (isinstance(kinds[c], T.NumericType) and not isinstance(kinds[c], T.DecimalType)):
            continue
        if whole["non_null"] < FILLED_LEAST * whole["n_rows"] or whole["n_unique"] < UNIQUE_LEAST or sample is None or sample["kinds"] > 1:
            continue
        if text and (whole["long_share"] >= LONG_LIMIT or whole["max_length"] >= LENGTH_LIMIT):
            continue
        out.append(c)
    return out


def primary_timestamp(columns: list[str], profiles: Profiles) -> tuple[str, float]:
    """The column with the most distinct values less half its nulls, the first of equals; a single one scores 0."""
    if not columns:
        raise ValueError("there is no timestamp column")
    if len(columns) == 1:
        return columns[0], 0.0
    scores = [(c, p["n_unique"] - 0.5 * (p["n_rows"] - p["non_null"])) for c in columns for p in [profiles.whole[c]]]
    return max(scores, key=lambda x: x[1])


def least_null_timestamp(columns: list[str], profiles: Profiles) -> str | None:
    """The first of three or more; else the one with the fewest nulls."""
    if not columns:
        return None
    if len(columns) >= 3:
        return columns[0]
    return min(columns, key=lambda c: profiles.whole[c]["n_rows"] - profiles.whole[c]["non_null"])
