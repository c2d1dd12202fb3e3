"""Recognising and parsing timestamps and durations in text, as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that are tried, in order; day first where a date is ambiguous.
PATTERNS = (
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d",
    "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s[XXX][XX][X]",
    "yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy-M-d H:m", "yyyy/M/d H:m",
    "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d H:m:s[XXX][XX][X]",
    "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "M.d.yyyy",
    "d/M/yyyy H:m", "M/d/yyyy H:m", "d/M/yyyy H:m:s", "M/d/yyyy H:m:s", "d.M.yyyy H:m:s",
    "d/M/yy", "M/d/yy", "d-M-yy", "M-d-yy", "d.M.yy", "M.d.yy",
    "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyy-M-d'T'H:m:s.SSSSSSX", "yyyy-M-d H:m:s.SSSSSSXXX",
)
UNIX_KEYWORDS = ("unix", "time", "timestamp", "epoch")
DURATION_KEYWORDS = ("day", "hour", "minute", "second", "week", "month", "timedelta")
YEARS = (2000, 2050)
DURATION = r"^-?\d+\s+days?\s+\d{2}:\d{2}:\d{2}|^\d{2}:\d{2}:\d{2}$"


_PARTS = re.compile(r"'([^']*)'|\[[^]]*\]|yyyy|([A-Za-z])\2*|.")


def shape_of(pattern: str) -> str:
    """A regular expression that every text fits which can be read under ``pattern``."""

    def part(m: re.Match) -> str:
        token = m[0]
        if token[0] == "'":
            return re.escape(m[1])
        if token[0] == "[" or token[0] == "X":
            return r"\S*"
        if not token[0].isalpha():
            return re.escape(token)
        return r"[+-]?\d{4,}" if token == "yyyy" else r"[^\d\s]+" if len(token) > 2 and token[0] == "M" else r"\d+"

    return f"^{_PARTS.sub(part, pattern)}$"


def parse(text: Column) -> Column:
    """The timestamp that a text means under the first pattern that fits, else null.

    A pattern is only tried on texts of its shape, since failing to parse is far slower than not to match.
    """
    text = F.trim(text)
    return F.coalesce(*(F.when(text.rlike(shape_of(p)), F.try_to_timestamp(text, F.lit(p))) for p in PATTERNS))


def as_timestamp(value: Column, kind: str) -> Column:
    """A column of any type as a timestamp: dates and timestamps are cast, text is parsed, anything else is null."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return value.cast("timestamp")
    return parse(value) if kind == "string" else F.lit(None).cast("timestamp")


def _name_says(name: Column, keywords: tuple[str, ...]) -> Column:
    return F.lower(name).rlike("|".join(keywords))


def is_unix_time(text: Column, name: Column) -> Column:
    """Ten digits (seconds) or thirteen (milliseconds) of a plausible year, in a column whose name speaks of time."""
    number = F.when(F.length(text) == 13, F.floor(text.cast("bigint") / 1000)).otherwise(text.cast("bigint"))
    return _name_says(name, UNIX_KEYWORDS) & F.year(F.timestamp_seconds(number)).between(*YEARS)


def reads_as_date(text: Column) -> Column:
    """Does a general date parser make sense of a text?  In Python, an Arrow batch at a time: for a few values."""

    @F.pandas_udf("boolean")
    def readable(texts: pd.Series) -> pd.Series:
        from dateutil import parser

        def one(text: str | None) -> bool:
            if text is None:
                return False
            try:
                if not pd.isna(pd.to_datetime(text, errors="coerce")):
                    return True
                parser.parse(text)
            except (ValueError, OverflowError, TypeError):
                return False
            return True

        return texts.map(one)

    return readable(text)


def is_datetime(value: Column, name: Column, free_form: bool = False) -> Column:
    """Does a text look like a point in time?  Null and empty do not.

    With ``free_form``, texts that fit no pattern are given to a general parser.
    """
    text = F.trim(value)
    able = (F.length(text) >= 6) & (text.rlike(r"[-/:.T ]") | text.rlike(r"^\d+$"))
    fits = parse(text).isNotNull()
    plain = able & (fits | reads_as_date(F.when(able & ~fits, text)) if free_form else fits)
    unix = text.rlike(r"^(\d{10}|\d{13})$")
    empty = value.isNull() | (text == "") | (F.lower(text) == "nan")
    return F.when(empty, False).when(unix, is_unix_time(text, name)).otherwise(plain)


def is_duration(value: Column) -> Column:
    """Does a text look like a duration, ``1 days 02:03:04`` or ``02:03:04``?"""
    return F.coalesce(value.rlike(DURATION), F.lit(False))


def speaks_of_duration(value: Column) -> Column:
    """A duration, or a text that mentions a unit of time."""
    return is_duration(value) | F.coalesce(F.lower(value).rlike("|".join(DURATION_KEYWORDS)), F.lit(False))
