"""Profiles, recognisers, screening, reshaping and scoring, at their thresholds."""

import math
import statistics
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from eventloom.functions import measures, timestamps
from eventloom.model import ROW_ID
from eventloom.operators import profile, reshape, scoring, screening
from eventloom.sources.tables import nan_to_null, with_row_id


def frame(spark, columns: dict[str, list], kinds: str):
    rows = list(zip(range(len(next(iter(columns.values())))), *columns.values()))
    return spark.createDataFrame(rows, f"{ROW_ID} long, {kinds}")


@pytest.mark.parametrize(
    "text, name, expected",
    [
        ("2020-01-05", "x", True), ("2020-1-5", "x", True), ("2020-01-05T10:11:12", "x", True), ("2020-01-05 10:11:12.123456", "x", True), ("2020-01-05T10:11:12+01:00", "x", True),
        ("5/1/2020", "x", True), ("13.1.2020", "x", True), ("1/13/20", "x", True), ("20200101", "x", True), ("1600000000", "unix_time", True), ("1600000000", "phone", False),
        ("1600000000000", "epoch", True), ("0100000000", "timestamp", False), ("abc", "x", False), ("12345", "x", False), ("123456", "x", False), ("nan", "time", False), ("", "x", False),
        (None, "time", False), ("12:30:00", "x", False), ("hello world", "x", False),
    ],
)
def test_datetime_like(spark, text, name, expected):
    df = spark.createDataFrame([(text, name)], "v string, n string")
    assert df.select(timestamps.is_datetime(F.col("v"), F.col("n"))).first()[0] is expected


@pytest.mark.parametrize("text, expected", [("1 days 02:03:04", True), ("-3 day 00:00:01.5", True), ("12:30:00", True), ("12:30", False), (None, False)])
def test_durations(spark, text, expected):
    assert spark.createDataFrame([(text,)], "v string").select(timestamps.is_duration(F.col("v"))).first()[0] is expected


@pytest.mark.parametrize("text, kind", [("1", "int"), ("1.0", "int"), ("1.5", "float"), ("x", "str"), ("inf", "float"), ("nan", "float"), ("1_0", "int")])
def test_kinds(spark, text, kind):
    assert spark.createDataFrame([(text,)], "v string").select(measures.kind_of(F.col("v"))).first()[0] == kind


def test_word_count(spark):
    df = spark.createDataFrame([("",), ("  a b ",), ("a\tb\nc",)], "v string")
    assert [r[0] for r in df.select(measures.word_count(F.col("v"))).collect()] == [0, 2, 3]


def test_profile_against_python(spark):
    values = ["a", "bb", "a", None, "cccc", "bb", "a", "one two three four five six seven"]
    got = profile.column_profile(frame(spark, {"v": values}, "v string")).first()
    there = [v for v in values if v is not None]
    shares = [n / len(there) for n in Counter(there).values()]
    assert (got["n_rows"], got["non_null"], got["n_unique"]) == (8, 7, 4)
    assert got["max_freq"] == 3 / 8 and got["long_share"] == 1 / 8
    assert got["entropy"] == pytest.approx(-sum(p * math.log2(p + 1e-9) for p in shares))
    assert got["std_length"] == pytest.approx(statistics.pstdev(map(len, there)))


def test_similarity_is_the_mean_over_sorted_pairs(spark):
    words = ["tide", "diet", "edit"]
    expected = statistics.mean(SequenceMatcher(None, a, b).ratio() for a, b in combinations(sorted(words), 2))
    assert measures.mean_similarity(words) == pytest.approx(expected)
    assert measures.mean_similarity(["x"]) == 1.0
    got = profile.column_features(frame(spark, {"v": words, "w": ["x"] * 3}, "v string, w string")).orderBy("ordinal").collect()
    assert got[0]["sim"] == pytest.approx(expected) and got[1]["sim"] == 1.0


def test_nan_counts_as_null(spark):
    df = with_row_id(nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")))
    assert profile.column_profile(df).first()["non_null"] == 1


def test_screening(spark):
    n = 50
    df = frame(
        spark,
        {
            "ticket": [f"T{i}" for i in range(n)], "status": [["open", "closed", "held"][i % 3] for i in range(n)], "changed_at": [f"2020-01-{1 + i % 28:02d} 10:00:00" for i in range(n)],
            "unix_time": [1600000000 + i for i in range(n)], "duration": [f"{i} days 01:02:03" for i in range(n)], "weekday": [["Monday", "Tuesday", "Friday"][i % 3] for i in range(n)],
            "comment": [f"note {i}" for i in range(n)], "amount": [1.0 if i % 2 else i + 0.5 for i in range(n)], "flag": [i % 2 == 0 for i in range(n)],
            "sparse": [None if i < 11 else f"s{i}" for i in range(n)], "copy": [f"T{i}" for i in range(n)], "two": [str(i % 2) + "x" for i in range(n)],
        },
        "ticket string, status string, changed_at string, unix_time long, duration string, weekday string, comment string, amount double, flag boolean, sparse string, copy string, two string",
    )
    profiles = screening.collect_profiles(df)
    times = screening.timestamp_columns(df, profiles)
    assert times == ["changed_at", "unix_time"]
    assert screening.screen_fields(df, profiles, times) == ["ticket", "status"]
    assert "copy" in screening.screen_fields(df, profiles, times, remove_duplicates=False)
    assert screening.primary_timestamp(times, profiles)[0] == "unix_time"
    assert screening.least_null_timestamp(times, profiles) == "changed_at"
    assert screening.without_datetimes(df, ["ticket", "changed_at"], times, profiles) == ["ticket"]


@pytest.mark.parametrize("dated, found", [(6, True), (5, False)])
def test_timestamp_share_at_the_bound(spark, dated, found):
    df = frame(spark, {"v": ["2020-01-01"] * dated + ["n/a"] * (10 - dated)}, "v string")
    assert (screening.timestamp_columns(df, screening.collect_profiles(df)) == ["v"]) is found


@pytest.mark.parametrize("timed, rejected", [(3, False), (4, True)])
def test_duration_share_at_the_bound(spark, timed, rejected):
    df = frame(spark, {"v": ["12:00:00"] * timed + ["x"] * (10 - timed)}, "v string")
    assert screening.is_duration_column(screening.collect_profiles(df).sample["v"]) is rejected


def test_duplicates_with_nulls(spark):
    df = frame(spark, {"a": ["1", None], "b": [1, -9999], "c": ["1", "2"]}, "a string, b long, c string")
    assert screening.duplicate_columns(df) == {"b": "a"}


def wide(spark, n=10, gap=600.0):
    import datetime as dt

    start = dt.datetime(2020, 1, 1)
    columns = {"id": list(range(n))} | {c: [str(start + dt.timedelta(days=i, seconds=k * gap)) for i in range(n)] for k, c in enumerate(("made", "sent", "done"))}
    return frame(spark, columns, "id long, made string, sent string, done string")


def test_wide_tables(spark):
    df = wide(spark)
    assert reshape.table_type(df) == "wide"
    long = reshape.ensure_long(df)
    assert long.columns == ["case", "activity", "timestamp"] and long.count() == 30
    assert [c.path for c in reshape.candidate_tables(df)] == ["event-level-multi", "case-level-melt"]


def test_native_times_are_alike_whatever_their_fractions(spark):
    """As text a timestamp loses the zeros at the end of its fraction; that, or a null, is no other format."""
    import datetime as dt

    at = lambda i, micros: dt.datetime(2024, 1, 1 + i, 2, 3, 4, micros)
    columns = {"id": [1, 2, 3], "made": [at(i, 172425) for i in range(3)], "sent": [at(i, 50560) for i in range(3)], "done": [at(0, 0), None, at(2, 1)], "day": [at(i, 0).date() for i in range(3)]}
    df = frame(spark, columns, "id long, made timestamp, sent timestamp, done timestamp_ntz, day date")
    assert screening.timestamp_columns(df, screening.collect_profiles(df)) == ["made", "sent", "done"]
    assert {(r["case"], r["activity"]) for r in reshape.ensure_long(df).collect()} == {(1, "made"), (2, "made"), (3, "made"), (1, "sent"), (2, "sent"), (3, "sent"), (1, "done"), (3, "done")}


@pytest.mark.parametrize("gap, passes", [(120.0, True), (119.0, False), (0.0, False)])
def test_interval_gate_at_the_bound(spark, gap, passes):
    assert reshape.passes_interval_gate(wide(spark, gap=gap), ["made", "sent", "done"]) is passes


def test_melt_drops_nulls_and_repeats(spark):
    df = frame(spark, {"id": [1, 1, 2], "a": ["x", "x", None], "b": [None, "y", "z"]}, "id long, a string, b string")
    got = {tuple(r) for r in reshape.wide_to_long(df, ["a", "b"], "id").collect()}
    assert got == {(1, "a", "x"), (1, "b", "y"), (2, "b", "z")}
    assert reshape.melt_case_level(df, ["a", "b"]).count() == 4


def test_no_timestamp(spark):
    df = frame(spark, {"a": ["x", "y"]}, "a string")
    assert reshape.table_type(df) == "No"
    with pytest.raises(ValueError):
        reshape.ensure_long(df)
    with pytest.raises(ValueError):
        reshape.candidate_tables(df)


def test_heuristic_scores(spark):
    df = spark.createDataFrame([(0, "id", 1.0, 0.1, 3.0, 0.2), (1, "act", 0.0, 0.5, 1.0, 0.8)], "ordinal int, column string, n_unique_ratio double, max_freq double, entropy double, sim double")
    got = {r["column"]: r for r in scoring.heuristic_scores(df).collect()}
    assert got["id"]["case_score"] == pytest.approx(0.4 - 0.2 + 0.2 - 0.2)
    assert got["act"]["act_score"] == pytest.approx(0.3 * 0.9 + 0.2 - 0.2 + 0.3)


def test_suggestions(spark):
    n = 60
    df = frame(
        spark,
        {"ticket": [f"T{i // 3}" for i in range(n)], "status": [["open", "closed", "held"][i % 3] for i in range(n)], "at": [f"2020-01-{1 + i % 28:02d} 10:00:00" for i in range(n)]},
        "ticket string, status string, at string",
    )
    assert ("at", "ticket", "status") in scoring.suggest_columns(df)
    assert scoring.suggest_columns(df.drop("at")) == []


def test_shapes_hide_no_reading(spark):
    """Trying a pattern only on texts of its shape changes nothing."""
    import random

    from eventloom.functions import timestamps

    rnd = random.Random(3)
    moments = ["2024-03-05 07:08:09.123456", "1999-12-31 23:59:59", "2031-01-01 00:00:00"]
    written = spark.createDataFrame([(m,) for m in moments], "m string").select(F.col("m").cast("timestamp").alias("t"))
    forms = [p.replace("[XXX][XX][X]", z) for p in timestamps.PATTERNS for z in ("", "XXX", "X")]
    texts = {r[0] for p in forms for r in written.select(F.date_format("t", p)).collect()}
    texts |= {"", "x", "12", "2024-3-5", "2024-13-45", "5 Mar 2024", "March 5, 2024", "+12024-01-01", "2024-01-01T", "10:11:12", "2024-1-1 1:2", "٢٠٢٤-٠١-٠١"}
    for text in list(texts):
        for _ in range(3):
            if text:
                i = rnd.randrange(len(text))
                texts.add(text[:i] + rnd.choice(" -/:.T0129a+") + text[i + rnd.randint(0, 1) :])
    df = spark.createDataFrame([(x,) for x in sorted(texts)], "x string")
    plain = F.coalesce(*(F.try_to_timestamp(F.trim("x"), F.lit(p)) for p in timestamps.PATTERNS))
    differing = df.select("x", plain.alias("a"), timestamps.parse(F.col("x")).alias("b")).where("not a <=> b").select("x").collect()
    assert not differing and len(texts) > 200


def test_free_form_times_are_an_option(spark):
    from eventloom.functions import timestamps
    from eventloom.operators import scoring

    texts = ["Tue Mar 5 07:08:09 2024", "5th of March 2024", "2024-03-05", "not a date", "", None, "123456", "hello 12"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    found = lambda free: [r[0] for r in df.select(timestamps.is_datetime(F.col("value"), F.lit("when"), free)).collect()]
    assert found(False) == [False, False, True, False, False, False, False, False]
    assert found(True)[:7] == [True, True, True, False, False, False, False]
    rows = [(i, f"c{i % 9}", "abcde"[i % 5] * 3, f"Tue Mar {i % 28 + 1} 07:08:09 2024") for i in range(60)]
    log = spark.createDataFrame(rows, "_row_id long, customer string, status string, moment string")
    assert scoring.suggest_columns(log) == [] and scoring.suggest_columns(log, free_form=True)
