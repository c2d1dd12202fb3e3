"""Event logs: statistics, variants, edges, validation, on logs small enough to count by hand."""

import pytest

from eventloom.model import EventLogSpec
from eventloom.operators import traces

SPEC = EventLogSpec("c", "a", "t", ("i",))
ROWS = [  # case a: x y x; case b: x x; case c: y; a null case; null activities count as a token in traces
    (0, "A", "x", 1), (1, "B", "x", 1), (2, "A", "y", 2), (3, "C", "y", 1), (4, "A", "x", 3), (5, "B", "x", 2), (6, None, "x", 1), (7, "D", None, 1), (8, "D", "z", 2),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, "i long, c string, a string, t long")


def test_statistics(log):
    got = traces.log_statistics(log, SPEC).first().asDict()
    assert got["num_cases"] == 4 and got["num_activities"] == 3 and got["num_variants"] == 4
    assert got["avg_trace_length"] == 2.0 and got["variant_ratio"] == 1.0
    # edges: xy, yx, xx, (null)z; the single event of case C has none
    assert got["dfg_density"] == pytest.approx(4 / 9)
    assert got["uniqueness"] == pytest.approx(3 / 9)


def test_without_time_there_is_no_density(log):
    assert traces.log_statistics(log, EventLogSpec("c", "a", None, ("i",))).first()["dfg_density"] is None


def test_empty_log(spark):
    got = traces.log_statistics(spark.createDataFrame([], "i long, c string, a string, t long"), SPEC).first()
    assert got["num_cases"] == 0 and got["variant_ratio"] == 0 and got["uniqueness"] is None


def test_traces_keep_nulls(log):
    got = {r["case"]: r["trace"] for r in traces.traces(traces.events(log, SPEC)).collect()}
    assert got == {"A": ["x", "y", "x"], "B": ["x", "x"], "C": ["y"], "D": [None, "z"]}


def test_edges(log):
    got = {(r["act"], r["next_act"]): r["n"] for r in traces.dfg_edges(traces.events(log, SPEC)).collect()}
    assert got == {("x", "y"): 1, ("y", "x"): 1, ("x", "x"): 1, (None, "z"): 1}


def test_first_per_case_and_time(spark):
    df = spark.createDataFrame([(2, "A", "q", 1), (1, "A", "p", 1), (3, "A", "r", None), (4, "A", "s", None)], "i long, c string, a string, t long")
    got = {r["act"] for r in traces.first_per_case_time(traces.events(df, SPEC)).collect()}
    assert got == {"p", "r"}


def test_variant_fingerprints_tell_orders_apart(spark):
    df = spark.createDataFrame([(0, "A", "x", 1), (1, "A", "y", 2), (2, "B", "y", 1), (3, "B", "x", 2), (4, "C", "x", 5), (5, "C", "y", 6)], "i long, c string, a string, t long")
    found = traces.variant_counts(traces.events(df, SPEC)).collect()
    assert sorted(r["cases"] for r in found) == [1, 2]


@pytest.mark.parametrize("valid, passed", [(3, True), (2, False)])
def test_valid_share_at_the_bound(spark, valid, passed):
    rows = [(10 * c + k, f"c{c}", "ab"[k], k) for c in range(valid) for k in range(2)] + [(1000 + c, f"s{c}", "a", 0) for c in range(10 - valid)]
    features, share, info = traces.validated_features(spark.createDataFrame(rows, "i long, c string, a string, t long"), SPEC)
    assert share == pytest.approx(valid / 10) and info.passed is passed and len(info.messages) == 1
    assert features.first()["unique_case_count"] == valid


def test_invalid_logs_have_no_features(spark):
    single = spark.createDataFrame([(0, "A", "x", 1), (1, "B", "y", 1)], "i long, c string, a string, t long")
    same = spark.createDataFrame([(0, "A", "x", 1), (1, "A", "x", 2)], "i long, c string, a string, t long")
    for df, word in ((single, "event"), (same, "activity")):
        features, _, info = traces.validated_features(df, SPEC)
        assert features is None and not info.passed and word in info.messages[0]


def test_standard_log_checks_columns(log):
    assert traces.standard_log(log, "c", "a", "t").columns == ["case:concept:name", "concept:name", "time:timestamp"]
    with pytest.raises(ValueError, match="nope"):
        traces.standard_log(log, "c", "nope", "t")


def test_statistics_do_not_depend_on_partitions(log):
    again = log.repartition(7, "a")
    assert traces.log_statistics(log, SPEC).first() == traces.log_statistics(again, SPEC).first()


def test_many_logs_in_one_plan(log):
    from pyspark.sql import functions as F

    both = log.withColumn("file", F.lit("one")).unionByName(log.where("c in ('A', 'B')").withColumn("file", F.lit("two")))
    got = {r["file"]: r for r in traces.offline_features(both, SPEC).collect()}
    assert got["one"]["unique_case_count"] == 2 and got["one"]["valid_trace_percentage"] == pytest.approx(0.5)
    assert got["two"]["unique_case_count"] == 1 and got["two"]["dfg_density"] == pytest.approx(2 / 4)


@pytest.mark.parametrize("by_time", [True, False])
def test_figures_against_plain_loops(spark, by_time):
    """Random logs with nulls and ties, several in one table, counted case by case."""
    import random

    rnd = random.Random(5)
    rows = [(i, rnd.choice("pq"), rnd.choice([None, *"ABCDEFG"]), rnd.choice([None, "x", "y", "z", "x" * 300]), rnd.choice([None, 1, 2, 3, 4])) for i in range(400)]
    log = traces.events(spark.createDataFrame(rows, "i long, file string, c string, a string, t long"), SPEC, ("file",))
    got = {r["file"]: r for r in traces.features_of(log, ("file",), by_time=by_time).collect()}
    late = lambda r: (r[4] is None, r[4] or 0, r[0])
    for file in "pq":
        own = [r for r in rows if r[1] == file]
        cases: dict = {}
        for r in own:
            if r[2] is not None:
                cases.setdefault(r[2], []).append(r)
        timed = {c: [r[3] for r in sorted(x, key=late)] for c, x in cases.items()}
        told = timed if by_time else {c: [r[3] for r in sorted(x)] for c, x in cases.items()}
        edges = {(a, b) for t in timed.values() for a, b in zip(t, t[1:])}
        acts = len({r[3] for r in own} - {None})
        r = got[file]
        assert (r["unique_case_count"], r["variant_count"], r["unique_activity_count"], r["total_event_count"]) == (len(cases), len(set(map(tuple, told.values()))), acts, len(own))
        assert r["avg_events_per_case"] == pytest.approx(sum(map(len, cases.values())) / len(cases))
        assert r["avg_unique_acts_per_trace"] == pytest.approx(sum(len(set(t)) for t in timed.values()) / len(cases))
        assert r["dfg_density"] == pytest.approx(len(edges) / acts**2)


def test_statistics_take_one_scan_and_one_exchange_on_the_case(spark, sf_dir):
    from eventloom.plans import catalogue

    df = catalogue.queries()["log_statistics_events"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning(case") == 1 and plan.count("Exchange") <= 3
