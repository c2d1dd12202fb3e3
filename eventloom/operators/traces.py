"""Event logs: traces, variants, directly-follows edges, statistics and structural validation.

The figures of a log come from one scan and one exchange on the case: windows over it give positions, successors
and running fingerprints of the trace (two order-aware hashes instead of an array), each event then says what
it adds (an activity, an edge, at its case's last event a variant), and these are counted with map-side
combination.  A very long case therefore sorts on disk and never has to fit in memory; events without a case are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.model import LOG_FEATURES, STANDARD_ACTIVITY, STANDARD_CASE, STANDARD_TIME, EventLogSpec, ValidationInfo
from eventloom.sources.tables import quoted

#: Least share of traces that must be valid.
VALID_SHARE = 0.3


def standard_log(df: DataFrame, case: str, activity: str, timestamp: str) -> DataFrame:
    """The three columns under their standard names; nothing is cast, sorted or dropped."""
    if missing := [c for c in (case, activity, timestamp) if c not in df.columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    named = ((case, STANDARD_CASE), (activity, STANDARD_ACTIVITY), (timestamp, STANDARD_TIME))
    return df.select(*(F.col(quoted(c)).alias(name) for c, name in named))


def events(df: DataFrame, spec: EventLogSpec, by: tuple[str, ...] = ()) -> DataFrame:
    """``case, act, time`` and the order columns, besides the columns ``by`` that tell logs apart."""
    time = F.col(quoted(spec.timestamp)) if spec.timestamp else F.lit(None).cast("timestamp")
    order = [F.col(quoted(c)).alias(f"_o{i}") for i, c in enumerate(spec.order)]
    return df.select(*by, F.col(quoted(spec.case)).alias("case"), F.col(quoted(spec.activity)).alias("act"), time.alias("time"), *order)


def _order(log: DataFrame) -> list[Column]:
    return [F.col(c) for c in log.columns if c.startswith("_o")]


def _by_time(log: DataFrame) -> list[Column]:
    return [F.col("time").asc_nulls_last(), *_order(log)]


def sort_log(df: DataFrame, spec: EventLogSpec) -> DataFrame:
    """Rows with a readable timestamp, parsed, in order of case and time."""
    from eventloom.functions.timestamps import as_timestamp

    kind = dict(df.dtypes)[spec.timestamp]
    parsed = df.withColumn(spec.timestamp, as_timestamp(F.col(quoted(spec.timestamp)), kind)).where(F.col(quoted(spec.timestamp)).isNotNull())
    return parsed.orderBy(F.col(quoted(spec.case)).asc_nulls_last(), quoted(spec.timestamp), *spec.order)


def first_per_case_time(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of events with the same case and time, the first in row order; nulls equal each other."""
    window = Window.partitionBy(*by, "case", "time").orderBy(*_order(log))
    return log.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def trace_shapes(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per case: ``n`` events and ``n_acts`` distinct activities, null being one."""
    marked = F.struct("act")
    return log.where(F.col("case").isNotNull()).groupBy(*by, "case").agg(F.count("*").alias("n"), F.count_distinct(marked).alias("n_acts"))


def valid(shape: str = "") -> Column:
    """A trace is valid if it has several events and several activities."""
    return (F.col(f"{shape}n") > 1) & (F.col(f"{shape}n_acts") > 1)


def valid_events(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Events of valid traces."""
    good = trace_shapes(log, by).where(valid()).select(*by, "case")
    return log.join(good, [*by, "case"], "left_semi")


def traces(log: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """``case, trace``: the activities of each case as an array, in row order or as told.  Holds whole traces: for export."""
    keyed = log.where(F.col("case").isNotNull()).withColumn("_p", F.row_number().over(Window.partitionBy("case").orderBy(*(order or _order(log)))))
    return keyed.groupBy("case").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "act"))), lambda x: x["act"]).alias("trace"))


def variants(log: DataFrame, by: tuple[str, ...] = (), by_time: bool = False) -> DataFrame:
    """Per case: ``n``, ``n_acts`` and the fingerprint ``f1, f2`` of its trace."""
    window = Window.partitionBy(*by, "case").orderBy(*(_by_time(log) if by_time else _order(log)))
    placed = log.where(F.col("case").isNotNull()).withColumn("_p", F.row_number().over(window))
    token = (F.col("act").isNull(), F.col("act"))
    return placed.groupBy(*by, "case").agg(
        F.count("*").alias("n"),
        F.count_distinct(F.struct("act")).alias("n_acts"),
        F.bit_xor(F.xxhash64("_p", *token)).alias("f1"),
        F.bit_xor(F.xxhash64(*token, F.col("_p") * 31 + 7)).alias("f2"),
    )


def successions(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each event of a case but the last, with the activity that follows it in time."""
    window = Window.partitionBy(*by, "case").orderBy(*_by_time(log))
    following = log.where(F.col("case").isNotNull()).withColumn("next_act", F.lead("act").over(window)).withColumn("_more", F.lead(F.lit(1)).over(window))
    return following.where("_more is not null").select(*by, "case", "act", "next_act")


def dfg_edges(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Directly-follows edges ``act, next_act`` with their counts ``n``."""
    return successions(log, by).groupBy(*by, "act", "next_act").agg(F.count("*").alias("n"))


def variant_counts(log: DataFrame, by_time: bool = True) -> DataFrame:
    """Cases per variant; the variant is named by the smallest case that follows it."""
    found = variants(log, by_time=by_time)
    return found.groupBy("f1", "f2", "n").agg(F.count("*").alias("cases"), F.min("case").alias("example")).select("example", "cases", F.col("n").alias("length"))


#: Parts that events without a case are dealt into.
DEALT = 4096
_CASE, _EDGE, _ACT = 0, 1, 2


def _figures(log: DataFrame, by: tuple[str, ...], has_time: bool, by_time: bool, case_acts: bool = True) -> DataFrame:
    """Per log: ``rows, cases, events`` (with a case), ``case_acts`` (distinct activities, summed over cases; 0 if not asked for), ``variants, acts, edges``."""
    there = F.col("case").isNotNull()
    dealt = log.withColumn("_part", F.when(~there, F.pmod(F.xxhash64(*[c for c in log.columns if c not in by]), F.lit(DEALT))))
    keys = [*by, "case", "_part"]
    own, timed = (Window.partitionBy(*keys).orderBy(*order) for order in (_by_time(log) if by_time else _order(log), _by_time(log)))
    token = (F.col("act").isNull(), F.col("act"))
    placed = dealt
    if case_acts:  # the first event of each activity in its case
        placed = placed.withColumn("_new", (F.row_number().over(Window.partitionBy(*keys, "act").orderBy(*_order(log))) == 1).cast("long"))
    placed = placed.withColumn("_p", F.row_number().over(own)).withColumn("_last", F.lead(F.lit(1)).over(own).isNull())
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumns(
        {
            "_f1": F.bit_xor(F.xxhash64("_p", *token)).over(upto),
            "_f2": F.bit_xor(F.xxhash64(*token, F.col("_p") * 31 + 7)).over(upto),
            "_d": F.sum("_new").over(upto) if case_acts else F.lit(0),
        }
    )
    said = lambda kind, here, k1, k2, n, d: F.when(
        here, F.struct(F.lit(kind).alias("kind"), k1.alias("k1"), k2.alias("k2"), n.cast("long").alias("n"), d.cast("long").alias("d"))
    )
    parts = [
        said(_CASE, there & F.col("_last"), F.xxhash64("_f1", "_p"), F.col("_f2"), F.col("_p"), F.col("_d")),
        said(_ACT, F.lit(True), F.when(F.col("act").isNotNull(), F.xxhash64("act")), F.xxhash64(F.lit(3), "act"), F.lit(0), F.lit(0)),
    ]
    if has_time:
        placed = placed.withColumn("_next", F.lead(F.struct("act")).over(timed))
        after = F.col("_next.act")
        pair = (*token, after.isNull(), after)
        parts.append(said(_EDGE, there & F.col("_next").isNotNull(), F.xxhash64(*pair), F.xxhash64(F.lit(3), *pair), F.lit(0), F.lit(0)))
    said_all = placed.select(*by, F.inline(F.array_compact(F.array(*parts))))
    counted = said_all.groupBy(*by, "kind", "k1", "k2").agg(F.count("*").alias("times"), F.sum("n").alias("n"), F.sum("d").alias("d"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x)).cast("long")
    found = [
        F.coalesce(of(_ACT, F.col("times")), F.lit(0)).alias("rows"),
        F.coalesce(of(_CASE, F.col("times")), F.lit(0)).alias("cases"),
        of(_CASE, F.col("n")).alias("events"),
        of(_CASE, F.col("d")).alias("case_acts"),
        F.count_if(F.col("kind") == _CASE).alias("variants"),
        F.count_if((F.col("kind") == _ACT) & F.col("k1").isNotNull()).alias("acts"),
        F.count_if(F.col("kind") == _EDGE).alias("edges"),
    ]
    return counted.groupBy(*by).agg(*found) if by else counted.agg(*found)


def log_statistics(df: DataFrame, spec: EventLogSpec) -> DataFrame:
    """One row: cases, activities, variants (in row order), trace length, ratios, edge density (in time order), uniqueness.

    Without a timestamp the density is null.
    """
    found = _figures(events(df, spec), (), spec.timestamp is not None, by_time=False, case_acts=False)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    length = F.try_divide(F.col("events"), F.col("cases"))
    squared = F.col("acts") * F.col("acts")
    density = ratio(F.col("edges"), squared) if spec.timestamp else F.lit(None)
    return found.select(
        F.col("cases").alias("num_cases"),
        F.col("acts").alias("num_activities"),
        F.col("variants").alias("num_variants"),
        length.alias("avg_trace_length"),
        ratio(F.col("variants"), F.col("cases")).alias("variant_ratio"),
        ratio(length, F.col("acts")).alias("avg_events_per_case_ratio"),
        density.cast("double").alias("dfg_density"),
        F.try_divide(F.col("acts"), F.col("rows")).alias("uniqueness"),
    )


def features_of(log: DataFrame, by: tuple[str, ...] = (), has_time: bool = True, by_time: bool = True) -> DataFrame:
    """The feature vector ``LOG_FEATURES`` of each log (with a case) among events ``case, act, time``; many logs share one plan."""
    found = _figures(log, by, has_time, by_time)
    found = found.where("cases > 0") if by else found
    density = F.coalesce(F.try_divide(F.col("edges"), F.col("acts") * F.col("acts")), F.lit(0.0)) if has_time else F.lit(None)
    named = {
        "unique_case_count": F.col("cases"),
        "unique_activity_count": F.col("acts"),
        "avg_events_per_case": F.try_divide(F.col("events"), F.col("cases")),
        "variant_count": F.col("variants"),
        "avg_unique_acts_per_trace": F.try_divide(F.col("case_acts"), F.col("cases")),
        "dfg_density": density.cast("double"),
        "total_event_count": F.col("rows"),
    }
    return found.select(*by, *(named[c].alias(c) for c in (*LOG_FEATURES, "total_event_count")))


def validated_features(df: DataFrame, spec: EventLogSpec) -> tuple[DataFrame | None, float | None, ValidationInfo]:
    """Features of the valid part of a log, the share of valid traces, and whether the log passes.

    Validity is judged on all events; features come from events without repeated (case, time).  A log of
    single-event traces, or of traces with one activity each, has no features; one with fewer than
    ``VALID_SHARE`` valid traces fails but has them.
    """
    log = events(df, spec)
    shape = trace_shapes(log).agg(
        F.count("*").alias("traces"), F.count_if(valid()).alias("valid"), F.max("n").alias("longest"), F.max("n_acts").alias("most_acts")
    ).first()
    if not shape["traces"] or shape["longest"] <= 1:
        return None, None, ValidationInfo(False, ["every trace has a single event"])
    if shape["most_acts"] <= 1:
        return None, None, ValidationInfo(False, ["every trace has a single activity"])
    share = shape["valid"] / shape["traces"]
    passed = share >= VALID_SHARE
    word = "reaches" if passed else "is below"
    info = ValidationInfo(passed, [f"the share of valid traces, {share:.4f}, {word} {VALID_SHARE}"])
    good = trace_shapes(log).where(valid()).select("case")
    kept = first_per_case_time(log).join(good, "case", "left_semi") if spec.timestamp else log.join(good, "case", "left_semi")
    return features_of(kept, has_time=spec.timestamp is not None), share, info


def offline_features(logs: DataFrame, spec: EventLogSpec, by: str = "file") -> DataFrame:
    """Features of many logs in one table, told apart by the column ``by``: valid traces only, repeated times kept."""
    log = events(logs, spec, (by,))
    shapes = trace_shapes(log, (by,))
    shares = shapes.groupBy(by).agg(F.avg(valid().cast("int")).alias("valid_trace_percentage"))
    found = features_of(valid_events(log, (by,)), (by,), spec.timestamp is not None, by_time=False).join(shares, by)
    return found.withColumns(
        {
            "variant_ratio": F.try_divide(F.col("variant_count"), F.col("unique_case_count")),
            "avg_events_per_case_ratio": F.try_divide(F.col("avg_events_per_case"), F.col("unique_activity_count")),
        }
    )
