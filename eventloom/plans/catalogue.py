"""Named queries over the shared tables, and the SQL that gives the same rows.

Floating-point results are rounded to six places on both sides.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import timestamps
from eventloom.functions.measures import min_max
from eventloom.model import COLUMN_FEATURES, LOG_FEATURES, ROW_ID, STANDARD_ACTIVITY, STANDARD_CASE, STANDARD_TIME, EventLogSpec
from eventloom.operators import classify, novelty, offline, profile, reshape, scoring, screening, traces, validate
from eventloom.plans import sql
from eventloom.session import scratch_dir
from eventloom.sources import catalog, tables

EVENTS = EventLogSpec("user_id", "event_type", "ts", ("event_id",))
ORDERS = EventLogSpec("o_custkey", "o_orderstatus", "o_orderdate", ("o_orderkey",))
LINEITEM = EventLogSpec(
    "l_orderkey", "l_returnflag", "l_shipdate", ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
)
CONVERSATIONS = EventLogSpec("conv_id", "role", None, ("turn",))
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _log(spark: SparkSession, sf_dir: str, spec: EventLogSpec) -> DataFrame:
    names = {EVENTS: "events", ORDERS: "orders", LINEITEM: "lineitem", CONVERSATIONS: "conversations"}
    return read(spark, sf_dir, names[spec])


def _statistics(spec: EventLogSpec) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(traces.log_statistics(_log(spark, sf_dir, spec), spec))


def _validated(spec: EventLogSpec) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        features, share, _ = traces.validated_features(_log(spark, sf_dir, spec), spec)
        return rounded(features.select(*LOG_FEATURES).withColumn("valid_share", F.lit(share)))

    return run


def variants_topk(spark, sf_dir):
    log = traces.events(_log(spark, sf_dir, LINEITEM), LINEITEM)
    return traces.variant_counts(log, by_time=False).orderBy(F.col("cases").desc(), "example").limit(10)


def trace_lengths(spark, sf_dir):
    shapes = traces.trace_shapes(traces.events(_log(spark, sf_dir, LINEITEM), LINEITEM))
    return shapes.groupBy(F.col("n").alias("length"), F.col("n_acts").alias("activities")).agg(F.count("*").alias("cases"))


def trace_per_case(spark, sf_dir):
    return traces.traces(traces.events(_log(spark, sf_dir, ORDERS), ORDERS)).select("case", F.array_join("trace", ">").alias("trace"))


def dfg_edges(spark, sf_dir):
    return traces.dfg_edges(traces.events(_log(spark, sf_dir, EVENTS), EVENTS))


def valid_trace_events(spark, sf_dir):
    log = traces.events(_log(spark, sf_dir, LINEITEM), LINEITEM)
    return traces.valid_events(log).groupBy("act").agg(F.count("*").alias("events"), F.count_distinct("case").alias("cases"))


def dedup_case_ts(spark, sf_dir):
    log = traces.events(_log(spark, sf_dir, ORDERS), ORDERS)
    return traces.first_per_case_time(log).select("case", "act", F.unix_micros(F.col("time").cast("timestamp")).alias("micros"))


def standard_log(spark, sf_dir):
    log = traces.standard_log(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderdate")
    return log.withColumn("time:timestamp", F.unix_micros(F.col("`time:timestamp`").cast("timestamp")))


def sorted_log(spark, sf_dir):
    text = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    text = text.withColumn("ts", F.when(F.col("event_id") % 10 == 3, F.lit("n/a")).otherwise(F.col("ts")))
    return traces.sort_log(text, EVENTS).select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("micros"))


def wide_events(spark, sf_dir) -> DataFrame:
    """A wide table: a user a row, the first time of each kind of event."""
    wide = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id").pivot("event_type", list(EVENT_TYPES)).agg(F.min("ts"))
    return wide.withColumn(ROW_ID, F.col("user_id") * 10 + 7)


def wide_to_long(spark, sf_dir):
    long = reshape.wide_to_long(wide_events(spark, sf_dir), list(EVENT_TYPES), "user_id")
    return long.select("case", "activity", F.unix_micros("timestamp").alias("micros"))


def case_level_melt(spark, sf_dir):
    long = reshape.melt_case_level(wide_events(spark, sf_dir), list(EVENT_TYPES))
    return long.select("case", "activity", F.unix_micros("timestamp").alias("micros"))


def interval_gate(spark, sf_dir):
    return reshape.interval_figures(wide_events(spark, sf_dir), list(EVENT_TYPES))


def table_type_fill_rates(spark, sf_dir):
    return rounded(reshape.fill_rates(wide_events(spark, sf_dir), list(EVENT_TYPES)))


def table_types(spark, sf_dir):
    found = [(n, reshape.table_type(df)) for n, df in (("events", _keyed(spark, sf_dir, "events", "event_id")), ("wide", wide_events(spark, sf_dir)), ("nation", _keyed(spark, sf_dir, "nation", "n_nationkey")))]
    return spark.createDataFrame(found, "table string, kind string")


def primary_timestamp(spark, sf_dir):
    wide = wide_events(spark, sf_dir)
    return spark.createDataFrame([screening.primary_timestamp(list(EVENT_TYPES), screening.collect_profiles(wide))], "column string, score double")


def least_null_timestamp(spark, sf_dir):
    profiles = screening.collect_profiles(wide_events(spark, sf_dir))
    asked = (list(EVENT_TYPES), ["signup", "error"], ["error", "signup"], ["view"])
    return spark.createDataFrame([(",".join(names), screening.least_null_timestamp(names, profiles)) for names in asked], "asked string, column string")


def ensure_long(spark, sf_dir):
    long = reshape.ensure_long(wide_events(spark, sf_dir))
    return long.select("case", "activity", F.unix_micros("timestamp").alias("micros"))


def _keyed(spark, sf_dir, name: str, key: str) -> DataFrame:
    return read(spark, sf_dir, name).withColumn(ROW_ID, F.col(key))


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def column_profile(spark, sf_dir):
    return rounded(profile.column_profile(_keyed(spark, sf_dir, "orders", "o_orderkey"), PROFILED))


def minmax_norm(spark, sf_dir):
    found = profile.column_profile(_keyed(spark, sf_dir, "orders", "o_orderkey"), PROFILED)
    return rounded(found.select("column", min_max(F.col("entropy")).alias("entropy_scaled"), min_max(F.col("max_freq")).alias("max_freq_scaled")))


def tickets(spark, sf_dir) -> DataFrame:
    """An event a row, with text times, a customer of few kinds and a column that is black-listed by its name."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias(ROW_ID),
        F.concat(F.lit("c"), (F.col("user_id") % 60).cast("string")).alias("customer"),
        F.col("event_type").alias("status"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("changed"),
        (F.col("event_id") % 7).alias("seventh"),
        (F.col("event_id") % 5).alias("remark_code"),
    )


RANKED = ["customer", "status", "seventh", "remark_code"]


def _ranked(spark, sf_dir) -> DataFrame:
    return scoring.heuristic_scores(profile.column_features(tickets(spark, sf_dir), RANKED))


def heuristic_scores(spark, sf_dir):
    return rounded(_ranked(spark, sf_dir).select("column", "case_score", "act_score"))


def _top(spark, sf_dir) -> tuple[list[str], list[str]]:
    scores = _ranked(spark, sf_dir).cache()  # a row per column
    found = scoring.top_columns(scores, "case_score"), scoring.top_columns(scores, "act_score")
    scores.unpersist()
    return found


def top_columns(spark, sf_dir):
    rows = [(role, i, c) for role, names in zip(("case", "activity"), _top(spark, sf_dir)) for i, c in enumerate(names)]
    return spark.createDataFrame(rows, "role string, place int, column string")


def event_texts(spark, sf_dir) -> DataFrame:
    """Columns of every kind as text: for the recognisers."""
    e = read(spark, sf_dir, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    return e.select(
        F.col("event_id").alias(ROW_ID),
        F.col("event_type").alias("kind"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("changed"),
        F.date_format("ts", "d/M/yyyy").alias("day_first"),
        seconds.alias("unix_time"),
        seconds.alias("phone"),
        F.concat(F.col("event_id").cast("string"), F.lit(" days 02:03:04")).alias("duration"),
        F.date_format("ts", "EEEE").alias("weekday"),
        F.when(F.col("event_id") % 2 == 0, "1").otherwise("1.5").alias("amount"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("sparse"),
        # durations among the values 31 to 50 only
        F.when(F.col("event_id").between(30, 49), F.concat(F.col("event_id").cast("string"), F.lit(" days 02:03:04"))).otherwise(F.concat("event_type", (F.col("event_id") % 3).cast("string"))).alias("late"),
        F.concat(F.lit("r"), (F.col("event_id") % 9).cast("string")).alias("remark_code"),
    )


#: Patterns that times are written in, and how finely.
WRITTEN = {
    "yyyy-MM-dd": "day", "yyyy/MM/dd": "day", "yyyy.MM.dd": "day", "yyyyMMdd": "day", "dd/MM/yyyy": "day", "dd-MM-yyyy": "day", "dd.MM.yyyy": "day", "MMM d, yyyy": "day",
    "d MMM yyyy": "day", "MMMM d, yyyy": "day", "d MMMM yyyy": "day", "yyyy-MM-dd'T'HH:mm:ss": "second", "yyyy/MM/dd HH:mm:ss": "second", "yyyy-MM-dd HH:mm": "minute",
    "yyyy/MM/dd HH:mm": "minute", "dd/MM/yyyy HH:mm": "minute", "dd/MM/yyyy HH:mm:ss": "second", "dd.MM.yyyy HH:mm:ss": "second", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS": "microsecond",
    "yyyy-MM-dd HH:mm:ss.SSSSSS": "microsecond", "yyyy-MM-dd'T'HH:mm:ssXXX": "second", "yyyy-MM-dd HH:mm:ssXXX": "second",
}


def parsed_patterns(spark, sf_dir):
    """Times written in many patterns: how many are recognised, and what they are read as."""
    ts = F.col("ts").cast("timestamp")
    e = read(spark, sf_dir, "events").select(F.inline(F.array(*(F.struct(F.lit(p).alias("pattern"), F.date_format(ts, p).alias("value")) for p in WRITTEN))))
    return e.groupBy("pattern").agg(
        F.count_if(timestamps.is_datetime(F.col("value"), F.lit("when"))).alias("recognised"), F.sum(F.unix_micros(timestamps.parse(F.col("value"))).cast("decimal(20,0)")).cast("string").alias("micros")
    )


def recognisers(spark, sf_dir):
    found = profile.sample_profile(profile.first_values(event_texts(spark, sf_dir), 50))
    return rounded(found.select("column", "kinds", "duration_share", "datetime_share", "first_length", "dashes", "spaces"))


def unix_ts_detect(spark, sf_dir):
    e = event_texts(spark, sf_dir)
    both = e.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("unix_time", "phone")))))
    return both.groupBy("column").agg(F.count_if(timestamps.is_datetime(F.col("value"), F.col("column"))).alias("datetimes"))


def field_screening(spark, sf_dir):
    df = event_texts(spark, sf_dir)
    profiles = screening.collect_profiles(df)
    times = screening.timestamp_columns(df, profiles)
    kept = screening.screen_fields(df, profiles, times)
    return spark.createDataFrame([(c, c in times, c in kept) for c in profiles.whole], "column string, is_timestamp boolean, kept boolean")


def datetime_filter(spark, sf_dir):
    df = event_texts(spark, sf_dir)
    profiles = screening.collect_profiles(df)
    left = screening.without_datetimes(df, list(profiles.whole), ["KIND"], profiles)
    return spark.createDataFrame([(c,) for c in left], "column string")


def duplicate_columns(spark, sf_dir):
    df = _keyed(spark, sf_dir, "nation", "n_nationkey").withColumn("copy_of_key", F.col("n_nationkey").cast("string")).withColumn("other", F.col("n_regionkey") + 1)
    found = screening.duplicate_columns(df)
    return spark.createDataFrame(list(found.items()), "column string, same_as string")


def ca_combinations(spark, sf_dir):
    return spark.createDataFrame(scoring.case_activity_combinations(*_top(spark, sf_dir)), "case string, activity string")


def _scratch(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def csv_scan(spark, sf_dir):
    """Orders under standard names, through CSV files and back."""
    path = _scratch(spark, "orders")
    traces.standard_log(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderdate").write.csv(path, header=True)
    df = tables.read_csv(spark, path)
    case, activity, time = tables.resolve_log_columns(df.columns)
    return df.select(F.col(f"`{case}`").alias("case"), F.col(f"`{activity}`").alias("act"), F.unix_micros(F.col(f"`{time}`").cast("timestamp")).alias("micros"))


#: A pattern that keeps all of a time; by default CSV files have milliseconds.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def folder_features(spark, sf_dir):
    """Features of four folders of CSV logs, written as CSV and read again: a file each, in row order, with times to the microsecond."""
    path = _scratch(spark, "logs")
    orders = read(spark, sf_dir, "orders").withColumn("part", F.col("o_custkey") % 4)
    log = orders.select("part", "o_orderkey", *(F.col(c).alias(name) for c, name in ((ORDERS.case, STANDARD_CASE), (ORDERS.activity, STANDARD_ACTIVITY), (ORDERS.timestamp, STANDARD_TIME))))
    # A shuffle hands on the rows of its map tasks in any order.  The writer keeps a sort that begins with the very column it divides by.
    log = log.repartition(4, "part").sortWithinPartitions("part", F.col("o_orderkey").asc_nulls_last()).drop("o_orderkey")
    log.write.partitionBy("part").options(timestampFormat=f"{MICROS}XXX", timestampNTZFormat=MICROS).csv(path, header=True)
    rows = []
    for i in range(4):
        offline.features_from_folder(spark, f"{path}/part={i}", output=f"{path}-features/{i}")
        rows.append(tables.read_csv(spark, f"{path}-features/{i}").select(F.lit(i).cast("long").alias("part"), *LOG_FEATURES, "total_event_count", "valid_trace_percentage"))
    return rounded(reshape.union_all(rows).withColumns({c: F.col(c).cast("long") for c in ("unique_case_count", "unique_activity_count", "variant_count", "total_event_count")}))


def _portal(spark, sf_dir) -> list[tuple[int, str, list[str]]]:
    """A stand-in portal with a record for each nation: number, title, and files, of which none, one or two are CSV."""
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    return [(r["n_nationkey"], r["n_name"], ["readme.txt", *(f"part{i}.CSV" for i in range(r["n_regionkey"] % 3))]) for r in rows]


def zenodo_search(spark, sf_dir):
    """Records of the stand-in portal with one CSV file that can be fetched, up to five."""
    records = [{"id": k, "metadata": {"title": t}, "files": [{"key": f, "links": {"self": f"{k}/{f}"}} for f in files]} for k, t, files in _portal(spark, sf_dir)]

    def get(url, **_):
        if url.endswith("/records"):
            return SimpleNamespace(raise_for_status=lambda: None, json=lambda: {"hits": {"hits": records}})
        if int(url.split("/")[0]) % 4 == 3:
            raise OSError("not there")
        return contextlib.nullcontext(SimpleNamespace(raise_for_status=lambda: None, iter_content=lambda chunk_size: [b"a,b\n1,2\n"]))

    with tempfile.TemporaryDirectory() as folder:
        return _found(spark, catalog.search_data_platform("logs", "Zenodo", folder, 5, get), folder)


def kaggle_search(spark, sf_dir):
    """The same through the other portal's client, up to four."""
    portal = {f"owner/{k}": (t, files) for k, t, files in _portal(spark, sf_dir)}

    def fetch(ref, name, path, **_):
        if int(ref.split("/")[1]) % 4 == 3:
            raise OSError("not there")

    client = SimpleNamespace(
        dataset_list=lambda **_: [SimpleNamespace(ref=r, title=t) for r, (t, _) in portal.items()],
        dataset_list_files=lambda ref: SimpleNamespace(files=[SimpleNamespace(name=n) for n in portal[ref][1]]),
        dataset_download_file=fetch,
    )
    with tempfile.TemporaryDirectory() as folder:
        return _found(spark, catalog.search_data_platform("logs", "kaggle", folder, 4, client), folder)


def _found(spark, datasets, folder: str) -> DataFrame:
    return spark.createDataFrame([(d.ref, d.csv_path.removeprefix(f"{folder}/"), d.title) for d in datasets], catalog.SCHEMA)


def matrix_read(spark, sf_dir):
    """A matrix of known logs, written as CSV and read by name."""
    path = _scratch(spark, "matrix")
    tables.write_csv(_matrix_and_points(spark, sf_dir)[0], path)
    return rounded(tables.read_training_matrix(spark, path))


def offline_features(spark, sf_dir):
    logs = read(spark, sf_dir, "orders").withColumn("file", F.col("o_custkey") % 10)
    return rounded(traces.offline_features(logs, ORDERS, "file"))


def _matrix_and_points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Ten known logs from orders; three new ones from events."""
    logs = traces.events(read(spark, sf_dir, "orders").withColumn("id", F.col("o_custkey") % 10), ORDERS, ("id",))
    new = traces.events(read(spark, sf_dir, "events").withColumn("id", F.col("user_id") % 3), EVENTS, ("id",))
    return traces.features_of(logs, ("id",)), traces.features_of(new, ("id",))


def _detected(test: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(novelty.DETECTORS[test](*_matrix_and_points(spark, sf_dir)))


def novelty_vote(spark, sf_dir):
    matrix, points = _matrix_and_points(spark, sf_dir)
    return novelty.vote(novelty.run_tests(matrix, points, ("lof", "dbscan")))


def _labelled(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias(ROW_ID), (F.col("user_id") % 60).alias("case:concept:name"), F.col("event_type").alias("concept:name"), (F.col("event_id") % 7).alias("seventh"), (F.col("event_id") % 3).alias("third")
    )


def column_training_set(spark, sf_dir):
    """Features and labels of the columns of two logs."""
    logs = _labelled(spark, sf_dir)
    found = classify.training_set([logs.where(F.col(ROW_ID) % 2 == i) for i in range(2)], screen=False)
    return rounded(found.select("column", "label", *COLUMN_FEATURES))


def feature_means_by_label(spark, sf_dir):
    """Mean features of the labels, stored and read again."""
    path = _scratch(spark, "means")
    tables.write_means(classify.mean_features(classify.training_set([_labelled(spark, sf_dir)], screen=False)), path)
    return rounded(tables.read_means(spark, path))


def similarity(spark, sf_dir):
    found = profile.column_features(_keyed(spark, sf_dir, "nation", "n_nationkey"))
    return rounded(found.select("column", "sim"))


def column_classifiers(spark, sf_dir):
    """Probabilities of a decision tree on the columns that it was trained on."""
    logs = _labelled(spark, sf_dir)
    features = classify.training_set([logs.where(F.col(ROW_ID) % 2 == i) for i in range(2)], screen=False)
    found = classify.train_classifiers(features, "tree").score(features)
    return found.groupBy("column").agg(F.round(F.avg("p_case"), 2).alias("p_case"), F.round(F.avg("p_activity"), 2).alias("p_activity"))


def _training(spark, sf_dir, parts: int = 4) -> DataFrame:
    logs = _labelled(spark, sf_dir)
    return classify.training_set([logs.where(F.col(ROW_ID) % parts == i) for i in range(parts)], screen=False)


def classified_columns(spark, sf_dir):
    """What each method (with fewer trees than usual) says of the columns that it was trained on."""
    features = _training(spark, sf_dir).cache()  # a row per column of four logs
    parts = []
    for method in classify.METHODS:
        found = classify.train_classifiers(features, method, {"rf": {"numTrees": 20}, "gb": {"maxIter": 10}}.get(method)).score(features)
        said = F.when((F.col("p_case") > 0.5) & (F.col("p_case") >= F.col("p_activity")), "case").when(F.col("p_activity") > 0.5, "activity").otherwise("irrelevant")
        parts.append(found.select(F.lit(method).alias("method"), "column", said.alias("said")).distinct())
    return reshape.union_all(parts)


def saved_classifiers(spark, sf_dir):
    """Do classifiers that were stored and loaded score as those in memory?"""
    features = _training(spark, sf_dir, 2).cache()  # a row per column of two logs
    parts = []
    for method in ("logistic", "tree", "svm"):
        path = _scratch(spark, f"classifiers-{method}")
        made = classify.train_classifiers(features, method)
        made.save(path)
        loaded = classify.ColumnClassifiers.load(spark, path, method)
        scores = lambda c: c.score(features).groupBy("column").agg(F.sum("p_case").alias("c"), F.sum("p_activity").alias("a"))
        both = scores(made).join(scores(loaded).withColumnsRenamed({"c": "c2", "a": "a2"}), "column")
        parts.append(both.select(F.lit(method).alias("method"), "column", ((F.abs(F.col("c") - F.col("c2")) < 1e-9) & (F.abs(F.col("a") - F.col("a2")) < 1e-9)).alias("same")))
    return reshape.union_all(parts)


def oversampled_columns(spark, sf_dir):
    """Rows and ranges of the features of both classes after oversampling: new rows lie between old ones."""
    marked = _training(spark, sf_dir).withColumn("target", (F.col("label") == "activity").cast("int"))
    found = classify.oversampled(marked, "target")
    return rounded(found.groupBy("target").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in COLUMN_FEATURES for n, f in (("least", F.min), ("most", F.max)))))


def suggested_columns(spark, sf_dir):
    return spark.createDataFrame(scoring.suggest_columns(tickets(spark, sf_dir)), "timestamp string, case string, activity string")


def evaluated_combinations(spark, sf_dir):
    """Every pair of case and activity, each with its figures."""
    df = tickets(spark, sf_dir)
    found = validate.evaluate_combinations(df, ["customer", "seventh"], ["status", "seventh"], ["changed"])
    return rounded(validate.combination_results(df, found).drop("anomaly"))


def validated_log(spark, sf_dir):
    _, found = validate.validate_event_log(tickets(spark, sf_dir))
    return spark.createDataFrame([(c["timestamp"], c["case"], c["activity"]) for c in found], "timestamp string, case string, activity string")


def validated_orders(spark, sf_dir):
    """The whole validation of a table with all its columns."""
    _, found = validate.validate_event_log(_keyed(spark, sf_dir, "orders", "o_orderkey"))
    return spark.createDataFrame([(c["timestamp"], c["case"], c["activity"]) for c in found], "timestamp string, case string, activity string")


def candidate_tables(spark, sf_dir):
    rows = []
    for name, df in (("tickets", tickets(spark, sf_dir)), ("wide", wide_events(spark, sf_dir))):
        rows += [(name, c.path, c.timestamp) for c in reshape.candidate_tables(df)]
    return spark.createDataFrame(rows, "table string, path string, timestamp string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {
        "log_statistics_events": _statistics(EVENTS),
        "log_statistics_orders": _statistics(ORDERS),
        "log_statistics_lineitem": _statistics(LINEITEM),
        "log_statistics_conversations": _statistics(CONVERSATIONS),
        "ca_features_orders": _validated(ORDERS),
        "ca_features_lineitem": _validated(LINEITEM),
        "knn1_distance": _detected("dbscan"),
        "lof_score": _detected("lof"),
        "isolation_forest": _detected("isoforest"),
        "one_class_machine": _detected("ocsvm"),
    }
    plain = [
        variants_topk, trace_lengths, trace_per_case, dfg_edges, valid_trace_events, dedup_case_ts, standard_log, sorted_log, wide_to_long, case_level_melt,
        interval_gate, table_type_fill_rates, table_types, primary_timestamp, least_null_timestamp, ensure_long, column_profile, minmax_norm, heuristic_scores, top_columns, recognisers, parsed_patterns, unix_ts_detect,
        field_screening, datetime_filter, duplicate_columns, ca_combinations, offline_features, csv_scan, folder_features, matrix_read, zenodo_search, kaggle_search, novelty_vote, column_training_set, feature_means_by_label, similarity, column_classifiers, classified_columns, saved_classifiers, oversampled_columns,
        suggested_columns, evaluated_combinations, validated_log, validated_orders, candidate_tables,
    ]
    return named | {f.__name__: f for f in plain}


def oracle_sql() -> dict[str, str]:
    return sql.oracles(EVENTS, ORDERS, LINEITEM, CONVERSATIONS)
