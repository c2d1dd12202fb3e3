"""Statistics of a growing event log.

Counts per case and activity are kept as additive tables: each micro-batch is combined on its own and
added to the state folder, so late events of a case only add to it.  Edges and variants, which need a case's order, are not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from eventloom.model import EventLogSpec
from eventloom.sources.tables import quoted


def windowed_activity_counts(stream: DataFrame, spec: EventLogSpec, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and (approximate) cases per activity and window of event time; events later than ``late`` are left out."""
    time = F.col(quoted(spec.timestamp)).cast("timestamp")
    rows = stream.select(F.col(quoted(spec.case)).alias("case"), F.col(quoted(spec.activity)).alias("activity"), time.alias("time"))
    counted = rows.withWatermark("time", late).groupBy(F.window("time", window), "activity")
    found = counted.agg(F.count("*").alias("events"), F.approx_count_distinct("case").alias("cases"))
    return found.select(F.col("window.start").alias("window_start"), "activity", "events", "cases")


def case_counts_into(stream: DataFrame, spec: EventLogSpec, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's ``case, activity, n`` to ``folder``, a batch at a time and once each."""

    def merge(batch: DataFrame, number: int) -> None:
        combined = batch.groupBy(F.col(quoted(spec.case)).alias("case"), F.col(quoted(spec.activity)).alias("activity")).agg(F.count("*").alias("n"))
        combined.write.mode("overwrite").parquet(f"{folder}/batch={number}")  # a repeated batch overwrites itself

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Cases, activities and mean trace length over all batches so far."""
    counts = spark.read.parquet(folder)
    per_case = counts.groupBy("case").agg(F.sum("n").alias("n")).where("case is not null")
    activities = counts.agg(F.count_distinct("activity").alias("num_activities"))
    return per_case.agg(F.count("*").alias("num_cases"), F.avg("n").alias("avg_trace_length")).crossJoin(activities)  # one row each
