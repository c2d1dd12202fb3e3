"""Removal of boilerplate lines by the number of distinct sites that carry them.

Each line hash gets a HyperLogLog sketch of its sites; sketches merge in aggregation, so a line that a third of
all documents carry costs a sketch per task.  Lines clearly above the threshold are boilerplate, lines clearly
below stay, and those near it get an exact distinct count.  Built-in functions only.

Lines are compared as they are; empty lines are never removed.  Line hashes are two 64-bit hashes.

Defined results: a null text has no lines and stays null; a null site counts as no site; repeated rows are cleaned
alike; documents are told apart by ``doc_id`` and text, so repeated or null ids do no harm; extra
columns are ignored by :func:`remove_boilerplate`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm._base import written

#: A line on at least this many sites is boilerplate.
SITES = 5
#: Estimates within this share of the threshold are counted exactly.
NEAR = 0.25
LOG_REGISTERS = 12


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """``doc_id, text_key, pos, h1, h2, site`` of each line that is not empty."""
    exploded = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return exploded.where("line <> ''").select("doc_id", "text_key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2"), "site")


def boilerplate_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """``h1, h2`` of those of the ``lines`` (``h1, h2, site``) that are on at least ``sites`` distinct sites."""
    low, high = sites * (1 - NEAR), sites * (1 + NEAR)
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS))
    spread = lines.where("site is not null").groupBy("h1", "h2").agg(sketch.alias("estimate"))
    spread = written(spread.where(F.col("estimate") >= low), "spread")
    near = spread.where(F.col("estimate") <= high).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("site").alias("n"))
    return spread.where(F.col("estimate") > high).select("h1", "h2").union(exact.where(F.col("n") >= sites).select("h1", "h2"))


def remove_boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text`` (without boilerplate lines), ``n_lines, n_removed``.

    Lines are cut and hashed once, into a table of hashes and places that all later steps read.
    """
    lines = written(_lines(docs, site), "lines")
    found = written(boilerplate_lines(lines, sites), "boilerplate")
    hits = lines.select("doc_id", "text_key", "pos", "h1", "h2").join(found, ["h1", "h2"], "left_semi")
    dropped = hits.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone"))  # at most a document's lines
    dropped = dropped.withColumnsRenamed({"doc_id": "g_id", "text_key": "g_key"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("lines"))
    joined = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")
    # in proportion to the lines: places that stay by a hash set, and the lines there by their places
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stays, lambda p: F.get("lines", p)))
    return joined.select(
        "doc_id",
        F.array_join(kept, "\n").alias("text"),
        F.coalesce(F.size(F.filter("lines", lambda line: line != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
