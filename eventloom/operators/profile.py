"""Profiles of columns: one over all values, and one over the first values of each column.

Values are unpivoted to (column, hashes of the value) and counted with map-side combination, so that distinct counts,
top shares, entropy and lengths of all columns come from one shuffle, whatever their number and the length of their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import timestamps
from eventloom.functions.measures import SIMILARITY_STRINGS, entropy_term, kind_of, similarity, word_count
from eventloom.model import COLUMN_FEATURES, ROW_ID
from eventloom.sources.tables import quoted

#: Rows among which the first values of columns are looked for before the whole table is.
HEAD_ROWS = 1000
#: Longest text, in words, that does not count as long.
MAX_WORDS = 6


def simple_columns(df: DataFrame) -> list[str]:
    """Columns with values that have a text form: no arrays, maps or structs; without the row order."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema if f.name != ROW_ID and not isinstance(f.dataType, nested)]


def unpivoted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``ordinal, column, value`` (text, or null) for each cell."""
    columns = simple_columns(df) if columns is None else columns
    cells = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for i, c in enumerate(columns)))
    return df.select(F.inline(cells))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``ordinal, column, h1, h2, length, wordy, n``: how often each value of each column occurs, with a row of nulls for null.

    Values are told apart by two 64-bit hashes, so that long texts are not shuffled.
    """
    value = F.col("value")
    hashed = (F.when(value.isNotNull(), F.xxhash64(value)).alias("h1"), F.when(value.isNotNull(), F.xxhash64(F.lit(11), value)).alias("h2"))
    cells = unpivoted(df, columns).select("ordinal", "column", *hashed, F.length(value).alias("length"), (word_count(value) > MAX_WORDS).alias("wordy"))
    return cells.groupBy("ordinal", "column", "h1", "h2", "length", "wordy").agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per column: rows, non-null and distinct values, top share, entropy, text lengths, share of long texts."""
    counts = value_counts(df, columns)
    sizes = counts.groupBy("ordinal", "column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("h1").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"))
    joined = counts.join(F.broadcast(sizes), ["ordinal", "column"])  # a row per column of the table
    length, n = F.col("length"), F.col("n")
    there = F.col("h1").isNotNull()
    mean = F.sum(F.when(there, n * length)) / F.col("non_null")
    mean_square = F.sum(F.when(there, n * length * length)) / F.col("non_null")
    return joined.groupBy("ordinal", "column", "n_rows", "non_null").agg(
        F.count_if(there).alias("n_unique"),
        (F.coalesce(F.max(F.when(there, n)), F.lit(0)) / F.col("n_rows")).alias("max_freq"),
        F.coalesce(F.sum(F.when(there, entropy_term(n / F.col("non_null")))), F.lit(0.0)).alias("entropy"),
        F.sqrt(F.greatest(mean_square - mean * mean, F.lit(0.0))).alias("std_length"),
        F.coalesce(F.max(F.when(there, length)), F.lit(0)).alias("max_length"),
        (F.coalesce(F.sum(F.when(there & F.col("wordy"), n)), F.lit(0)) / F.col("n_rows")).alias("long_share"),
    ).withColumn("n_unique_ratio", F.col("n_unique") / F.col("n_rows"))


def distinct_samples(df: DataFrame, columns: list[str] | None = None, n: int = SIMILARITY_STRINGS) -> DataFrame:
    """``ordinal, column, strings``: up to ``n`` distinct values of each column, those with the smallest hashes.

    The hashes are chosen first, so that the second pass shuffles the texts of the chosen values only.
    """
    window = Window.partitionBy("ordinal").orderBy("h1", "h2")
    drawn = value_counts(df, columns).where("h1 is not null").select("ordinal", "h1", "h2").withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n)
    chosen = F.broadcast(drawn.select("ordinal", "h1", "h2"))  # n rows per column of the table
    cells = unpivoted(df, columns).where("value is not null").withColumns({"h1": F.xxhash64("value"), "h2": F.xxhash64(F.lit(11), "value")})
    return cells.join(chosen, ["ordinal", "h1", "h2"], "left_semi").groupBy("ordinal", "column").agg(F.sort_array(F.collect_set("value")).alias("strings"))


def column_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``ordinal, column`` and the feature vector ``COLUMN_FEATURES``."""
    sims = distinct_samples(df, columns).select("column", similarity(F.col("strings")).alias("sim"))
    found = column_profile(df, columns).join(sims, "column", "left").withColumn("sim", F.coalesce("sim", F.lit(1.0)))
    return found.select("ordinal", "column", *COLUMN_FEATURES)


def first_values(df: DataFrame, n: int, columns: list[str] | None = None) -> DataFrame:
    """``ordinal, column, position, value``: the first ``n`` non-null values of each column in row order.

    Most columns have them among the first ``HEAD_ROWS`` rows, which one pass finds; the others (sparse ones) share a second pass.
    """
    columns = simple_columns(df) if columns is None else columns
    place = Window.partitionBy("ordinal").orderBy(ROW_ID)

    def first(rows: DataFrame, names: list[str]) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(columns.index(c)).alias("ordinal"), F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in names))
        found = rows.select(ROW_ID, F.inline(cells)).where("value is not null")
        return found.withColumn("position", F.row_number().over(place)).where(F.col("position") <= n).select("ordinal", "column", "position", "value")

    head = df.select(ROW_ID, *(F.col(quoted(c)).cast("string").alias(c) for c in columns)).orderBy(ROW_ID).limit(HEAD_ROWS)
    counts = head.agg(F.count("*").alias("_rows"), *(F.count(quoted(c)).alias(f"_{i}") for i, c in enumerate(columns))).first()
    dense = [c for i, c in enumerate(columns) if counts[f"_{i}"] >= n or counts["_rows"] < HEAD_ROWS]
    sparse = [c for c in columns if c not in dense]
    if not sparse:
        return first(head, dense)
    return first(head, dense).unionAll(first(df, sparse)) if dense else first(df, sparse)


def sample_profile(values: DataFrame, free_form: bool = False) -> DataFrame:
    """What the first values of each column look like, from :func:`first_values` of 50.

    ``kinds``: kinds among 50; ``duration_share`` of 50 and ``duration_share_30``; ``datetime_share`` of 30; ``datetimes_20``
    and ``n_20``; the signature of 30: length of the first, values with a dash, values with a space.  With ``free_form``, times in no
    known pattern are tried by a general parser.
    """
    if free_form:
        values = values.withColumn("_dated", timestamps.is_datetime(F.col("value"), F.col("column"), True))
    value, place, name = F.col("value"), F.col("position"), F.col("column")
    dated = (F.col("_dated") if free_form else timestamps.is_datetime(value, name)).cast("int")
    timed = timestamps.speaks_of_duration(value).cast("int")
    upto = lambda n, x: F.when(place <= n, x)
    return values.groupBy("ordinal", "column").agg(
        F.count_distinct(upto(50, kind_of(value))).alias("kinds"),
        F.avg(upto(50, timed)).alias("duration_share"),
        F.avg(upto(30, timed)).alias("duration_share_30"),
        F.avg(upto(30, dated)).alias("datetime_share"),
        F.coalesce(F.sum(upto(20, dated)), F.lit(0)).alias("datetimes_20"),
        F.count(upto(20, value)).alias("n_20"),
        F.max(F.when(place == 1, F.length(value))).alias("first_length"),
        F.count_if((place <= 30) & value.contains("-")).alias("dashes"),
        F.count_if((place <= 30) & value.contains(" ")).alias("spaces"),
    )
