"""Measures of columns of values."""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPSILON = 1e-9
#: Distinct strings that similarity is measured on.
SIMILARITY_STRINGS = 100


def entropy_term(share: Column) -> Column:
    """What one value with this share of rows adds to the entropy in bits."""
    return -share * F.log2(share + F.lit(EPSILON))


def min_max(value: Column) -> Column:
    """Scaled to [0, 1] over all rows of a small frame; 0 if all are equal."""
    everything = Window.partitionBy(F.lit(1))
    low, high = F.min(value).over(everything), F.max(value).over(everything)
    return F.when(low == high, F.lit(0.0)).otherwise((value - low) / (high - low))


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """With the population's deviation; a constant column is only centred."""
    return (value - mean) / F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)


def word_count(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def kind_of(text: Column) -> Column:
    """What a text reads as: ``int``, ``float`` or ``str``; infinite and not-a-number count as float."""
    number = F.regexp_replace(F.trim(text), r"(?<=\d)_(?=\d)", "").try_cast("double")
    whole = (number == F.floor(number).cast("double")) & (F.abs(number) < F.lit(float("inf"))) & ~F.isnan(number)
    return F.when(number.isNull(), "str").when(whole, "int").otherwise("float")


def mean_similarity(strings: list[str]) -> float:
    """Mean ratio of matching blocks over pairs in sorted order; 1 for fewer than two strings."""
    strings = sorted(strings)
    if len(strings) < 2:
        return 1.0
    ratios = [SequenceMatcher(None, a, b).ratio() for a, b in combinations(strings, 2)]
    return sum(ratios) / len(ratios)


def similarity(strings: Column) -> Column:
    """:func:`mean_similarity` of arrays of at most ``SIMILARITY_STRINGS`` strings; in Python, for want of a built-in."""

    @F.pandas_udf("double")
    def mean(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: mean_similarity(list(a)))

    return mean(strings)
