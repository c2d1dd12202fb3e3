"""Novelty of an event log's features against a matrix of known logs.

Distances, neighbours and densities are DataFrame expressions; the matrix is a small table (a row per known
log), so that Spark broadcasts it by its size.  The isolation forest and the one-class machine are fitted
on the driver from the collected matrix, in memory in proportion to its rows: at most ``MATRIX_ROWS``, each a whole known log.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.measures import z_score
from eventloom.model import LOG_FEATURES

MATRIX_ROWS = 100_000
#: Rows of the one-class machine's kernel that are held at a time.
KERNEL_ROWS = 256
LOF_NEIGHBOURS = 4
LOF_LIMIT = 1.5
NEAREST_LIMIT = 0.6
TREES = 100
TREE_ROWS = 256
NU = 0.05
SEED = 42


def standardised(matrix: DataFrame, points: DataFrame, features: tuple[str, ...] = LOG_FEATURES) -> tuple[DataFrame, DataFrame]:
    """Both with their features as the array ``x`` of z-scores under the matrix's means and deviations; ids are kept."""
    stats = matrix.agg(*(F.avg(c).alias(f"m_{c}") for c in features), *(F.stddev_pop(c).alias(f"d_{c}") for c in features))
    scaled = lambda df: df.crossJoin(stats).select(  # one row
        "id", F.array(*(z_score(F.col(c).cast("double"), F.col(f"m_{c}"), F.col(f"d_{c}")) for c in features)).alias("x")
    )
    return scaled(matrix), scaled(points)


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))


def distances(points: DataFrame, known: DataFrame) -> DataFrame:
    """``id, other, d`` of each point to each known one; a point is no neighbour of itself if ids are shared."""
    other = known.select(F.col("id").alias("other"), F.col("x").alias("y"))
    return points.crossJoin(other).select("id", "other", _distance(F.col("x"), F.col("y")).alias("d"))


def nearest_distance(matrix: DataFrame, points: DataFrame) -> DataFrame:
    """``id, score, outlier``: distance to the nearest known log."""
    known, new = standardised(matrix, points)
    found = distances(new, known).groupBy("id").agg(F.min("d").alias("score"))
    return found.withColumn("outlier", F.col("score") > NEAREST_LIMIT)


def local_outlier_factor(matrix: DataFrame, points: DataFrame, neighbours: int = LOF_NEIGHBOURS) -> DataFrame:
    """``id, score, outlier``: local outlier factor of points against the matrix, with at most n - 1 neighbours."""
    known, new = standardised(matrix, points)
    n = matrix.count()
    k = max(1, min(neighbours, n - 1))
    nearest = Window.partitionBy("id").orderBy("d", "other")
    among = lambda pairs: pairs.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k).drop("_r")
    inside = among(distances(known, known).where("id <> other"))
    reach = inside.groupBy("id").agg(F.max("d").alias("kd"))

    def density(pairs: DataFrame) -> DataFrame:
        far = pairs.join(reach.select(F.col("id").alias("other"), "kd"), "other")
        return far.groupBy("id").agg((1 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("density"))

    own = among(distances(new, known))
    theirs = own.join(density(inside).select(F.col("id").alias("other"), F.col("density").alias("their")), "other")
    score = theirs.groupBy("id").agg(F.avg("their").alias("their")).join(density(own), "id")
    return score.select("id", (F.col("their") / F.col("density")).alias("score")).withColumn("outlier", F.col("score") > LOF_LIMIT)


def _collected(matrix: DataFrame) -> np.ndarray:
    rows = matrix.orderBy("id").select("x").limit(MATRIX_ROWS + 1).collect()
    if len(rows) > MATRIX_ROWS:
        raise ValueError(f"a matrix of known logs has at most {MATRIX_ROWS} rows")
    return np.array([r["x"] for r in rows], float)


def _path_length(n: int) -> float:
    """Mean length of an unsuccessful search among ``n`` points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else np.array([])
    if depth == 0 or len(x) <= 1 or not len(spread):
        return (len(x),)
    column = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, column].min(), x[:, column].max()))
    left = x[:, column] < cut
    return (column, cut, _grow(x[left], depth - 1, rng), _grow(x[~left], depth - 1, rng))


def _depth(tree: tuple, x: np.ndarray) -> float:
    depth = 0
    while len(tree) > 1:
        tree, depth = (tree[2] if x[tree[0]] < tree[1] else tree[3]), depth + 1
    return depth + _path_length(tree[0])


def isolation_forest(matrix: DataFrame, points: DataFrame, seed: int = SEED) -> DataFrame:
    """``id, score, outlier``: anomaly score in (0, 1), an outlier above one half."""
    known, new = standardised(matrix, points)
    x = _collected(known)
    rng, size = np.random.default_rng(seed), min(TREE_ROWS, len(x))
    height = math.ceil(math.log2(max(size, 2)))
    trees = [_grow(x[rng.choice(len(x), size, replace=False)], height, rng) for _ in range(TREES)]
    usual = _path_length(size) or 1.0

    @F.pandas_udf("double")
    def anomaly(xs: pd.Series) -> pd.Series:
        return xs.map(lambda v: 2 ** (-np.mean([_depth(t, np.asarray(v)) for t in trees]) / usual))

    return new.select("id", anomaly("x").alias("score")).withColumn("outlier", F.col("score") > 0.5)


def fit_one_class(x: np.ndarray, nu: float = NU, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Support vectors, their weights (sum 1), the offset and gamma of a one-class machine with a Gaussian kernel.

    The dual is solved by moving weight between the pair that violates the optimality conditions most.
    """
    n, gamma = len(x), 1.0 / (x.shape[1] * (x.var() or 1.0))
    squares = (x * x).sum(axis=1)
    # rows of the kernel are worked out when they are needed: the whole of it would grow with the square of the rows
    kernel = lru_cache(maxsize=KERNEL_ROWS)(lambda i: np.exp(-gamma * np.maximum(squares + squares[i] - 2 * (x @ x[i]), 0)))
    limit = 1.0 / (nu * n)
    alpha = np.zeros(n)
    whole = int(nu * n)
    alpha[:whole] = limit
    if whole < n:
        alpha[whole] = 1 - limit * whole
    slope = np.zeros(n)
    for i in np.flatnonzero(alpha).tolist():
        slope += alpha[i] * kernel(i)
    for _ in range(rounds):
        up, down = np.where(alpha < limit - 1e-12, slope, np.inf), np.where(alpha > 1e-12, slope, -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if slope[j] - slope[i] < 1e-8:
            break
        step = min((slope[j] - slope[i]) / max(2 - 2 * kernel(i)[j], 1e-12), limit - alpha[i], alpha[j])
        alpha[i] += step
        alpha[j] -= step
        slope += step * (kernel(i) - kernel(j))
    free = (alpha > 1e-9) & (alpha < limit - 1e-9)
    offset = float(slope[free].mean()) if free.any() else float((slope[alpha > 1e-9].max() + slope[alpha < 1e-9].min()) / 2) if (alpha < 1e-9).any() else float(slope.max())
    held = alpha > 1e-9
    return x[held], alpha[held], offset, gamma


def one_class_machine(matrix: DataFrame, points: DataFrame, nu: float = NU) -> DataFrame:
    """``id, score, outlier``: decision value of a one-class machine, an outlier below zero; scored by a Column expression."""
    known, new = standardised(matrix, points)
    vectors, weights, offset, gamma = fit_one_class(_collected(known), nu)

    def near(v: np.ndarray) -> Column:
        there = F.array(*map(F.lit, v.tolist()))
        squared = F.aggregate(F.zip_with(F.col("x"), there, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)
        return F.exp(-gamma * squared)

    total = reduce(lambda a, b: a + b, (float(w) * near(v) for v, w in zip(vectors, weights)))
    return new.select("id", (total - offset).alias("score")).withColumn("outlier", F.col("score") < 0)


DETECTORS = {"lof": local_outlier_factor, "isoforest": isolation_forest, "ocsvm": one_class_machine, "dbscan": nearest_distance}


def run_tests(matrix: DataFrame, points: DataFrame, tests: tuple[str, ...] = ("lof",)) -> DataFrame:
    """``id, test, score, outlier`` of each known test; unknown names are passed over."""
    found = [DETECTORS[t](matrix, points).select("id", F.lit(t).alias("test"), "score", "outlier") for t in tests if t in DETECTORS]
    if not found:
        return points.sparkSession.createDataFrame([], "id string, test string, score double, outlier boolean")
    return reduce(DataFrame.unionByName, found)


def vote(results: DataFrame, kind: str = "majority") -> DataFrame:
    """``id, anomaly``: the tests' verdicts together, by ``majority``, ``all``, ``any`` or ``half`` (one test is always half)."""
    flags, n = F.count_if("outlier"), F.count("*")
    rules = {"majority": flags >= F.floor(n / 2) + 1, "all": flags == n, "any": flags > 0, "half": flags >= F.floor(n / 2)}
    return results.groupBy("id").agg(rules.get(kind, F.lit(False)).alias("anomaly"))
