"""Novelty tests against independent numpy versions, classifiers, and the whole validation."""

import numpy as np
import pytest

from eventloom import api
from eventloom.model import COLUMN_FEATURES, LOG_FEATURES
from eventloom.operators import classify, novelty, validate

KINDS = "id long, " + ", ".join(f"{c} double" for c in LOG_FEATURES)


@pytest.fixture(scope="module")
def logs(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 6)), np.vstack([rng.normal(size=(4, 6)), np.full((1, 6), 8.0)])
    make = lambda m: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], KINDS)
    return x, y, make(x), make(y)


def by_id(df):
    return [r for r in sorted(df.collect(), key=lambda r: r["id"])]


def test_nearest(logs):
    x, y, known, new = logs
    m, d = x.mean(0), x.std(0)
    expected = [np.sqrt((((x - m) / d - (p - m) / d) ** 2).sum(1)).min() for p in y]
    got = by_id(novelty.nearest_distance(known, new))
    assert [r["score"] for r in got] == pytest.approx(expected) and got[-1]["outlier"]


def test_local_outlier_factor(logs):
    x, y, known, new = logs
    m, d, k = x.mean(0), x.std(0), novelty.LOF_NEIGHBOURS
    a, b = (x - m) / d, (y - m) / d
    inside = np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1))
    np.fill_diagonal(inside, np.inf)
    order = np.argsort(inside, axis=1)[:, :k]
    reach = np.sort(inside, axis=1)[:, k - 1]
    density = np.array([1 / (np.mean([max(reach[o], inside[i, o]) for o in order[i]]) + 1e-10) for i in range(len(a))])
    expected = []
    for p in b:
        far = np.sqrt(((a - p) ** 2).sum(1))
        near = np.argsort(far)[:k]
        expected.append(density[near].mean() * (np.mean([max(reach[o], far[o]) for o in near]) + 1e-10))
    got = by_id(novelty.local_outlier_factor(known, new))
    assert [r["score"] for r in got] == pytest.approx(expected) and got[-1]["outlier"]


@pytest.mark.parametrize("test", ["isoforest", "ocsvm"])
def test_fitted_detectors_rank_the_outlier_last(logs, test):
    _, _, known, new = logs
    got = by_id(novelty.DETECTORS[test](known, new))
    scores = [r["score"] if test == "isoforest" else -r["score"] for r in got]
    assert got[-1]["outlier"] and scores[-1] == max(scores)


def test_one_class_machine_solves_its_dual():
    x = np.random.default_rng(0).normal(size=(60, 6))
    vectors, weights, offset, gamma = novelty.fit_one_class(x)
    kernel = lambda p: np.exp(-gamma * ((vectors - p) ** 2).sum(1)) @ weights
    assert weights.sum() == pytest.approx(1) and weights.max() <= 1 / (0.05 * 60) + 1e-9
    outside = sum(kernel(p) < offset - 1e-6 for p in x)
    assert outside <= 0.05 * 60
    # at the optimum no weight can move downhill: free vectors lie on the boundary, full ones outside it
    own = np.array([kernel(v) for v in vectors])
    free = weights < 1 / (0.05 * 60) - 1e-9
    assert own[free] == pytest.approx(offset, abs=1e-6) and (own[~free] <= offset + 1e-6).all()


def test_other_methods_fall_back_without_classifiers(spark, caplog):
    from eventloom.operators import scoring
    from eventloom.plans import catalogue

    df = catalogue.tickets(spark, "/root/testdata/sf0.001")
    assert scoring.suggest_columns(df, method="rf") == scoring.suggest_columns(df)
    assert "no classifiers" in caplog.text


def test_small_and_constant_matrices(spark, logs):
    one = spark.createDataFrame([(0, *[1.0] * 6)], KINDS)
    assert novelty.nearest_distance(one, one).first()["score"] == 0.0
    two = spark.createDataFrame([(0, *[1.0] * 6), (1, *[2.0] * 6)], KINDS)
    assert novelty.local_outlier_factor(two, two).count() == 2


@pytest.mark.parametrize(
    "flags, verdicts",
    [([True], "1111"), ([False], "0001"), ([True, False], "0011"), ([True, True], "1111"), ([True, False, False], "0011"), ([True, True, False, False], "0011"), ([False, False], "0000")],
)
def test_votes(spark, flags, verdicts):
    rows = spark.createDataFrame([(1, str(i), 0.0, f) for i, f in enumerate(flags)], "id long, test string, score double, outlier boolean")
    got = "".join(str(int(novelty.vote(rows, k).first()["anomaly"])) for k in ("majority", "all", "any", "half"))
    assert got == verdicts == "".join(str(int(validate._voted(flags, k))) for k in ("majority", "all", "any", "half"))


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(48):
        label = ["case", "activity", "irrelevant", "irrelevant"][i % 4]
        centre = {"case": (0.9, 0.05, 8, 0.5, 1), "activity": (0.05, 0.4, 2, 0.2, 4), "irrelevant": (0.4, 0.2, 5, 0.9, 9)}[label]
        rows.append((i, f"c{i}", *(float(c + rng.normal() * 0.02 * (1 + c)) for c in centre), label))
    return spark.createDataFrame(rows, "ordinal int, column string, " + ", ".join(f"{c} double" for c in COLUMN_FEATURES) + ", label string").cache()


@pytest.mark.parametrize("method", classify.METHODS)
def test_classifiers(training, method, tmp_path, spark):
    params = {"gb": {"maxIter": 5}, "rf": {"numTrees": 10}}.get(method)
    found = classify.train_classifiers(training, method, params)
    got = {r["column"]: r for r in found.score(training).collect()}
    labels = {r["column"]: r["label"] for r in training.collect()}
    assert all((got[c]["p_case"] > 0.5) == (label == "case") for c, label in labels.items())
    if method in ("logistic", "svm"):
        found.save(str(tmp_path))
        again = classify.ColumnClassifiers.load(spark, str(tmp_path), method)
        assert {r["column"]: r["p_case"] for r in again.score(training).collect()} == pytest.approx({c: r["p_case"] for c, r in got.items()})
        with pytest.raises(ValueError):
            classify.ColumnClassifiers.load(spark, str(tmp_path), "tree")


def test_unknown_method(training):
    with pytest.raises(ValueError):
        classify.train_classifiers(training, "magic")


def test_oversampling_balances(training):
    from pyspark.sql import functions as F

    marked = training.withColumn("target", (F.col("label") == "case").cast("int"))
    got = {r["target"]: r["count"] for r in classify.oversampled(marked, "target").groupBy("target").count().collect()}
    assert got == {0: 36, 1: 36}


@pytest.fixture(scope="module")
def tickets(spark):
    rows = [(f"T{i // 3}", ["open", "held", "closed"][i % 3], f"2020-01-{1 + i // 3:02d} 1{i % 3}:00:00") for i in range(60)]
    return spark.createDataFrame(rows, "ticket string, status string, at string")


def test_validation_end_to_end(tickets, spark):
    ok, found = api.validate_event_log(tickets)
    assert ok and {"timestamp": "at", "case": "ticket", "activity": "status"} in found
    assert api.validate_event_log(tickets.drop("at")) == (False, [])
    ok, found = api.validate_event_log(tickets, candidates=[("at", "ticket", "status"), ("at", "at", "status")])
    assert found == [{"timestamp": "at", "case": "ticket", "activity": "status"}]


def test_strict_validation_uses_the_matrix(tickets, spark):
    rows = [(i, 1000.0 + i, 50.0 + i, 30.0 + i, 900.0 + i, 20.0 + i, 0.1 + i / 1000) for i in range(12)]
    matrix = spark.createDataFrame(rows, KINDS)
    assert api.validate_event_log(tickets, [("at", "ticket", "status")], matrix, ("dbscan", "lof"), "majority", strict=True) == (False, [])


def test_public_statistics(tickets):
    got = api.get_event_log_statistic(tickets, "ticket", "status", "at")
    assert got["num_cases"] == 20 and got["num_variants"] == 1 and got["dfg_density"] == pytest.approx(2 / 9)
    assert api.convert_to_event_log(tickets, "ticket", "status", "at").count() == 60
    assert api.suggest_mandatory_column_candidates(tickets)


def test_support_vectors_meet_the_optimality_conditions():
    from eventloom.operators import svm

    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(1.5, 1, (30, 3))])
    positive = np.arange(70) >= 40
    found = svm.fit(x, positive)
    margin = np.where(positive, 1, -1) * found.decide(x)
    weight = {tuple(v): abs(w) for v, w in zip(found.vectors, found.weights)}
    assert sum(found.weights) == pytest.approx(0, abs=1e-9) and max(weight.values()) <= 1 + 1e-9
    for row, m in zip(x.tolist(), margin):  # outside the margin no weight, inside it all of it, on it any
        w = weight.get(tuple(row), 0.0)
        assert (w < 1e-9 and m >= 1 - 5e-3) or (w > 1 - 1e-9 and m <= 1 + 5e-3) or m == pytest.approx(1, abs=5e-3)
    chance = 1 / (1 + np.exp(found.slope * found.decide(x) + found.shift))
    assert found.slope < 0 and ((chance > 0.5) == positive).mean() > 0.8 and 0 < chance.min() < chance.max() < 1
    assert svm.fit(x[:5], positive[:5]).decide(x).tolist() == [-1.0] * 70
