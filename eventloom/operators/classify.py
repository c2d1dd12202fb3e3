"""Classifiers that tell case and activity columns from others by the column features."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions.measures import z_score
from eventloom.model import COLUMN_FEATURES, STANDARD_ACTIVITY, STANDARD_CASE
from eventloom.operators import svm
from eventloom.operators.profile import column_features
from eventloom.operators.reshape import union_all
from eventloom.operators.screening import collect_profiles, screen_fields, timestamp_columns
from eventloom.sources.tables import list_csv, read_csv

SEED = 42
NEIGHBOURS = 5
TRAINING_ROWS = 1000
METHODS = ("logistic", "tree", "rf", "gb", "svm")


def label_of(column: str) -> str:
    return {STANDARD_CASE: "case", STANDARD_ACTIVITY: "activity"}.get(column, "irrelevant")


def training_set(tables: list[DataFrame], screen: bool = True) -> DataFrame:
    """Features and ``label`` of the (screened) columns of tables whose role columns have standard names."""
    parts = []
    for df in tables:
        columns = None
        if screen:
            profiles = collect_profiles(df)
            columns = screen_fields(df, profiles, timestamp_columns(df, profiles))
        if columns is None or columns:
            parts.append(column_features(df, columns))
    if not parts:
        raise ValueError("there is no column to learn from")
    label = F.when(F.col("column") == STANDARD_CASE, "case").when(F.col("column") == STANDARD_ACTIVITY, "activity").otherwise("irrelevant")
    return union_all(parts).withColumn("label", label)


def training_set_from_folder(spark: SparkSession, folder: str, rows: int = TRAINING_ROWS, screen: bool = True) -> DataFrame:
    return training_set([read_csv(spark, path, rows) for path in list_csv(spark, folder)], screen)


def mean_features(features: DataFrame) -> DataFrame:
    """Mean of each feature by ``label``."""
    return features.groupBy("label").agg(*(F.avg(c).alias(c) for c in COLUMN_FEATURES))


def oversampled(rows: DataFrame, target: str, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Add synthetic rows of the rarer class until both are as many (SMOTE).

    A synthetic row lies between a row and one of its nearest neighbours of the class; which, and where, follows from
    hashes.  With fewer than two rows of the class nothing can be added.
    """
    counts = {r[target]: r["n"] for r in rows.groupBy(target).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < 2:
        return rows.select(*COLUMN_FEATURES, target)
    rare = min(counts, key=lambda k: (counts[k], -k))
    few, missing = counts[rare], abs(counts[0] - counts[1])
    vector = F.array(*(F.col(c) for c in COLUMN_FEATURES)).alias("x")
    numbered = rows.where(F.col(target) == rare).select(vector).withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("x")) - 1)  # columns of training tables: few
    other = numbered.select(F.col("i").alias("j"), F.col("x").alias("y"))
    squared = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    near = numbered.crossJoin(other).where("i <> j").withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(squared, "j")) - 1)
    k = min(neighbours, few - 1)
    near = near.where(F.col("r") < k).select("i", "r", "x", "y")
    made = rows.sparkSession.range(missing).select(
        (F.col("id") % few).alias("i"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(k)).alias("r"), (F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(1 << 20)) / (1 << 20)).alias("t")
    )
    between = made.join(near, ["i", "r"]).select(F.zip_with("x", "y", lambda a, b: a + F.col("t") * (b - a)).alias("x"))
    synthetic = between.select(*(F.col("x")[i].alias(c) for i, c in enumerate(COLUMN_FEATURES)), F.lit(rare).alias(target))
    return rows.select(*COLUMN_FEATURES, target).unionByName(synthetic)


def _estimator(method: str, params: dict):
    common = {"featuresCol": "features", "labelCol": "target"}
    kinds = {
        "logistic": lambda: LogisticRegression(**common, **({"maxIter": 1000, "regParam": 0.01} | params)),
        "tree": lambda: DecisionTreeClassifier(**common, **({"seed": SEED, "maxDepth": 30} | params)),
        "rf": lambda: RandomForestClassifier(**common, **({"seed": SEED, "numTrees": 100} | params)),
        "gb": lambda: GBTClassifier(**common, **({"seed": SEED, "maxIter": 100, "maxDepth": 3} | params)),
    }
    return kinds[method]()


@dataclass
class ColumnClassifiers:
    """Means and deviations of the features, and a model per role: a pipeline on z-scores, or support vectors (``svm``)."""

    method: str
    means: list[float]
    deviations: list[float]
    case: Model | svm.SupportVectors | None
    activity: Model | svm.SupportVectors | None

    def scaled(self, features: DataFrame) -> DataFrame:
        """With the z-scores of the features."""
        return features.withColumns({f"z_{c}": z_score(F.col(c), F.lit(m), F.lit(d)) for c, m, d in zip(COLUMN_FEATURES, self.means, self.deviations)})

    def score(self, features: DataFrame) -> DataFrame:
        """``ordinal, column, p_case, p_activity``."""
        rows = self.scaled(features)
        keep = ["ordinal", "column"]
        if self.method == "svm":
            inputs = F.array(*(F.col(f"z_{c}") for c in COLUMN_FEATURES))
            return rows.select(*keep, self.case.probability(inputs).alias("p_case"), self.activity.probability(inputs).alias("p_activity"))
        case = self.case.transform(rows).select(*keep, vector_to_array("probability")[1].alias("p_case"))
        activity = self.activity.transform(rows).select(*keep, vector_to_array("probability")[1].alias("p_activity"))
        return case.join(activity, keep)

    def save(self, path: str) -> None:
        """The models and a small description under the folder ``path``."""
        spark = SparkSession.getActiveSession()
        said = {"method": self.method, "means": self.means, "deviations": self.deviations}
        if self.method == "svm":
            said |= {"case": self.case.described(), "activity": self.activity.described()}
        else:
            self.case.write().overwrite().save(f"{path}/case")
            self.activity.write().overwrite().save(f"{path}/activity")
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/description")

    @classmethod
    def load(cls, spark: SparkSession, path: str, method: str | None = None) -> ColumnClassifiers:
        said = json.loads(spark.read.text(f"{path}/description").first()[0])
        if method is not None and said["method"] != method:
            raise ValueError(f"{path} holds classifiers of method {said['method']!r}")
        models = [svm.SupportVectors(**said[r]) if said["method"] == "svm" else PipelineModel.load(f"{path}/{r}") for r in ("case", "activity")]
        return cls(said["method"], said["means"], said["deviations"], *models)


def train_classifiers(features: DataFrame, method: str = "logistic", params: dict | None = None) -> ColumnClassifiers:
    """A classifier per role, one against the rest, on standardised features with the rarer class oversampled among them.

    ``params`` go to the method's estimator (``cost`` and ``gamma`` to ``svm``).
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    features = features.cache()  # a row per column of the training tables
    stats = features.agg(*(F.avg(c).alias(f"m_{c}") for c in COLUMN_FEATURES), *(F.stddev_pop(c).alias(f"d_{c}") for c in COLUMN_FEATURES)).first()
    if stats[f"m_{COLUMN_FEATURES[0]}"] is None:
        raise ValueError("there is no column to learn from")
    found = ColumnClassifiers(method, [stats[f"m_{c}"] for c in COLUMN_FEATURES], [stats[f"d_{c}"] for c in COLUMN_FEATURES], None, None)
    scaled = found.scaled(features).select("label", *(F.col(f"z_{c}").alias(c) for c in COLUMN_FEATURES))
    for role in ("case", "activity"):
        marked = scaled.withColumn("target", (F.col("label") == role).cast("int"))
        # fitting reads it over and over, in many short jobs: a row per column of the training tables, twice at most
        balanced = oversampled(marked, "target").withColumnsRenamed({c: f"z_{c}" for c in COLUMN_FEATURES}).coalesce(1).cache()
        names = [f"z_{c}" for c in COLUMN_FEATURES]
        if method == "svm":
            rows = balanced.orderBy(*names, "target").collect()
            model = svm.fit(np.array([[r[c] for c in names] for r in rows], float), np.array([r["target"] == 1 for r in rows]), **(params or {}))
        else:
            model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), _estimator(method, params or {})]).fit(balanced)
        balanced.unpersist()
        setattr(found, role, model)
    features.unpersist()
    return found
