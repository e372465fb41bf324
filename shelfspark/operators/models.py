"""Classifiers, rankers and encoders of Spark's machine-learning library, and a versioned registry."""

from __future__ import annotations

import json
import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Labelled rows a model is fitted on at most.
FIT_ROWS = 50_000


def fit_rows(rows: DataFrame, key: str, most: int = FIT_ROWS) -> DataFrame:
    """The rows a model is fitted on: all, or the first ``most`` in hashed order (the bound of the fit)."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def department_model(labelled: DataFrame, terms: str, label: str, features: int = 1 << 14) -> PipelineModel:
    """TF-IDF over terms and a multinomial logistic regression."""
    stages = [
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip"),
        HashingTF(inputCol=terms, outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(maxIter=15, regParam=0.001),
    ]
    return Pipeline(stages=stages).fit(labelled)


def label_classifier(pairs: DataFrame, features: list[str], label: str) -> PipelineModel:
    """A forest over features for the relevance label, with a probability per label."""
    stages = [StringIndexer(inputCol=label, outputCol="label_no", stringOrderType="alphabetAsc", handleInvalid="skip"), VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), RandomForestClassifier(labelCol="label_no", numTrees=20, maxDepth=6, seed=3)]
    return Pipeline(stages=stages).fit(pairs)


def rerank(rows: DataFrame, query: str, score: str, model_score: str, rank: str, depth: int) -> DataFrame:
    """``final`` and ``rk``: the first ``depth`` of each query in the order of the model, the rest below its least score in their own order."""
    own = Window.partitionBy(query)
    inside = F.col(rank) <= depth
    least = F.min(F.when(inside, F.col(model_score))).over(own)
    made = rows.withColumn("final", F.when(inside, F.col(model_score)).otherwise(least - 1 - (F.col(rank) - depth - 1) * 1e-3))
    return made.withColumn("rk", F.row_number().over(own.orderBy(F.desc("final"), F.desc(score), F.asc("doc_id"))).cast("long"))


def ranking_model(pairs: DataFrame, features: list[str], gain: str) -> PipelineModel:
    """Boosted trees on graded gains, pointwise."""
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTRegressor(labelCol=gain, featuresCol="features", maxIter=10, maxDepth=4, seed=3)]
    return Pipeline(stages=stages).fit(pairs)


def encoder(texts: DataFrame, terms: str, size: int = 32) -> PipelineModel:
    """Mean word vectors as the encoder of texts."""
    return Pipeline(stages=[Word2Vec(inputCol=terms, outputCol="vector", vectorSize=size, minCount=2, seed=3, maxIter=1)]).fit(texts)


class Registry:
    """Models by name and version under a folder of the file system Spark uses, with aliases."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _meta(self) -> DataFrame:
        return self.spark.read.schema("name string, version string, alias string, meta string, at double").json(f"{self.root}/log")

    def _log(self, name: str, version: str, alias: str | None, meta: dict) -> None:
        row = [(name, version, alias, json.dumps(meta), time.time())]
        self.spark.createDataFrame(row, "name string, version string, alias string, meta string, at double").write.mode("append").json(f"{self.root}/log")

    def register(self, name: str, version: str, model: PipelineModel, meta: dict | None = None) -> None:
        model.write().save(f"{self.root}/{name}/{version}")
        self._log(name, version, "candidate", meta or {})

    def promote(self, name: str, version: str, alias: str = "production") -> None:
        self._log(name, version, alias, {})

    def resolve(self, name: str, alias: str = "production") -> str | None:
        """The version an alias points to; None if it points to none."""
        row = self._meta().where((F.col("name") == name) & (F.col("alias") == alias)).orderBy(F.desc("at")).first()
        return row.version if row else None

    def listing(self) -> DataFrame:
        """``name``, ``version``, its latest ``alias`` and ``meta`` of every registered model."""
        log = self._meta()
        meta = F.max_by("meta", F.when(F.col("alias") == "candidate", F.col("at")))
        return log.groupBy("name", "version").agg(F.max_by("alias", "at").alias("alias"), meta.alias("meta"))

    def load(self, name: str, alias: str = "production") -> PipelineModel:
        return PipelineModel.load(f"{self.root}/{name}/{self.resolve(name, alias)}")
