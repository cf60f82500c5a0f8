"""Models that score candidates and texts, fitted with Spark ML on the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, FeatureHasher, HashingTF, NGram, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspan.sources import artifacts


def _typed(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, F.col(label).cast("double"))


def hashed_logistic(train: DataFrame, features: list[str], label: str = "y", size: int = 1 << 20, rounds: int = 20, strength: float = 1e-6) -> PipelineModel:
    """Logistic regression on hashed features (numbers as they are, strings as indicators)."""
    strings = [c for c in features if dict(train.dtypes)[c] == "string"]
    hasher = FeatureHasher(inputCols=features, outputCol="_hashed", numFeatures=size, categoricalCols=strings)
    model = LogisticRegression(featuresCol="_hashed", labelCol=label, maxIter=rounds, regParam=strength, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c")
    return Pipeline(stages=[hasher, model]).fit(_typed(train, label))


def boosted_trees(train: DataFrame, numbers: list[str], categories: list[str], label: str = "y", trees: int = 20, depth: int = 5, bins: int = 64) -> PipelineModel:
    """Gradient-boosted trees on numbers and indexed categories; unseen categories get an index of their own."""
    indexed = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep") for c in categories]
    assembler = VectorAssembler(inputCols=[*numbers, *[f"_i_{c}" for c in categories]], outputCol="_v", handleInvalid="keep")
    size = max([bins, *[train.select(c).distinct().count() + 2 for c in categories]])
    model = GBTClassifier(featuresCol="_v", labelCol=label, maxIter=trees, maxDepth=depth, maxBins=size, seed=2026)
    return Pipeline(stages=[*indexed, assembler, model]).fit(_typed(train, label))


def style_classifier(train: DataFrame, text: str = "text", label: str = "y", size: int = 1 << 18, rounds: int = 20) -> PipelineModel:
    """Logistic regression on TF-IDF of words and word pairs."""
    words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    pairs = NGram(n=2, inputCol="_w", outputCol="_n")
    counts = [HashingTF(inputCol=c, outputCol=f"_t{c}", numFeatures=size) for c in ("_w", "_n")]
    joined = VectorAssembler(inputCols=["_t_w", "_t_n"], outputCol="_tf")
    weights = IDF(inputCol="_tf", outputCol="_x", minDocFreq=2)
    model = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=rounds, regParam=1e-4, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c")
    return Pipeline(stages=[words, pairs, *counts, joined, weights, model]).fit(_typed(train, label))


def linear_probe(train: DataFrame, numbers: list[str], label: str = "y", strength: float = 1.0, weight: str | None = None) -> PipelineModel:
    """L2 logistic probe on numbers standardized by the training rows."""
    assembler = VectorAssembler(inputCols=numbers, outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)
    extra = {"weightCol": weight} if weight else {}
    n = max(1, train.count())
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=strength / n, standardization=False, maxIter=50, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", **extra)
    return Pipeline(stages=[assembler, scaler, model]).fit(_typed(train, label))


def probability(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """``df`` with the model's probability of label 1."""
    out = model.transform(df)
    column = "_p" if "_p" in out.columns else "probability"
    return out.select(*[F.col(f"`{c}`") for c in df.columns], vector_to_array(F.col(column))[1].alias(name))


def save_model(model: PipelineModel, path: str) -> str:
    """Write a fitted model; its digest."""
    model.write().save(path)
    return artifacts.digest(SparkSession.active(), path)


def load_model(path: str, digest: str) -> PipelineModel:
    """A model as it was written; an error if a file has changed since."""
    if artifacts.digest(SparkSession.active(), path) != digest:
        raise artifacts.ArtifactError("the model has changed")
    return PipelineModel.load(path)


def out_of_fold(df: DataFrame, fold: str, folds: int, fit, name: str = "score") -> DataFrame:
    """``df`` with each row scored by the model fitted on the other folds."""
    out = None
    for f in range(folds):
        part = probability(fit(df.where(F.col(fold) != f)), df.where(F.col(fold) == f), name)
        out = part if out is None else out.unionByName(part)
    return out


def linear_emissions(features: DataFrame, weights: DataFrame, key: list[str]) -> DataFrame:
    """(key, label, emission): the summed weights of each token's features for each label."""
    return features.join(weights, "feature").groupBy(*key, "label").agg(F.sum(F.coalesce("value", F.lit(1.0)) * F.col("weight")).alias("emission"))


def ensemble(parts: list[Column]) -> Column:
    """The mean of several models' scores."""
    return sum(parts[1:], parts[0]) / F.lit(float(len(parts)))


def logits_to_energies(logits: np.ndarray, tau: float = 1.0) -> np.ndarray:
    """Energies of the labels against the first column (no entity), over a temperature."""
    return (logits[:, 1:].astype(np.float64) - logits[:, :1]) / tau
