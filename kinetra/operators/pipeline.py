"""Kernel features and ridge as stages of pyspark.ml: usable in Pipeline, CrossValidator and evaluators, saved and loaded.

A window is an array column, its channels one after the other. Models hold a kernel bank or coefficients, never rows.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasRawPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators import ridge, rocket

ARRAYS = "name string, shape array<int>, kind string, v array<double>"


class _Writer(MLWriter):
    """Params as metadata, numbers as Parquet beside them."""

    def __init__(self, model: _Saved):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802  the name that pyspark.ml calls
        DefaultParamsWriter.saveMetadata(self.model, path, SparkSession.active())
        rows = [(k, list(v.shape), v.dtype.str, v.astype(float).ravel().tolist()) for k, v in self.model._numbers().items()]
        SparkSession.active().createDataFrame(rows, ARRAYS).coalesce(1).write.parquet(f"{path}/numbers")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Any:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/numbers").collect()  # a model's own numbers
        model = self.cls(**self.cls._of({r.name: np.array(r.v).astype(np.dtype(r.kind)).reshape(r.shape) for r in rows}))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _Saved(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _KernelParams(HasInputCol, HasOutputCol, HasSeed):
    extractor = Param(Params._dummy(), "extractor", "canonical or custom_ppv", TypeConverters.toString)
    kernels = Param(Params._dummy(), "kernels", "number of kernels", TypeConverters.toInt)
    channels = Param(Params._dummy(), "channels", "channels in a window", TypeConverters.toInt)
    identityCol = Param(Params._dummy(), "identityCol", "column that tells windows apart, for the draw of fitting", TypeConverters.toString)  # noqa: N815

    def __init__(self, *given: Any):
        super().__init__(*given)
        self._setDefault(inputCol="x", outputCol="features", identityCol="row_id", channels=1, extractor="canonical", kernels=10_000, seed=42)


class KernelFeatures(Estimator, _KernelParams, MLReadable, MLWritable):
    """Fits a kernel bank to windows; its model turns windows into shares of positive values."""

    @keyword_only
    def __init__(self, *, inputCol: str = "x", outputCol: str = "features", identityCol: str = "row_id", channels: int = 1, extractor: str = "canonical", kernels: int = 10_000, seed: int = 42):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def setParams(self, **given: Any) -> KernelFeatures:  # noqa: N802
        return self._set(**given)

    def _fit(self, dataset: DataFrame) -> KernelFeaturesModel:
        at = self.getOrDefault
        fitted = rocket.Extractor(at("extractor"), at("kernels"), at("seed")).fit(dataset, at("inputCol"), at("identityCol"), at("channels"))
        return self._copyValues(KernelFeaturesModel(fitted.bank))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class KernelFeaturesModel(Model, _KernelParams, _Saved):
    def __init__(self, bank: rocket.Bank | None = None):
        super().__init__()
        self.bank = bank

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.bank is None:
            raise RuntimeError("fit before transform")
        own = rocket.Extractor(self.getOrDefault("extractor"), max(len(self.bank.bias), 1))
        own.bank = self.bank
        return own.transform(dataset, self.getOrDefault("inputCol"), self.getOrDefault("outputCol"), keep=True)

    def _numbers(self) -> dict[str, np.ndarray]:
        b = self.bank
        uses = np.full((len(b.uses), max(map(len, b.uses), default=0)), -1)
        for i, u in enumerate(b.uses):
            uses[i, : len(u)] = u
        return {"channels": np.array([b.channels]), "weights": b.weights, "dilation": b.dilation, "padded": b.padded.astype(np.int8), "uses": uses, "bias": b.bias}

    @staticmethod
    def _of(n: dict[str, np.ndarray]) -> dict[str, Any]:
        return {"bank": rocket.Bank(int(n["channels"][0]), n["weights"], n["dilation"], n["padded"].astype(bool), [u[u >= 0] for u in n["uses"]], n["bias"])}


class _RidgeParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol):
    alphas = Param(Params._dummy(), "alphas", "strengths tried, by exact leave-one-out", TypeConverters.toListFloat)
    byAccuracy = Param(Params._dummy(), "byAccuracy", "the strength by accuracy in place of squared error", TypeConverters.toBoolean)  # noqa: N815
    standardise = Param(Params._dummy(), "standardise", "whether features are scaled by the fitted rows", TypeConverters.toBoolean)

    def __init__(self, *given: Any):
        super().__init__(*given)
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", rawPredictionCol="rawPrediction", alphas=ridge.ALPHAS.tolist(), byAccuracy=False, standardise=True)


class RidgeClassifier(Estimator, _RidgeParams, MLReadable, MLWritable):
    """One-vs-rest ridge on all rows, each left out once to find the strength; features is an array column."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", rawPredictionCol: str = "rawPrediction", alphas: list[float] = ridge.ALPHAS.tolist(), byAccuracy: bool = False, standardise: bool = True):  # noqa: N803, B006
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RidgeModel:
        from kinetra.operators import tall
        from kinetra.operators.adapt import affine

        at = self.getOrDefault
        rows = dataset.select(F.col(at("featuresCol")).alias("features"), F.col(at("labelCol")).cast("double").alias("y"))
        n, mean, sd = tall.moments(rows, "features")
        mean, sd = (mean, np.where(sd < 1e-8, 1, sd)) if at("standardise") else (np.zeros_like(mean), np.ones_like(sd))
        scaled = affine(rows, "features", mean, np.diag(1 / sd), np.zeros(len(mean))) if at("standardise") else rows
        model = ridge.fit_rows(scaled, alphas=np.array(at("alphas")), by_accuracy=at("byAccuracy"))
        coef = model.coef / sd[:, None]
        return self._copyValues(RidgeModel(ridge.Ridge(model.classes, coef, model.intercept - mean @ coef, model.alpha)))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class RidgeModel(Model, _RidgeParams, _Saved):
    def __init__(self, ridge_: ridge.Ridge | None = None):
        super().__init__()
        self.ridge = ridge_

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """dataset with the class of the highest score and all scores (array, in order of the classes)."""
        if self.ridge is None:
            raise RuntimeError("fit before transform")
        return ridge.score(dataset, self.ridge, self.getOrDefault("featuresCol"), self.getOrDefault("predictionCol"), self.getOrDefault("rawPredictionCol"))

    def _numbers(self) -> dict[str, np.ndarray]:
        r = self.ridge
        return {"classes": np.asarray(r.classes), "coef": r.coef, "intercept": r.intercept, "alpha": np.array([r.alpha])}

    @staticmethod
    def _of(n: dict[str, np.ndarray]) -> dict[str, Any]:
        return {"ridge_": ridge.Ridge(n["classes"], n["coef"], n["intercept"], float(n["alpha"][0]))}
