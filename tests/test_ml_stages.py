"""Kernel features and ridge as pyspark.ml stages."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from kinetra.operators import ridge, rocket
from kinetra.operators.pipeline import KernelFeatures, KernelFeaturesModel, RidgeClassifier, RidgeModel


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 2, 40)) + np.sin(np.arange(40) * (y[:, None, None] + 1) / 3) * 2
    return spark.createDataFrame([(i, float(c), v.ravel().tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "row_id long, label double, x array<double>").repartition(4).cache()


def test_fit_save_load_and_transform_agree(windows, tmp_path):
    train, test = windows.where("row_id % 4 > 0"), windows.where("row_id % 4 = 0")
    stages = [KernelFeatures(channels=2, kernels=168), RidgeClassifier()]
    model = Pipeline(stages=stages).fit(train)
    told = model.transform(test).orderBy("row_id").collect()
    assert MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(test)) > 0.9
    assert len(told[0].features) == 168 and len(told[0].rawPrediction) == 3 and told[0].x
    model.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    assert isinstance(again.stages[0], KernelFeaturesModel) and isinstance(again.stages[1], RidgeModel)
    assert again.transform(test).orderBy("row_id").collect() == told
    for stage in stages:
        stage.write().overwrite().save(f"{tmp_path}/stage")
        assert type(stage).load(f"{tmp_path}/stage").extractParamMap().keys() == stage.extractParamMap().keys()
    # The same as the plain classes on arrays.
    f = rocket.Extractor("canonical", 168).fit(train, "x", "row_id", 2)
    a = np.array([r.features for r in f.transform(train, "x").orderBy("row_id").collect()], float)
    y = np.array([r.label for r in train.orderBy("row_id").collect()])
    sd = np.where(a.std(axis=0) < 1e-8, 1, a.std(axis=0))
    plain = ridge.fit((a - a.mean(axis=0)) / sd, y)
    t = (np.array([r.features for r in told], float) - a.mean(axis=0)) / sd
    assert plain.alpha == model.stages[1].ridge.alpha and np.allclose(plain.decide(t), [r.rawPrediction for r in told], atol=1e-6)


def test_transform_before_fit_and_unknown_names(windows):
    with pytest.raises(RuntimeError, match="fit before transform"):
        KernelFeaturesModel().transform(windows)
    with pytest.raises(RuntimeError, match="fit before transform"):
        RidgeModel().transform(windows)
    with pytest.raises(ValueError, match="unknown extractor"):
        KernelFeatures(extractor="unheard", channels=2).fit(windows)


def test_cross_validation(windows):
    features = KernelFeatures(channels=2, kernels=84).fit(windows).transform(windows).cache()
    ridge_ = RidgeClassifier()
    grid = ParamGridBuilder().addGrid(ridge_.alphas, [[1e6], [1.0]]).build()
    best = CrossValidator(estimator=ridge_, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=2, seed=1).fit(features)
    assert len(best.avgMetrics) == 2 and best.bestModel.ridge.alpha in (1.0, 1e6) and max(best.avgMetrics) > 0.8
