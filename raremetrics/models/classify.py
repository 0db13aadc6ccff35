"""Presence/absence classifiers on MLlib with cross-validation.

Every learner is an MLlib estimator trained on a features vector; repeated stratified
folds come from ``sampling.cv_folds`` (a fold column) so CV is reproducible."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, NaiveBayes, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 666
#: Learners that are fitted at the same time.
PARALLEL_FITS = 2


def learners(label: str = "label", features: str = "features") -> dict:
    """The learner set of the model comparison, with the reference's tree settings."""
    return {
        "glm": LogisticRegression(labelCol=label, featuresCol=features, maxIter=100),
        "gbm": GBTClassifier(labelCol=label, featuresCol=features, maxDepth=5, stepSize=0.01,
                             subsamplingRate=0.5, maxIter=100, seed=SEED),
        "tree": DecisionTreeClassifier(labelCol=label, featuresCol=features, seed=SEED),
        "rf": RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=100, seed=SEED),
        "nb": NaiveBayes(labelCol=label, featuresCol=features, modelType="gaussian"),
        "svm": LinearSVC(labelCol=label, featuresCol=features, maxIter=100),
    }


def fit_all(learners: dict, train: DataFrame) -> dict:
    """The fitted model of each learner.

    Boosting is hundreds of short jobs in sequence that do not fill the cores, so it
    runs beside the other fits; more at once would hold more copies of the rows in memory.
    """
    order = sorted(learners, key=lambda name: not isinstance(learners[name], GBTClassifier))
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        fit = inheritable_thread_target(train.sparkSession)(lambda name: learners[name].fit(train))
        fits = {name: pool.submit(fit, name) for name in order}
        return {name: fits[name].result() for name in learners}


def positive_score(pred: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the positive class (or the raw margin for margin-only learners)."""
    col = "probability" if "probability" in pred.columns else "rawPrediction"
    return pred.withColumn(out, vector_to_array(F.col(col))[1])


def cross_validate(learner, train: DataFrame, label: str = "label", fold_col: str = "fold",
                   grid=None, parallelism: int = 1, num_folds: int = 10):
    """CV with a given 0-based fold column, AUC as the metric; returns the CV model."""
    ev = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    cv = CrossValidator(estimator=learner, estimatorParamMaps=grid or ParamGridBuilder().build(), evaluator=ev,
                        foldCol=fold_col, numFolds=num_folds, parallelism=parallelism, seed=SEED)
    return cv.fit(train)


def importance(model, names: list[str]) -> list[tuple[str, float]]:
    """Tree-ensemble importances mapped back to input names, largest first."""
    imp = model.featureImportances.toArray()
    return sorted(zip(names, [float(v) for v in imp]), key=lambda t: -t[1])
