"""Missing-value imputation."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import missing_flag
from ..session import spread


def impute_bagged(df: DataFrame, target: str, features: list[str], n_trees: int = 10, seed: int = 666,
                  round_result: bool = True, max_depth: int = 10) -> DataFrame:
    """Q1: bagged-tree imputation of ``target`` from ``features``.

    Bagging = random forest with every feature considered at each split
    (``featureSubsetStrategy='all'``), trained on rows where the target is present and
    distributed by MLlib. Adds ``<target>_missing`` (Y/N) and ``<target>_ori``; the
    imputed column is rounded half-even like R's ``round``.
    """
    flagged = df.withColumns({f"{target}_missing": missing_flag(target), f"{target}_ori": F.col(target)})
    va = VectorAssembler(inputCols=features, outputCol="__feat", handleInvalid="keep")
    train = spread(va.transform(flagged.filter(F.col(target).isNotNull())).select(target, "__feat"))
    rf = RandomForestRegressor(featuresCol="__feat", labelCol=target, numTrees=n_trees, bootstrap=True,
                               featureSubsetStrategy="all", subsamplingRate=1.0, maxDepth=max_depth, seed=seed)
    model = rf.fit(train)
    pred = model.transform(va.transform(flagged)).withColumnRenamed("prediction", "__pred")
    filled = F.coalesce(F.col(target), F.col("__pred"))
    if round_result:
        filled = F.bround(filled, 0)
    return pred.withColumn(target, filled).drop("__feat", "__pred")
