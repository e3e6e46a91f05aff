"""Softmax classification of runs by their diagnostics, evaluated out of fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import stratified_folds
from ..session import written


def out_of_fold(runs: DataFrame, label: str, key: str, features: list[str], k: int = 3) -> DataFrame:
    """Key, label, prediction and confidence of each row by a model fitted on the other folds.

    Missing and non-finite features take the column's mean; features are standardised on the training folds by MLlib. Rows with a
    null label or key are left out; a training set of one class predicts that class.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = runs.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    folds = stratified_folds(rows, label, key, k).select(F.col(key).alias("__k"), "fold")
    clean = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double")).alias(c) for c in features]
    x = written(rows.select(key, label, *clean).join(folds, F.col(key) == F.col("__k")).drop("__k"), "folds")  # read for every fold
    filled = [f"__{c}" for c in features]
    out = None
    for f in range(k):  # a fixed number of folds
        stages = [
            Imputer(inputCols=features, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="__raw"),
            StandardScaler(inputCol="__raw", outputCol="__x", withMean=True),
            StringIndexer(inputCol=label, outputCol="__y", handleInvalid="keep", stringOrderType="alphabetAsc"),
            LogisticRegression(featuresCol="__x", labelCol="__y", family="multinomial", regParam=1e-3),
        ]
        model = Pipeline(stages=stages).fit(x.where(F.col("fold") != f))
        names = F.array(*[F.lit(v) for v in (*model.stages[3].labels, "unknown")])
        p = model.transform(x.where(F.col("fold") == f))
        y = p.select(key, label, F.get(names, F.col("prediction").cast("int")).alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"))
        out = y if out is None else out.unionByName(y)
    return out
