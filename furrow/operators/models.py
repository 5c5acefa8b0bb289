"""Baseline models on Spark ML (our choice of features and estimators)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import shared_dir


#: Most different values of a category: they are collected, and each is a coefficient. :func:`fold_errors` has no such bound.
MOST_CATEGORIES = 10_000


def _indexer(df: DataFrame, columns: Sequence[str]) -> StringIndexerModel:
    """The values of categories, found in one pass; more than MOST_CATEGORIES are an error, and none is cut off."""
    indexer = StringIndexer(inputCols=list(columns), outputCols=[f"__{c}_index" for c in columns], handleInvalid="keep",
                            stringOrderType="alphabetAsc")
    model = indexer.fit(df)
    for column, labels in zip(columns, model.labelsArray):
        if len(labels) > MOST_CATEGORIES:
            raise ValueError(f"{len(labels)} categories in {column}; at most {MOST_CATEGORIES} are fitted")
    return model


def _features(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], full_rank: bool) -> list:
    """Stages up to a vector of features. Of full rank it lacks the first value of each category, and has none for unknown values."""
    stages: list = []
    vectors = list(numbers)
    if categories:
        index = _indexer(df, categories)
        stages += [index, OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"__{c}_vector" for c in categories])]
        for column, labels in zip(categories, index.labelsArray):
            name = f"__{column}_vector"
            if full_rank and len(labels) > 1:
                stages.append(VectorSlicer(inputCol=name, outputCol=f"__{column}_levels", indices=list(range(1, len(labels)))))
                name = f"__{column}_levels"
            if len(labels) > 1 or not full_rank:
                vectors.append(name)
    stages.append(VectorAssembler(inputCols=vectors, outputCol="__features", handleInvalid="skip"))
    return stages


def split_rows(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a seeded hash of the key: the same rows whatever the partitioning."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(10_000))
    is_test = bucket < int(test_share * 10_000)
    return df.where(~is_test), df.where(is_test)


def yield_regression(df: DataFrame, label: str, categories: Sequence[str] = (), numbers: Sequence[str] = ()) -> PipelineModel:
    """Linear regression of a yield on crop, region and costs, solved exactly in one pass: its features are of full rank."""
    model = LinearRegression(featuresCol="__features", labelCol=label, predictionCol="prediction", solver="normal")
    return Pipeline(stages=[*_features(df, categories, numbers, True), model]).fit(df)


def crop_classifier(df: DataFrame, label: str, categories: Sequence[str] = (), numbers: Sequence[str] = (), seed: int = 42) -> PipelineModel:
    """Random forest for a crop label the user brings."""
    labels = _indexer(df, [label]).labelsArray[0]
    target = StringIndexerModel.from_labels(labels, inputCol=label, outputCol="__label", handleInvalid="error")
    model = RandomForestClassifier(featuresCol="__features", labelCol="__label", predictionCol="prediction", seed=seed)
    return Pipeline(stages=[target, *_features(df, categories, numbers, False), model]).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The table with a column ``prediction``: NULL from a regression for values of a category that its training lacked."""
    fitted = model.transform(df)
    known = F.lit(True)
    if isinstance(model.stages[-1], LinearRegressionModel):
        for stage in model.stages:
            if isinstance(stage, StringIndexerModel):
                for column, labels in zip(stage.getOutputCols(), stage.labelsArray):
                    known = known & (F.col(column) < len(labels))
    return fitted.select(*df.columns, F.when(known, F.col("prediction")).alias("prediction"))


def fold_errors(df: DataFrame, label: str, category: str, numbers: Sequence[str], fold: Column) -> DataFrame:
    """(fold, n_train, n_test, n_unknown, rmse): the error on each fold of a regression fitted on all others.

    The regression has a level for every value of ``category``, however many there are: they are absorbed by means. All that
    is needed are sums per value and fold, so the rows are read once and shuffled as sums. Of the sums, the slopes need
    one row per fold on the driver. ``n_unknown`` rows have a value that the other folds lack, and are left out of
    the error, which is NULL without any rows. Rows with a missing cell are left out of everything.
    """
    shared_dir(df.sparkSession)
    names = [label, *numbers]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    value = {i: F.col(f"__v{i}") for i in range(len(names))}
    rows = df.select(F.col(category).alias("__c"), fold.alias("fold"), *[F.col(n).cast("double").alias(f"__v{i}") for i, n in enumerate(names)]).dropna()
    # Sums of differences from a typical value, so that squares stay small.
    middle = rows.agg(*[F.avg(f"__v{i}").alias(f"__v{i}") for i in value])
    centred = [value[i] - middle.select(f"__v{i}").scalar() for i in value]
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(centred[i]).alias(f"s{i}") for i in value]]
    sums += [F.sum(centred[i] * centred[j]).alias(f"p{i}_{j}") for i, j in pairs]
    columns = ["n", *[f"s{i}" for i in value], *[f"p{i}_{j}" for i, j in pairs]]
    parts = rows.groupBy("__c", "fold").agg(*sums)
    whole = Window.partitionBy("__c")  # as many rows as a value has folds
    parts = parts.select("*", *[(F.sum(c).over(whole) - F.col(c)).alias(f"other_{c}") for c in columns]).checkpoint()

    def within(prefix: str, i: int, j: int) -> Column:
        """Sum of products around the means of a value, from sums."""
        part = {c: F.col(f"{prefix}{c}") for c in columns}
        return F.when(part["n"] > 0, part[f"p{i}_{j}"] - part[f"s{i}"] * part[f"s{j}"] / part["n"]).otherwise(0.0)

    both = {c: (F.col(c) + F.col(f"other_{c}")).alias(c) for c in columns}
    values = parts.groupBy("__c").agg(*[F.first(both[c]).alias(c) for c in columns])
    total = values.agg(*[F.sum(within("", i, j)).alias(f"w{i}_{j}") for i, j in pairs], F.sum("n").alias("n")).first()
    all_of = parts.select("fold", "n", *[F.col(f"other_{c}") for c in columns], *[F.col(f"{c}").alias(f"own_{c}") for c in columns[1:]],
                          *[(F.col(c) + F.col(f"other_{c}")).alias(f"all_{c}") for c in columns])
    change = [F.sum(within("other_", i, j) - within("all_", i, j)).alias(f"w{i}_{j}") for i, j in pairs]
    slopes = []
    for row in all_of.groupBy("fold").agg(*change).collect():
        w = {(i, j): total[f"w{i}_{j}"] + row[f"w{i}_{j}"] for i, j in pairs}
        size = len(numbers)
        a = np.array([[w[min(i, j), max(i, j)] for j in range(1, size + 1)] for i in range(1, size + 1)]).reshape(size, size)
        b = np.array([w[0, j] for j in range(1, size + 1)])
        slopes.append((row["fold"], [float(x) for x in np.linalg.lstsq(a, b, rcond=1e-12)[0]]))
    fields = f"fold {rows.schema['fold'].dataType.simpleString()}, slopes array<double>"
    fitted = all_of.join(df.sparkSession.createDataFrame(slopes, fields), "fold")
    known = F.col("other_n") > 0

    def around(i: int, j: int) -> Column:
        """Sum of products of a fold's rows around the means of the other folds."""
        a, b = (F.col(f"other_s{k}") / F.col("other_n") for k in (i, j))
        return F.col(f"own_p{i}_{j}") - a * F.col(f"own_s{j}") - b * F.col(f"own_s{i}") + F.col("n") * a * b

    slope = {0: F.lit(-1.0), **{k: F.col("slopes")[k - 1] for k in range(1, len(names))}}
    square = sum((slope[i] * slope[j] * around(i, j) * (1 if i == j else 2) for i, j in pairs), F.lit(0.0))
    n_known = F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0.0))
    return fitted.groupBy("fold").agg(
        (F.lit(total["n"]) - F.sum("n")).cast("long").alias("n_train"),
        F.sum("n").cast("long").alias("n_test"),
        (F.sum("n") - n_known).cast("long").alias("n_unknown"),
        F.sqrt(F.try_divide(F.greatest(F.sum(F.when(known, square)), F.lit(0.0)), n_known)).alias("rmse"),
    )
