"""Feature pipelines and models on pyspark.ml, and gradient descent written as aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLASSIFIERS = {
    "logistic": lambda **o: LogisticRegression(**o),
    "forest": lambda **o: RandomForestClassifier(**({"numTrees": 200, "seed": 42} | o)),
    "boosted": lambda **o: GBTClassifier(**({"maxIter": 20, "seed": 42} | o)),
    "svm": lambda **o: LinearSVC(**o),
    "dense": lambda **o: MultilayerPerceptronClassifier(**({"seed": 42} | o)),
}
REGRESSORS = {
    "linear": lambda **o: LinearRegression(**({"solver": "normal"} | o)),
    "forest": lambda **o: RandomForestRegressor(**({"numTrees": 200, "seed": 42} | o)),
    "boosted": lambda **o: GBTRegressor(**({"maxIter": 20, "stepSize": 0.05, "maxDepth": 6, "seed": 42} | o)),
}


def assembled(features: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Stages: one indexer per text column (codes in lexicographic order), then a vector."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}__code", stringOrderType="alphabetAsc", handleInvalid="keep") for c in categorical]
    return [*index, VectorAssembler(inputCols=[*features, *(f"{c}__code" for c in categorical)], outputCol="features", handleInvalid="skip")]


PART = 200_000  # rows


def in_parts(df: DataFrame, kind: str) -> DataFrame:
    """Trees read their cached rows once a level: in parts of bounded size, so that no task's share grows with the table."""
    if kind not in ("forest", "boosted"):
        return df
    parts = -(-df.count() // PART)
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def fit_classifier(df: DataFrame, label: str, features: Sequence[str], kind: str = "logistic", categorical: Sequence[str] = (), **options) -> PipelineModel:
    if kind not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {kind!r}; known: {sorted(CLASSIFIERS)}")
    model = CLASSIFIERS[kind](**options).setLabelCol(label).setFeaturesCol("features")
    return Pipeline(stages=[*assembled(features, categorical), model]).fit(in_parts(df, kind))


def fit_regressor(df: DataFrame, label: str, features: Sequence[str], kind: str = "linear", categorical: Sequence[str] = (), **options) -> PipelineModel:
    if kind not in REGRESSORS:
        raise ValueError(f"unknown regressor {kind!r}; known: {sorted(REGRESSORS)}")
    model = REGRESSORS[kind](**options).setLabelCol(label).setFeaturesCol("features")
    return Pipeline(stages=[*assembled(features, categorical), model]).fit(in_parts(df, kind))


def risk_list(model: PipelineModel, df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k rows likeliest of class 1."""
    scored = model.transform(df).select(key, vector_to_array("probability")[1].alias("risk"))
    return scored.orderBy(F.desc("risk"), key).limit(k)


def text_pipeline(text: str, vocabulary: int = 1500, chars: int = 1000) -> Pipeline:
    """TF-IDF of words and word pairs, and of character 3- to 5-grams, each of unit length, side by side."""
    words = RegexTokenizer(inputCol=text, outputCol="w", pattern=r"\W+", toLowercase=True)
    letters = RegexTokenizer(inputCol=text, outputCol="c", pattern=".", gaps=False, toLowercase=True)
    stages: list = [words, letters]
    parts = []
    for source, sizes, size in (("w", (1, 2), vocabulary), ("c", (3, 4, 5), chars)):
        for n in sizes:
            g = f"{source}{n}"
            stages += [NGram(n=n, inputCol=source, outputCol=g), CountVectorizer(inputCol=g, outputCol=f"{g}_tf", vocabSize=max(1, size // len(sizes))), IDF(inputCol=f"{g}_tf", outputCol=f"{g}_idf"), Normalizer(inputCol=f"{g}_idf", outputCol=f"{g}_n")]
            parts.append(f"{g}_n")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def top_weights(weights: DataFrame, k: int = 10, by: str = "class", name: str = "name", weight: str = "weight") -> DataFrame:
    """The k greatest weights of each class, with their rank; ties to the smaller name."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(weight), name))
    return weights.withColumn("rank", rank).where(F.col("rank") <= k)


def coefficients(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(class, name, weight) of a fitted linear model."""
    last = model.stages[-1]
    rows = last.coefficientMatrix.toArray().tolist() if hasattr(last, "coefficientMatrix") else [last.coefficients.toArray().tolist()]
    found = [(i, n, float(w)) for i, row in enumerate(rows) for n, w in zip(features, row, strict=True)]
    return SparkSession.active().createDataFrame(found, "class int, name string, weight double")


def importances(names: Column, values: Column) -> Column:
    """(name, importance) structs, least important first; ties by name."""
    pairs = F.zip_with(names, values, lambda n, v: F.struct(v.alias("importance"), n.alias("name")))
    return F.transform(F.array_sort(pairs), lambda x: F.struct(x["name"].alias("name"), x["importance"].alias("importance")))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, out: str = "fold") -> DataFrame:
    """Fold numbers by an MD5 of key and label: about equal shares of each class, repeatable, no sort of a class."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(label).cast("string")))
    return df.withColumn(out, F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int"))


def cross_validate(df: DataFrame, key: str, label: str, features: Sequence[str], kind: str = "logistic", folds: int = 5, **options) -> DataFrame:
    """(fold, rows, accuracy): a model per fold, learnt from the other folds."""
    rows = stratified_folds(df, key, label, folds).persist()
    parts = []
    for i in range(folds):
        model = fit_classifier(rows.where(F.col("fold") != i), label, features, kind, **options)
        hit = (F.col("prediction") == F.col(label)).cast("double")
        parts.append(model.transform(rows.where(F.col("fold") == i)).agg(F.lit(i).alias("fold"), F.count("*").alias("rows"), F.avg(hit).alias("accuracy")))
    return reduce(DataFrame.union, parts)


def density(df: DataFrame, value: str, points: Sequence[float], bandwidth: float) -> DataFrame:
    """(x, density): Gaussian kernel density at some points, one scan whose partial sums are one number a point."""
    v = F.col(value).cast("double")
    kernel = lambda x: F.avg(F.exp(-F.pow((v - x) / bandwidth, 2) / 2)) / (bandwidth * (2 * math.pi) ** 0.5)
    got = df.where(v.isNotNull()).agg(F.array(*[F.struct(F.lit(float(x)).alias("x"), kernel(float(x)).alias("density")) for x in points]).alias("p"))
    return got.select(F.inline("p"))


# --- gradient descent -------------------------------------------------------------


def _step(df: DataFrame, names: Sequence[str], weights: list[float], bias: float, label: str, logistic: bool) -> list[float]:
    z = sum((F.col(n) * w for n, w in zip(names, weights, strict=True)), F.lit(bias))
    e = (1 / (1 + F.exp(-z)) if logistic else z) - F.col(label)
    row = df.agg(*[F.avg(e * F.col(n)).alias(f"g{i}") for i, n in enumerate(names)], F.avg(e).alias("gb")).first()
    return list(row)


def descend(df: DataFrame, label: str, features: Sequence[str], logistic: bool = False, rate: float = 0.1, steps: int = 50) -> tuple[list[float], float]:
    """(weights, bias) after full-batch steps; each step is one aggregation that returns len(features) + 1 numbers."""
    df = df.select(*features, label).persist()
    w, b = [0.0] * len(features), 0.0
    for _ in range(steps):
        *g, gb = _step(df, features, w, b, label, logistic)
        w, b = [x - rate * y for x, y in zip(w, g, strict=True)], b - rate * gb
    df.unpersist()
    return w, b


def log2_loss(label, probability):
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), probability))
    return -(label * F.log2(p) + (1 - label) * F.log2(1 - p))


def sigmoid(z, bound: float = 60.0):
    return 1 / (1 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), z))))


def softmax(values):
    """Of an array, shifted by its greatest value."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(values):
    return F.array_position(values, F.array_max(values)) - 1


def standard_pixels(pixels, mean: float = 0.0, std: float = 1.0):
    return F.transform(pixels, lambda p: (p / 255.0 - mean) / std)
