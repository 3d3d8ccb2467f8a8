"""Machine learning over tables, by pyspark.ml: pipelines by name, preprocessing, search, and a registry of models."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import evaluation as E
from pyspark.ml import feature as X
from pyspark.ml import regression as G
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.operators.perceptron import Perceptron

#: Algorithm name -> estimator.
ALGORITHMS = {
    "linear_regression": G.LinearRegression, "tree_regression": G.DecisionTreeRegressor, "forest_regression": G.RandomForestRegressor, "boosted_regression": G.GBTRegressor,
    "logistic_regression": C.LogisticRegression, "naive_bayes": C.NaiveBayes, "decision_tree": C.DecisionTreeClassifier, "random_forest": C.RandomForestClassifier, "svm": C.LinearSVC, "neural_network": Perceptron,
    "kmeans": K.KMeans, "gaussian_mixture": K.GaussianMixture, "bisecting_kmeans": K.BisectingKMeans,
}

#: These need one pass over the rows; all others keep them in memory, unpacked, and go through them many times.
ONE_PASS = ("linear_regression", "naive_bayes")
#: Rows of a task that keeps them.
TASK_ROWS = 1_000_000


@contextmanager
def _dealt(df: DataFrame, algorithm: str, columns: set) -> Iterator[DataFrame]:
    """The rows in tasks of bounded size: a split of a file may hold many millions of them, packed. They are dealt once, and kept on disk meanwhile."""
    n = 1 if algorithm in ONE_PASS else -(-df.count() // TASK_ROWS)
    if n <= 1:
        yield df
        return
    dealt = df.select([c for c in df.columns if c in columns]).repartition(max(n, df.sparkSession.sparkContext.defaultParallelism)).persist(StorageLevel.DISK_ONLY)
    try:
        yield dealt
    finally:
        dealt.unpersist()


def preprocessing(numeric: Sequence[str], categories: Sequence[str] = (), scale: str | None = "standard", impute: str | None = None, degree: int = 1) -> list:
    """Stages that put features into a column features. scale: standard, minmax or None; impute: mean, median, mode or None."""
    stages, names = [], list(numeric)
    if impute:
        stages.append(X.Imputer(strategy=impute, inputCols=list(numeric), outputCols=[f"{c}_filled" for c in numeric]))
        names = [f"{c}_filled" for c in numeric]
    for c in categories:
        stages += [X.StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep"), X.OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot")]
    out = "features" if not scale and degree == 1 else "raw_features"
    stages.append(X.VectorAssembler(inputCols=names + [f"{c}_hot" for c in categories], outputCol=out, handleInvalid="skip"))
    if degree > 1:
        stages.append(X.PolynomialExpansion(degree=degree, inputCol=out, outputCol="features" if not scale else "poly_features"))
        out = "poly_features"
    if scale:
        kind = X.StandardScaler(inputCol=out, outputCol="features", withMean=True) if scale == "standard" else X.MinMaxScaler(inputCol=out, outputCol="features")
        stages.append(kind)
    return stages


def create_model(df: DataFrame, algorithm: str, numeric: Sequence[str], label: str | None = None, categories: Sequence[str] = (), scale: str | None = "standard", impute: str | None = None, degree: int = 1, **params) -> PipelineModel:
    """CREATE MODEL: preprocessing and the algorithm as one fitted pipeline."""
    estimator = ALGORITHMS[algorithm](featuresCol="features", **({"labelCol": label} if label else {}), **params)
    before = Pipeline(stages=preprocessing(numeric, categories, scale, impute, degree)).fit(df)
    with _dealt(df, algorithm, {*numeric, *categories, label, *(v for v in params.values() if isinstance(v, str))}) as rows:
        return PipelineModel([*before.stages, estimator.fit(before.transform(rows))])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def split(df: DataFrame, key: Sequence[str], test: float = 0.25, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key, so that it is the same in every run."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(10_000)) / 10_000
    return df.where(u >= test), df.where(u < test)


def folds(df: DataFrame, key: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(k)).cast("int"))


def binned(df: DataFrame, column: str, bins: int, equal_depth: bool = False) -> DataFrame:
    if equal_depth:
        return X.QuantileDiscretizer(numBuckets=bins, inputCol=column, outputCol=f"{column}_bin").fit(df).transform(df)
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    cuts = [float("-inf"), *[lo + (hi - lo) * i / bins for i in range(1, bins)], float("inf")]
    return X.Bucketizer(splits=cuts, inputCol=column, outputCol=f"{column}_bin").transform(df)


def search(df: DataFrame, algorithm: str, numeric: Sequence[str], label: str, grid: dict[str, Sequence], folds: int = 3, metric: str = "accuracy", seed: int = 1) -> tuple[PipelineModel, float]:
    """The best of a grid of parameters by cross-validation, and its score."""
    estimator = ALGORITHMS[algorithm](featuresCol="features", labelCol=label)
    params = ParamGridBuilder()
    for name, values in grid.items():
        params = params.addGrid(getattr(estimator, name), list(values))
    judge = E.RegressionEvaluator(labelCol=label, metricName=metric) if metric in ("rmse", "mae", "r2", "mse") else E.MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=Pipeline(stages=[*preprocessing(numeric), estimator]), estimatorParamMaps=params.build(), evaluator=judge, numFolds=folds, seed=seed)
    with _dealt(df, algorithm, {*numeric, label}) as rows:
        fitted = cv.fit(rows)
    scores = fitted.avgMetrics
    return fitted.bestModel, max(scores) if judge.isLargerBetter() else min(scores)


def feature_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, variance, correlation): of each numeric feature, in one pass."""
    one = df.agg(*[F.struct(F.var_samp(c).alias("variance"), F.abs(F.covar_pop(c, label) / F.nullif(F.stddev_pop(c) * F.stddev_pop(label), F.lit(0.0))).alias("correlation")).alias(c) for c in features])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["variance"].alias("variance"), F.col(c)["correlation"].alias("correlation")) for c in features])
    return one.select(F.inline(rows))


def select_features(df: DataFrame, features: Sequence[str], label: str, k: int | None = None, least_variance: float = 0.0) -> list[str]:
    """Features whose variance is above a least one, the k that correlate most with the label (of equals the first by name)."""
    rows = feature_scores(df, features, label).where(F.col("variance") > least_variance).orderBy(F.desc_nulls_last("correlation"), "feature").collect()
    return [r.feature for r in rows][:k]


def explain_linear(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, coefficient, mean): least squares of the label on the features as they are; '' is the intercept.

    A row's prediction is the intercept plus the sum of coefficient * value; contributions() tells each part.
    """
    model = Pipeline(stages=[X.VectorAssembler(inputCols=list(features), outputCol="features"), G.LinearRegression(featuresCol="features", labelCol=label, solver="normal")]).fit(df).stages[-1]
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    rows = [(c, float(w), float(means[c])) for c, w in zip(features, model.coefficients)] + [("", float(model.intercept), 1.0)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, mean double")


def contributions(df: DataFrame, explained: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with a column for each feature: how much its value moves the prediction away from that of the mean row."""
    w = {r.feature: (r.coefficient, r.mean) for r in explained.collect()}  # a row for each feature
    return df.withColumns({f"{c}_contribution": F.lit(w[c][0]) * (F.col(c) - F.lit(w[c][1])) for c in features})


def with_interval(predicted: DataFrame, residuals: DataFrame, label: str, z: float = 1.96) -> DataFrame:
    """predicted with low and high: z standard deviations of the residuals of some labelled, predicted rows beside each prediction."""
    sd = residuals.agg(F.stddev_samp(F.col(label) - F.col("prediction")).alias("_sd"))
    return predicted.crossJoin(F.broadcast(sd)).withColumns({"low": F.col("prediction") - z * F.col("_sd"), "high": F.col("prediction") + z * F.col("_sd")}).drop("_sd")


def ab_assignment(df: DataFrame, key: Sequence[str], shares: dict[str, float], seed: int = 1) -> DataFrame:
    """df with variant, by a hash of the key and the variants' shares, so that a key always gets the same."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    total, variant = 0.0, None
    for name, share in shares.items():
        total += share
        variant = F.when(u < total, name) if variant is None else variant.when(u < total, name)
    return df.withColumn("variant", variant.otherwise(list(shares)[-1]))


class ModelRegistry:
    """Named models with versions under a folder, whose list is kept there."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        fs, p = self._fs(f"{self.root}/models.json")
        self.entries: dict[str, list[dict]] = json.loads("".join(r.value for r in spark.read.text(f"{self.root}/models.json", wholetext=True).collect())) if fs.exists(p) else {}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _keep(self) -> None:
        fs, p = self._fs(f"{self.root}/models.json")
        fs.mkdirs(p.getParent())
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(self.entries).encode()))
        out.close()

    def register(self, name: str, model: PipelineModel, **about) -> int:
        version = len(self.entries.setdefault(name, [])) + 1
        path = f"{self.root}/{name}/{version}"
        model.write().overwrite().save(path)
        self.entries[name].append({"path": path, "at": time.time(), "about": json.dumps(about)})
        self._keep()
        return version

    def load(self, name: str, version: int | None = None) -> PipelineModel:
        return PipelineModel.load(self.entries[name][(version or 0) - 1]["path"])

    def drop(self, name: str) -> None:
        del self.entries[name]
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)
        self._keep()

    def execute(self, text: str) -> DataFrame | int | None:
        """CREATE MODEL name USING algorithm FEATURES (a, b) [TARGET y] AS SELECT ...; RETRAIN MODEL name AS SELECT ...;
        PREDICT name AS SELECT ... (the rows with prediction); DROP MODEL name. A version number for the first two."""
        rest = r"\s+AS\s+(SELECT\s.*)"
        if m := re.fullmatch(r"\s*CREATE\s+MODEL\s+(\w+)\s+USING\s+(\w+)\s+FEATURES\s*\(([^)]*)\)(?:\s+TARGET\s+(\w+))?" + rest, text, re.I | re.S):
            about = {"algorithm": m[2].lower(), "features": [c.strip() for c in m[3].split(",")], "label": m[4]}
            model = create_model(self.spark.sql(m[5]), about["algorithm"], about["features"], about["label"])
            return self.register(m[1], model, **about)
        if m := re.fullmatch(r"\s*RETRAIN\s+MODEL\s+(\w+)" + rest, text, re.I | re.S):
            about = json.loads(self.entries[m[1]][-1]["about"])
            return self.register(m[1], create_model(self.spark.sql(m[2]), about["algorithm"], about["features"], about["label"]), **about)
        if m := re.fullmatch(r"\s*PREDICT\s+(\w+)" + rest, text, re.I | re.S):
            return predict(self.load(m[1]), self.spark.sql(m[2]))
        if m := re.fullmatch(r"\s*DROP\s+MODEL\s+(\w+)\s*", text, re.I):
            return self.drop(m[1])
        raise ValueError("not a statement about models")
