"""Models by Spark ML: preprocessing, L1 logistic regression, boosted trees, perceptron, search, stacking, attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.search import Range, bayesian_search


def preprocessing(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Mean imputation, one-hot encoding (unseen values are all zeros) and scaling, into `features`; saved by PipelineModel.save."""
    numeric, categorical = list(numeric), list(categorical)
    stages = [Imputer(inputCols=numeric, outputCols=[f"{c}_filled" for c in numeric])]
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=[*(f"{c}_filled" for c in numeric), *(f"{c}_hot" for c in categorical)], outputCol="raw_features"))
    stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    return Pipeline(stages=stages)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """A column `weight` that gives both classes the same sum."""
    whole = df.agg(F.count(F.lit(1)).alias("__n"), F.sum(label).alias("__k"))
    weight = F.when(F.col(label) == 1, F.col("__n") / (2.0 * F.greatest("__k", F.lit(1)))).otherwise(F.col("__n") / (2.0 * F.greatest(F.col("__n") - F.col("__k"), F.lit(1))))
    return df.crossJoin(F.broadcast(whole)).withColumn("weight", weight).drop("__n", "__k")


def lasso(label: str, strength: float = 0.01) -> LogisticRegression:
    return LogisticRegression(labelCol=label, weightCol="weight", elasticNetParam=1.0, regParam=strength, maxIter=50)


def boosted_trees(label: str, trees: int = 10, depth: int = 3, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)


def perceptron(label: str, inputs: int, hidden: Sequence[int] = (16,), seed: int = 42) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(labelCol=label, layers=[inputs, *hidden, 2], maxIter=50, seed=seed)


def search_lasso(train: DataFrame, label: str, strengths: Sequence[float], seed: int = 42):
    """The strength with the best AUC on a held-back fifth, fitted again on all of train."""
    model = lasso(label)
    grid = ParamGridBuilder().addGrid(model.regParam, list(strengths)).build()
    return TrainValidationSplit(estimator=model, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), trainRatio=0.8, seed=seed).fit(train)


def search_bayesian(train: DataFrame, test: DataFrame, label: str, trials: int, initial: int = 5, seed: int = 42) -> list[dict[str, float]]:
    """Trials of a penalised logistic regression: strength and mixing (0 ridge, 1 lasso), each with its AUC on `test`."""
    auc = BinaryClassificationEvaluator(labelCol=label)

    def evaluate(p: dict[str, float]) -> float:
        model = LogisticRegression(labelCol=label, weightCol="weight", elasticNetParam=p["mixing"], regParam=p["strength"], maxIter=50)
        return auc.evaluate(model.fit(train).transform(test))

    return bayesian_search(evaluate, [Range("strength", 1e-4, 1.0, log=True), Range("mixing", 0.0, 1.0)], trials, initial, seed)


def scored(model, df: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
    """The probability of class 1 beside the kept columns."""
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(name))


def linear_attribution(df: DataFrame, coefficients: Sequence[float], features: str = "features") -> DataFrame:
    """Mean absolute Shapley value of each feature of a linear model, coefficient * (x - mean), and its rank correlation's sign."""
    rows = df.select(F.posexplode(vector_to_array(features)).alias("feature", "x"))
    weights = F.array(*[F.lit(float(c)) for c in coefficients])
    means = rows.groupBy("feature").agg(F.avg("x").alias("m"))
    value = F.element_at(weights, F.col("feature") + 1) * (F.col("x") - F.col("m"))
    return rows.join(means, "feature").withColumn("v", value).groupBy("feature").agg(F.avg(F.abs("v")).alias("importance"), F.try_divide(F.covar_pop("x", "v"), F.stddev_pop("x") * F.stddev_pop("v")).alias("correlation")).filter("importance > 1e-8")


def variance_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the variance that lies between groups (intraclass correlation by one-way analysis of variance)."""
    per = df.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    s = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    between = (F.col("q") - F.col("t") * F.col("t") / F.col("n")) / F.nullif(F.col("k") - 1, F.lit(0.0))
    inside = F.col("within") / F.nullif(F.col("n") - F.col("k"), F.lit(0.0))
    size = (F.col("n") - F.col("n2") / F.col("n")) / F.nullif(F.col("k") - 1, F.lit(0.0))
    effect = F.greatest((between - inside) / size, F.lit(0.0))
    return s.select((effect / F.nullif(effect + inside, F.lit(0.0))).alias("icc"), effect.alias("between_variance"), inside.alias("within_variance"))


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
