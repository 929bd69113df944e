"""Regressors on the panel by Spark ML, their importances, ranking metrics and comparison."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vectors(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Rows with all features and a label, with ``features`` and ``label``."""
    rows = df.dropna(subset=[*columns, label])
    return rows.withColumns({"features": array_to_vector(F.array(*columns)), "label": F.col(label).cast("double")})


def ridge(train: DataFrame, alphas=(0.1, 1.0, 10.0, 100.0), folds: int = 5):
    """Ridge by cross-validation over ``alphas``, penalties of the sum of squared errors.

    Spark averages the loss, and divides the penalty by the label's deviation; so a
    penalty is alpha times that deviation over n.
    """
    n, sd = train.agg(F.count("*"), F.stddev_pop("label")).first()
    n = max(1, n) / (sd or 1.0)
    model = LinearRegression(elasticNetParam=0.0, standardization=False)
    grid = ParamGridBuilder().addGrid(model.regParam, [a / n for a in alphas]).build()
    return CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="mse"), numFolds=folds, seed=42).fit(train).bestModel


def forest(train: DataFrame, trees: int = 20, depth: int = 6):
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=42).fit(train)


def boosted(train: DataFrame, valid: DataFrame, rounds: int = 30, depth: int = 4):
    """Boosting that stops when the valid rows no longer improve."""
    both = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
    return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=0.1, validationIndicatorCol="_valid", seed=42).fit(both)


def errors(model, parts: dict[str, DataFrame]) -> DataFrame:
    """``split, mse, mae, n`` of a model's predictions."""
    out = None
    for name, df in parts.items():
        e = F.col("prediction") - F.col("label")
        row = model.transform(df).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n")).select(F.lit(name).alias("split"), "mse", "mae", "n")
        out = row if out is None else out.unionByName(row)
    return out


def importance_table(spark, model, columns: list[str]) -> DataFrame:
    """``feature, importance``, largest first: forest importances or absolute coefficients."""
    scores = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    rows = sorted(zip(columns, map(float, scores), strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def ndcg(df: DataFrame, at=(10, 30, 50), score: str = "score", grade: str = "grade") -> DataFrame:
    """``date, ndcg_k`` with gain 2^grade - 1, ties by ticker; a date without gain has none."""
    by_score = Window.partitionBy("date").orderBy(F.desc(score), "ticker")
    by_grade = Window.partitionBy("date").orderBy(F.desc(grade), "ticker")
    rows = df.where(F.col(score).isNotNull() & F.col(grade).isNotNull())
    rows = rows.select("date", (F.pow(F.lit(2.0), grade) - 1).alias("g"), F.row_number().over(by_score).alias("p"), F.row_number().over(by_grade).alias("q"))
    gain = lambda pos, k: F.sum(F.when(F.col(pos) <= k, F.col("g") / F.log2(1.0 + F.col(pos))))
    return rows.groupBy("date").agg(*(F.try_divide(gain("p", k), gain("q", k)).alias(f"ndcg_{k}") for k in at))


IMPROVED = ("mean_ic", "icir")


def task_metrics(analysis: DataFrame, ic: DataFrame) -> DataFrame:
    """``task, metric, value``: mean IC, ICIR (also annual), t, positive share, mean spread and its Sharpe ratio of each factor,
    from its rows of ``analyze``'s result and of ``ic_summary``'s, over one return."""
    names = {"ic_mean": "mean_ic", "icir": "icir", "icir_annual": "icir_annual", "t_stat": "t_stat", "positive_ratio": "ic_positive_ratio"}
    left = ic.select(F.col("factor").alias("task"), *(F.col(c).alias(n) for c, n in names.items()))
    both = left.join(analysis.select(F.col("factor").alias("task"), "spread_mean", F.col("sharpe").alias("spread_sharpe")), "task", "left")
    return both.unpivot(["task"], [*names.values(), "spread_mean", "spread_sharpe"], "metric", "value")


def compare(results: DataFrame, baseline: str) -> DataFrame:
    """``task, metric, value, improvement``: by how many per cent a task's absolute IC and ICIR exceed the baseline's."""
    base = results.where((F.col("task") == baseline) & F.col("metric").isin(*IMPROVED)).select("metric", F.abs("value").alias("base"))
    change = F.try_divide(F.abs("value") - F.col("base"), F.col("base")) * 100
    out = results.join(F.broadcast(base), "metric", "left")
    return out.withColumn("improvement", F.when(F.col("task") != baseline, change)).drop("base")
