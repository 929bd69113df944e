"""Feature cleaning, selection and scaling; statistics come from one aggregation over all features."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators.order import exact_quantiles
from factorloom.operators.screening import correlation_matrix
from factorloom.operators.splits import numbered_dates


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "x")


def unusable(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, std, reason``; null for usable features.

    In this order: values missing or not finite, constant, mean or deviation too
    large, a window sum (``_sum``, the mean says the same), a variance (``_var``)
    beside the deviation of the same values (``_std``), extreme shape.
    """
    n, sd = F.count("x"), F.stddev_samp("x")
    skew = F.sqrt(n * (n - 1.0)) / (n - 2) * F.skewness("x")
    kurt = (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * F.kurtosis("x") + 6)
    stats = _long(df, columns).groupBy("feature").agg(
        sd.alias("std"), F.avg("x").alias("mean"), (F.count("*") - n).alias("missing"), F.when(n >= 4, skew).alias("skew"), F.when(n >= 4, kurt).alias("kurt"),
        F.bool_or(F.isnan("x") | (F.abs("x") == float("inf"))).alias("odd"),
    )
    beside = [c for c in columns if c.endswith("_var") and f"{c[:-4]}_std" in columns]
    reason = F.when(F.col("odd") | (F.col("missing") > 0), "non-finite").when(F.col("std") < 1e-10, "constant")
    reason = reason.when((F.abs("mean") > 1e10) | (F.col("std") > 1e10), "magnitude").when(F.col("feature").endswith("_sum"), "window sum")
    reason = reason.when(F.col("feature").isin(beside), "variance beside deviation")
    return stats.withColumn("reason", reason.when((F.abs("skew") > 15) | (F.abs("kurt") > 200), "shape"))


def varying(df: DataFrame, columns: list[str], least: float) -> DataFrame:
    """``feature, variance`` (population, nulls as 0) of the features above ``least``."""
    return _long(df.fillna(0.0, columns), columns).groupBy("feature").agg(F.var_pop("x").alias("variance")).where(F.col("variance") > least)


def uncorrelated(df: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """Features left when, in column order, the lower-variance one of each pair above ``most`` is dropped."""
    corr = correlation_matrix(df, columns)
    variance = df.agg(*(F.var_pop(c).alias(c) for c in columns)).first().asDict()
    gone: set[str] = set()
    for (a, b), c in corr.items():
        if a not in gone and b not in gone and abs(c or 0.0) > most:
            gone.add(a if (variance[a] or 0) < (variance[b] or 0) else b)
    return [c for c in columns if c not in gone]


def importances(df: DataFrame, columns: list[str], targets: list[str], k: int, train: float = 0.8, purge: int = 10, trees: int = 20) -> list[tuple[str, float]]:
    """The ``k`` features with the largest sum of normalized forest importances over the targets, on purged early dates."""
    dates = numbered_dates(df).where(F.col("i") <= F.floor(F.col("n") * train) - purge).select("date")
    rows = df.join(F.broadcast(dates), "date").dropna(subset=columns)
    rows = rows.select(array_to_vector(F.array(*columns)).alias("features"), *targets).cache()
    total = dict.fromkeys(columns, 0.0)
    for t in targets:
        model = RandomForestRegressor(labelCol=t, numTrees=trees, maxDepth=6, seed=42).fit(rows.where(F.col(t).isNotNull()))
        scores = model.featureImportances.toArray()
        for c, s in zip(columns, scores / (scores.sum() or 1.0), strict=True):
            total[c] += float(s)
    rows.unpersist()
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))[:k]


def scale(df: DataFrame, columns: list[str], kind: str = "robust", train: float = 0.8) -> DataFrame:
    """Robust, standard or min-max scaling by statistics of the first ``train`` share of dates."""
    dates = numbered_dates(df).where(F.col("i") <= F.floor(F.col("n") * train)).select("date")
    rows = df.join(F.broadcast(dates), "date")
    if kind == "robust":  # quantiles of all columns together, in pieces of their ranges
        cuts = exact_quantiles(_long(rows, columns), "x", ["feature"], [0.25, 0.5, 0.75], "q")
        pair = F.struct(F.col("q")[1].alias("a"), (F.col("q")[2] - F.col("q")[0]).alias("b"))
        stats = cuts.groupBy().pivot("feature", columns).agg(F.first(pair)).toDF(*(f"_{c}" for c in columns))
        return _scaled(df, columns, stats)
    made = {
        "standard": lambda c: F.struct(F.avg(c).alias("a"), F.stddev_pop(c).alias("b")),
        "minmax": lambda c: F.struct(F.min(c).alias("a"), (F.max(c) - F.min(c)).alias("b")),
    }[kind]
    stats = rows.agg(*(made(c).alias(f"_{c}") for c in columns))
    return _scaled(df, columns, stats)


def _scaled(df: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    """``df`` with each column less ``_<column>.a`` over ``_<column>.b`` of the one row ``stats``."""
    out = df.join(F.broadcast(stats), F.lit(True))
    return out.select(*(F.try_divide(F.col(c) - F.col(f"_{c}.a"), F.col(f"_{c}.b")).alias(c) if c in columns else c for c in df.columns))
