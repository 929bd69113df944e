"""Leak-free splits over time: bounds come from the distinct dates, rows get them by a join on the date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_dates(df: DataFrame) -> DataFrame:
    """``date, i, n``: a row a date, thousands in all."""
    dates = df.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    return dates.withColumn("n", F.count("*").over(Window.partitionBy()))


def single_split(df: DataFrame, train: float = 0.6, valid: float = 0.2, purge: int = 0, embargo: int = 0) -> DataFrame:
    """Adds ``split``: ``purge`` dates before and ``embargo`` dates after each boundary belong to none."""
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * round(train + valid, 12))
    i = F.col("i")
    split = F.when(i <= a - purge, "train").when((i > a + embargo) & (i <= b - purge), "valid").when(i > b + embargo, "test")
    return df.join(F.broadcast(numbered_dates(df).select("date", split.alias("split"))), "date")


def walk_forward(df: DataFrame, folds: int, least_train: int, purge: int = 0, embargo: int = 0, expanding: bool = True) -> DataFrame:
    """Rows with ``fold`` and ``split`` (``train`` or ``test``); a row is in several folds.

    ``expanding`` false keeps the last ``least_train`` dates before the boundary only.
    """
    dates = numbered_dates(df)
    step = F.floor((F.col("n") - least_train) / folds)
    out = dates.withColumn("fold", F.explode(F.array(*(F.lit(k) for k in range(folds)))))
    cut = F.lit(least_train) + F.col("fold") * step
    inside = (F.col("i") <= cut - purge) & (F.lit(expanding) | (F.col("i") > cut - least_train))
    split = F.when(inside, "train").when((F.col("i") > cut + embargo) & (F.col("i") <= cut + step), "test")
    out = out.withColumn("split", split).where("split is not null").select("date", "fold", "split")
    return df.join(F.broadcast(out), "date")


def leakage(df: DataFrame, horizon: int, dates: DataFrame | None = None) -> DataFrame:
    """One row ``shared_dates, gap_ok``: no date in two splits, and splits more than ``horizon`` dates apart, by the numbers of ``dates`` (default: those of ``df``)."""
    dates = numbered_dates(df) if dates is None else dates
    numbered = df.select("date", "split").where("split is not null").distinct().join(dates.select("date", "i"), "date")
    shared = numbered.groupBy("date").agg(F.count("*").alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("shared_dates"))
    bounds = numbered.groupBy("split").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    before = F.lag("b").over(Window.orderBy("a"))
    gap = bounds.withColumn("g", F.col("a") - before).agg(F.coalesce(F.min("g") > horizon, F.lit(True)).alias("gap_ok"))
    return shared.join(F.broadcast(gap), F.lit(True))


def by_position(df: DataFrame, train: float = 0.7, valid: float = 0.15, purge: int = 0) -> DataFrame:
    return single_split(df, train, valid, purge=purge)
