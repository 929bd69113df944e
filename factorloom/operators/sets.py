"""Top-k, first and last rows, unions and key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: str, k: int, tie: str, absolute: bool = False) -> DataFrame:
    return df.orderBy(F.desc(F.abs(by) if absolute else F.col(by)), tie).limit(k)


def last_rows(df: DataFrame, n: int, first: bool = False) -> DataFrame:
    """The last (or first) ``n`` rows of each ticker, numbered from that end in ``rn``."""
    w = Window.partitionBy("ticker").orderBy("date" if first else F.desc("date"))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def new_keys(a: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return a.join(known.select(key), key, "left_anti")


def with_missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every wanted key, with nulls and ``missing`` where nothing was found."""
    return wanted.join(found.withColumn("_f", F.lit(True)), key, "left").withColumn("missing", F.col("_f").isNull()).drop("_f")
