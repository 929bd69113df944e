"""Tables that a job writes for itself in the folder of ``spark.checkpoint.dir``, which all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder beside the warehouse, which is shared like it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch").rstrip("/")


def new_id() -> str:
    return uuid.uuid4().hex


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{new_id()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: what uses it several times computes it once, and lost executors cost no more than a read."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_of(table: DataFrame) -> str:
    """The folder of a table that ``written`` made."""
    return table.inputFiles()[0].rpartition("/")[0]


def removed(table: DataFrame) -> None:
    """Deletes a table that ``written`` made."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path_of(table))
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Has each query inside remove its shuffle files when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
