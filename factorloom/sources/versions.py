"""A table as a history of versions: every change appends one, whole or not at all, and any earlier state can be read.

A version is a folder that is written apart and then renamed to its number.  The
rename fails where the number is taken, so of two writers that started from one
state the second starts again from the new one.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.sources.scratch import new_id
from factorloom.sources.tables import folder_names, make_folder


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(x) for x in folder_names(spark, f"{root}/versions") if x.isdigit())


def history(spark: SparkSession, root: str, schema: str, as_of: int | None = None) -> DataFrame:
    """All rows up to version ``as_of`` (default: the last), with ``version``; ``schema`` is that of the rows without it."""
    found = [v for v in versions(spark, root) if as_of is None or v <= as_of]
    parts = [spark.read.schema(schema).parquet(f"{root}/versions/{v}").withColumn("version", F.lit(v)) for v in found]
    out = spark.createDataFrame([], schema).withColumn("version", F.lit(0))
    for p in parts:  # each a folder of its own: a plan as long as the list of versions, and no version's making in it
        out = out.unionByName(p)
    return out


def append(spark: SparkSession, root: str, schema: str, make: Callable[[DataFrame, int], DataFrame]) -> int:
    """Adds what ``make(history, version)`` returns as the next version, and returns its number; 0 if that has no rows.

    ``make`` is called again if another writer took the number meanwhile, so its
    rows always follow from the state right before them.
    """
    make_folder(spark, f"{root}/versions")
    while True:
        number = max(versions(spark, root), default=0) + 1
        apart = f"{root}/apart/{new_id()}"
        make(history(spark, root, schema), number).drop("version").write.parquet(apart)
        if spark.read.schema(schema).parquet(apart).isEmpty():
            return 0
        if _rename_new(spark, apart, f"{root}/versions/{number}"):
            return number


def _rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder; false if the target exists."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    a, b = fs.Path(source), fs.Path(target)
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        fs.FileContext.getFileContext(a.toUri(), spark._jsc.hadoopConfiguration()).rename(a, b, options)
    except Py4JJavaError as e:
        name = e.java_exception.getClass().getName()
        if "AlreadyExists" in name or folder_names(spark, target):
            return False
        raise
    return True
