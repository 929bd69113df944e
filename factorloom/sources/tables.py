"""Reading and writing of panels, measurements, exports and versioned snapshots."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pivot_measurements(long: DataFrame, fields: list[str]) -> DataFrame:
    """Long ``time, ticker, field, value`` to a row per (time, ticker); the field list is fixed, so no extra job."""
    return long.groupBy("time", "ticker").pivot("field", fields).agg(F.first("value"))


def load_panel(rows: DataFrame, tickers: list | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the tickers in a date range (default: the last 365 days of the data); the filters reach the scan."""
    if tickers:
        rows = rows.where(F.col("ticker").isin(sorted(set(tickers))))
    if start is None:
        last = rows.agg(F.max("date")).first()[0]
        rows = rows.where(F.col("date") > F.date_sub(F.lit(last), 365)) if last else rows
    else:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    return rows.where(F.col("date") <= F.lit(end).cast("date")) if end else rows


def by_key(rows: DataFrame, tickers: list) -> DataFrame:
    return rows.where(F.col("ticker").isin(sorted(set(tickers)))).orderBy("ticker", F.desc("report_date"))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; credentials and partitioning options come from the caller."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows, the new one where a key is in both; of keys repeated in ``new``, one row."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("_v"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_v", "_k")


def export_rows(bars: DataFrame) -> DataFrame:
    """Bars in exchange format: ``SZSE`` for tickers 00/30, else ``SSE``; missing turnover is 0."""
    code = F.col("ticker").cast("string")
    return bars.select(
        F.when(code.startswith("00") | code.startswith("30"), "SZSE").otherwise("SSE").alias("exchange"), code.alias("symbol"),
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "open", "high", "low", "close", "volume",
        F.coalesce("amount", F.lit(0.0)).alias("turnover"), F.lit(0).alias("open_interest"),
    )


def write_export(bars: DataFrame, path: str) -> None:
    export_rows(bars).write.mode("overwrite").option("header", True).partitionBy("exchange", "symbol").csv(path)


def write_panel(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A panel or factor dataset, partitioned by the year of ``date``, as Parquet or CSV."""
    writer = df.withColumn("year", F.year("date")).repartition("year").write.mode("overwrite").partitionBy("year")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def write_evaluation(tables: dict[str, DataFrame], path: str) -> None:
    """Evaluation tables: each as CSV under its name, and the one named ``summary`` as JSON too."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        if name == "summary":
            df.write.mode("overwrite").json(f"{path}/{name}_json")


def content_hash(df: DataFrame) -> DataFrame:
    """One row ``n_rows, hash``: the sum of row hashes, so the order of rows does not matter."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def create_snapshot(df: DataFrame, root: str, snapshot_id: str, filters: dict[str, str] | None = None, label: str | None = None, **about: str) -> DataFrame:
    """Writes the version ``snapshot_id`` below ``root`` and returns its manifest; fails if any writer has claimed it before.

    A version is claimed by a file that can be created once only.  Its rows are
    written next, and read again for the manifest, which appears last and whole, by
    a rename; without it nobody reads the version.  The manifest has the number of
    rows and the hash, ``filters`` (name to setting), ``missing`` (share of nulls by
    column) and ``labels`` (rows by class of ``label``).
    """
    if not claim_snapshot(df.sparkSession, root, snapshot_id):
        raise FileExistsError(f"snapshot {snapshot_id} has been claimed")
    return _write_snapshot(df, root, snapshot_id, filters, label, about)


def create_next_snapshot(df: DataFrame, root: str, year: int, quarter: int, **more) -> DataFrame:
    """``create_snapshot`` under the first free ``ds_{year}Q{quarter}_v{n}``; of several writers at once, each gets a number of its own."""
    spark = df.sparkSession
    filters, label = more.pop("filters", None), more.pop("label", None)
    taken = folder_names(spark, f"{root}/claims")
    while True:
        snapshot_id = next_snapshot_id(taken, year, quarter)
        if claim_snapshot(spark, root, snapshot_id):
            return _write_snapshot(df, root, snapshot_id, filters, label, more)
        taken = [*taken, snapshot_id]


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if it does not exist."""
    at, fs = _path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def make_folder(spark: SparkSession, folder: str) -> None:
    at, fs = _path(spark, folder)
    fs.mkdirs(at)


def remove_folder(spark: SparkSession, folder: str) -> None:
    at, fs = _path(spark, folder)
    fs.delete(at, True)


def _path(spark: SparkSession, name: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(name)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def claim_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> bool:
    """Whether this call, and no other before, created the version's claim."""
    at, fs = _path(spark, f"{root}/claims/{snapshot_id}")
    fs.mkdirs(at.getParent())
    try:
        fs.create(at, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def _write_snapshot(df: DataFrame, root: str, snapshot_id: str, filters: dict[str, str] | None, label: str | None, about: dict[str, str]) -> DataFrame:
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/data/{snapshot_id}")  # of a claim whose writer died there may be parts
    stored = spark.read.parquet(f"{root}/data/{snapshot_id}")
    missing = stored.agg(F.to_json(F.struct(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in stored.columns))).alias("missing"))
    meta = content_hash(stored).join(F.broadcast(missing), F.lit(True)).withColumn("filters", F.to_json(F.create_map(*(F.lit(x) for kv in (filters or {"": ""}).items() for x in kv))))
    if label is not None:
        pairs = stored.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("null")).alias("k")).agg(F.count("*").alias("v"))
        counts = pairs.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v"))))).alias("labels"))
        meta = meta.join(F.broadcast(counts), F.lit(True))
    meta = meta.withColumns({"snapshot_id": F.lit(snapshot_id), **{k: F.lit(v) for k, v in about.items()}})
    meta.write.mode("overwrite").json(f"{root}/pending/{snapshot_id}")
    source, fs = _path(spark, f"{root}/pending/{snapshot_id}")
    target, _ = _path(spark, f"{root}/meta/{snapshot_id}")
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise FileExistsError(f"snapshot {snapshot_id} has a manifest already")
    return spark.read.json(f"{root}/meta/{snapshot_id}")


def next_snapshot_id(existing: list[str], year: int, quarter: int) -> str:
    prefix = f"ds_{year}Q{quarter}_v"
    taken = [int(s[len(prefix) :]) for s in existing if s.startswith(prefix) and s[len(prefix) :].isdigit()]
    return f"{prefix}{max(taken, default=0) + 1}"


def load_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    """The snapshot's rows, after its hash has been computed again and compared; a version without a manifest does not exist."""
    if snapshot_id not in folder_names(spark, f"{root}/meta"):
        raise FileNotFoundError(f"snapshot {snapshot_id} is not complete")
    df = spark.read.parquet(f"{root}/data/{snapshot_id}")
    meta, found = spark.read.json(f"{root}/meta/{snapshot_id}").first(), content_hash(df).first()
    if (found["hash"], found["n_rows"]) != (meta["hash"], meta["n_rows"]):
        raise ValueError(f"snapshot {snapshot_id} does not match its hash")
    return df


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all complete versions."""
    names = folder_names(spark, f"{root}/meta")
    if not names:
        return spark.createDataFrame([], "snapshot_id string, n_rows long, hash string, missing string, filters string")
    return spark.read.json([f"{root}/meta/{x}" for x in names]).orderBy("snapshot_id")
