"""Quotes as a stream: normalization, latest quote, bars, late ticks, and live crossover positions.

Every function takes a batch or a streaming frame where Spark allows both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factorloom.sources.tables import folder_names, remove_folder

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, glob: str = "*", files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files in a folder (those whose names match ``glob``)."""
    options = {"maxFilesPerTrigger": files_per_trigger, "pathGlobFilter": glob}
    return spark.readStream.schema(EVENTS).options(**options).parquet(path)


def normalize(quotes: DataFrame) -> DataFrame:
    """Quotes with a price, and a suspended flag where the size is 0 or missing."""
    flag = F.coalesce(F.col("size") == 0, F.lit(True)).cast("int")
    return quotes.where("price is not null").withColumn("suspended", flag)


def latest(quotes: DataFrame) -> DataFrame:
    """``ticker, ts, event_id, price, size``: the last quote of each ticker; one row of state a ticker."""
    last = F.max_by(F.struct("ts", "event_id", "price", "size"), F.struct("ts", "event_id"))
    return quotes.groupBy("ticker").agg(last.alias("q")).select("ticker", "q.*")


def recent(latest_quotes: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """Those at most ``minutes`` old at ``as_of``."""
    return latest_quotes.where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {minutes} minutes"))


def bars(quotes: DataFrame, width: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """Tumbling bars: ``ticker, start, open, high, low, close, size, n``; with a watermark, later ticks are dropped."""
    rows = quotes.withWatermark("ts", watermark) if watermark else quotes
    order = F.struct("ts", "event_id")
    out = rows.groupBy("ticker", F.window("ts", width)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").alias("size"), F.count("*").alias("n"),
    )
    return out.select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "size", "n")


STATE = "closes array<double>, position int, above int"
POSITIONS = "ticker long, start timestamp, close double, position int"


def live_crossover(bar_stream: DataFrame, fast: int = 3, slow: int = 6) -> DataFrame:
    """Positions of the moving-average crossover per ticker, carried over micro-batches by state of ``slow`` closes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closes, position, above = state.get if state.exists else ([], 0, -1)
        closes = list(closes)
        rows = pd.concat(list(frames)).sort_values("start", ignore_index=True)
        held = []
        for close in rows["close"]:
            closes = [*closes, float(close)][-slow:]
            if len(closes) == slow:
                now = int(sum(closes[-fast:]) / fast > sum(closes) / slow)
                if above in (0, 1) and now != above:
                    position = now
                above = now
            held.append(position)
        state.update((closes, position, above))
        yield pd.DataFrame({"ticker": key[0], "start": rows["start"], "close": rows["close"], "position": pd.Series(held, dtype="int32")})

    return bar_stream.groupBy("ticker").applyInPandasWithState(step, POSITIONS, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and returns the result table (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a Parquet table and returns it; no row passes the driver.

    Appended results are written exactly once by the checkpoint.  In complete mode
    every micro-batch writes the whole result to a folder of its own below ``path``,
    and the last one is returned.
    """
    if mode == "complete":
        last = []

        def write(rows: DataFrame, batch_id: int) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/{batch_id}")
            last[:] = [batch_id]

        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        read = stream.sparkSession.read.schema(stream.schema)
        return read.parquet(f"{path}/{last[0]}") if last else stream.sparkSession.createDataFrame([], stream.schema)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


KEPT_VERSIONS = 2  # of a keyed table: the one in use and the one before, which a reader may still have open


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions below ``path``: Spark marks a folder when all of it is written."""
    found = [int(x[1:]) for x in folder_names(spark, path) if x.startswith("v") and x[1:].isdigit()]
    return sorted(v for v in found if "_SUCCESS" in folder_names(spark, f"{path}/v{v}"))


def read_keyed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest complete version of a keyed table; empty before the first."""
    versions = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{versions[-1]}") if versions else spark.createDataFrame([], schema)


def merge_keyed(rows: DataFrame, batch_id: int, path: str, key: list[str], order: list[str]) -> None:
    """Writes version ``batch_id``: of each key, the row that is last by ``order`` among the version before and ``rows``.

    A batch that runs again, after a failure, merges into the same version before and writes the same.
    """
    spark, columns = rows.sparkSession, rows.columns
    before = [v for v in _versions(spark, path) if v < batch_id]
    old = [spark.read.schema(rows.schema).parquet(f"{path}/v{before[-1]}")] if before else []
    both = rows.unionByName(old[0]) if old else rows
    rest = [c for c in columns if c not in key]
    last = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*").select(*columns)
    last.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
    for v in before[: 1 - KEPT_VERSIONS]:
        remove_folder(spark, f"{path}/v{v}")


def run_latest(quotes: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the latest quote of each ticker as a stream in update mode, merged into a keyed table batch by batch, and returns the table."""
    stream = latest(quotes)

    def merge(rows: DataFrame, batch_id: int) -> None:
        merge_keyed(rows, batch_id, path, ["ticker"], ["ts", "event_id"])

    query = stream.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_keyed(stream.sparkSession, path, stream.schema)


def late_ticks(quotes: DataFrame, width: str, delay: str, seen: Column) -> Column:
    """Whether a tick's bar had ended ``delay`` before ``seen``, the latest time of the batches before: its bar is closed then."""
    return F.coalesce(F.window("ts", width)["end"] <= seen - F.expr(f"interval {delay}"), F.lit(False))


def run_bars_and_late(quotes: DataFrame, width: str, delay: str, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Bars of a stream in append mode with a watermark of ``delay``, and the ticks that came too late for their bar.

    Both streams read the same files in the same order.  A batch drops ticks by the
    watermark that the batch before it began with, so the latest time of all batches
    but the last one before decides.  The second stream keeps these times in a small
    table beside its late ticks; a batch is written under its number, so one that
    runs again replaces itself.
    """
    spark = quotes.sparkSession
    made = run_to_parquet(bars(quotes, width, delay), f"{path}/bars", f"{checkpoint}/bars")

    def sort_out(rows: DataFrame, batch_id: int) -> None:
        done = [b for b in (int(x) for x in folder_names(spark, f"{path}/seen")) if b < batch_id - 1]
        marks = spark.read.parquet(*(f"{path}/seen/{b}" for b in done)).agg(F.max("seen")).first()[0] if done else None
        own = rows.withColumn("late", late_ticks(rows, width, delay, F.lit(marks).cast("timestamp")))
        own.where("late").drop("late").write.mode("overwrite").parquet(f"{path}/late/{batch_id}")
        rows.agg(F.max("ts").alias("seen")).write.mode("overwrite").parquet(f"{path}/seen/{batch_id}")

    query = quotes.writeStream.foreachBatch(sort_out).option("checkpointLocation", f"{checkpoint}/late").trigger(availableNow=True).start()
    query.awaitTermination()
    batches = folder_names(spark, f"{path}/late")
    late = spark.read.schema(quotes.schema).parquet(*(f"{path}/late/{b}" for b in batches)) if batches else spark.createDataFrame([], quotes.schema)
    return made, late
