"""The panel's tables: bars, master, valuation, reports, calendar, quotes and long measurements.

The adapters build them from the star tables (weekly bars of suppliers); a user
with market data passes frames with these columns instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close", "volume", "amount"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, ticker, open, high, low, close, volume, amount``: a week of a supplier's line items is a bar."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    return table(spark, sf_dir, "lineitem").groupBy(week.alias("date"), F.col("l_suppkey").alias("ticker")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, name, industry, list_date, shares_outstanding, st_flag``."""
    listed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker")).agg(
        F.to_date(F.date_trunc("week", F.min("l_shipdate"))).alias("list_date")
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("industry"))
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, "s_nationkey", "left")
        .withColumnRenamed("s_suppkey", "ticker")
        .join(listed, "ticker", "left")
        .select(
            "ticker", F.col("s_name").alias("name"), "industry", "list_date",
            (1000 * (1 + F.abs("s_acctbal"))).alias("shares_outstanding"), (F.col("ticker") % 20 == 0).cast("int").alias("st_flag"),
        )
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with master attributes; the master is small beside the bars, and the planner decides on its size."""
    return bars(spark, sf_dir).join(master(spark, sf_dir), "ticker", "left")


def valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, ticker, market_cap`` on every fourth week only."""
    week = F.floor(F.datediff("date", F.lit("1970-01-05").cast("date")) / 7)
    rows = panel(spark, sf_dir).where(week % 4 == 0)
    return rows.select("date", "ticker", (F.col("close") * F.col("shares_outstanding")).alias("market_cap"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly reports: ``ticker, report_date, announce_date, revenue, net_profit, assets, debt``."""
    quarter = F.date_trunc("quarter", "l_shipdate")
    end = F.to_date(F.date_sub(F.add_months(quarter, 3), 1))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), end.alias("report_date")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum(F.col("l_extendedprice") * (F.col("l_tax") + 0.02)).alias("net_profit"),
        F.sum("l_extendedprice").alias("assets"), F.sum(F.col("l_extendedprice") * F.col("l_discount") * 5).alias("debt"),
    )
    days = (F.lit(20) + F.col("ticker") % 40).cast("int")
    return rows.withColumn("announce_date", F.date_add("report_date", days))


def calendar(bars: DataFrame) -> DataFrame:
    """``date, idx``: the distinct trading dates of bars, numbered from 1 (one row a date, small)."""
    from pyspark.sql import Window

    return bars.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ts, ticker, price, size``."""
    return quotes_of(table(spark, sf_dir, "events"))


def quotes_of(events: DataFrame) -> DataFrame:
    """Quotes from event rows, batch or streaming."""
    return events.select(
        "event_id", "ts", F.col("user_id").alias("ticker"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("size"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ``time, ticker, field, value``: the bars unpivoted."""
    rows = bars(spark, sf_dir).withColumnRenamed("date", "time")
    return rows.unpivot(["time", "ticker"], PRICES, "field", "value")
