"""Tradability rules, filter log and other row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.windows import forward_filled, wt

STAGES = ["st", "suspended", "limit_move", "listing_age", "volume", "price", "turnover"]


def limit_move(threshold: float = 0.095) -> Column:
    """The close moved by more than the limit: 4.8 % for ST, 19.8 % for tickers 300/688 that are not, else ``threshold``."""
    code = F.col("ticker").cast("string")
    limit = F.when(F.col("st_flag") == 1, 0.048).when(code.startswith("300") | code.startswith("688"), 0.198).otherwise(threshold)
    return F.abs(F.col("close") / F.lag("close").over(wt()) - 1) > limit


def turnover_of(columns: list[str]) -> Column:
    """The first of turnover, turnover rate and volume by shares that the frame has."""
    known = [F.col(c) for c in ("turnover", "turnover_rate") if c in columns]
    return F.coalesce(*known, F.col("volume") / F.col("shares_outstanding"))


def tradability(
    panel: DataFrame, min_volume: float = 0, min_price: float = 1.0, min_turnover: float = 0.0, min_listing_days: int = 60,
    exclude_st: bool = True, exclude_limit_moves: bool = True, limit_threshold: float = 0.095,
) -> DataFrame:
    """Adds ``reject_rule`` (the first failing of seven rules, else null) and ``tradable_flag``; all rows stay."""
    rules = [
        ("st", (F.col("st_flag") == 1) & exclude_st),
        ("suspended", (F.col("volume") == 0) & (F.col("amount") == 0)),
        ("limit_move", F.col("_limit") & exclude_limit_moves),
        ("listing_age", F.datediff("date", "list_date") < min_listing_days),
        ("volume", F.col("volume") < min_volume),
        ("price", F.col("close") < min_price),
        ("turnover", turnover_of(panel.columns) < min_turnover),
    ]
    rule = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        rule = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(rule)
    out = panel.withColumn("_limit", limit_move(limit_threshold)).withColumn("reject_rule", rule).drop("_limit")
    return out.withColumn("tradable_flag", F.col("reject_rule").isNull().cast("int"))


def filter_log(flagged: DataFrame) -> DataFrame:
    """``stage, step, removed, remaining, ratio`` of ``tradability``'s result: one aggregation, then seven rows."""
    spark = flagged.sparkSession
    stages = spark.createDataFrame([(k + 1, s) for k, s in enumerate(STAGES)], "step int, stage string")
    counts = flagged.groupBy(F.coalesce("reject_rule", F.lit("kept")).alias("stage")).agg(F.count("*").alias("n"))
    total = flagged.agg(F.count("*").alias("total"))
    rows = stages.join(counts, "stage", "left").withColumn("removed", F.coalesce("n", F.lit(0)))
    gone = F.sum("removed").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(F.broadcast(total), F.lit(True)).withColumn("remaining", F.col("total") - gone)
    return rows.select("step", "stage", "removed", "remaining", (F.col("remaining") / F.col("total")).alias("ratio"))


def mask_untradable(df: DataFrame, columns: list[str], flag: str = "tradable_flag") -> DataFrame:
    return df.withColumns({c: F.when(F.col(flag) == 1, F.col(c)) for c in columns})


def universe(panel: DataFrame, min_volume: float, min_price: float) -> DataFrame:
    return panel.where((F.col("volume") >= min_volume) & (F.col("close") >= min_price))


def on_calendar(df: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Rows on trading dates; without a calendar, on Mondays to Fridays."""
    if calendar is None:
        return df.where(F.weekday("date") < 5)
    return df.join(calendar.select("date"), "date", "left_semi")


def complete_features(df: DataFrame, core: list[str], filled: list[str]) -> DataFrame:
    """Rows with all ``core`` features; ``filled`` ones carry the ticker's last value forward."""
    return df.dropna(subset=core).withColumns({c: forward_filled(c) for c in filled})
