"""Point-in-time and attribute joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.windows import forward_filled, wt


def effective_dates(reports: DataFrame, calendar: DataFrame, lag_days: int = 1) -> DataFrame:
    """Adds ``effective_date`` (announce date plus the lag, rolled to the next trading date) and ``early``.

    Rolling goes through a table with a row a calendar day, whose next trading
    date is found once; reports then join it by equality.
    """
    span = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    back = (F.max("announce_date"), F.min("announce_date"))
    bounds = reports.agg(back[1].alias("c"), back[0].alias("e")).join(F.broadcast(span), F.lit(True))
    days = bounds.select(F.explode(F.sequence(F.least("a", "c"), F.greatest("b", F.date_add("e", lag_days)))).alias("day"))
    marked = days.join(calendar.select(F.col("date").alias("day"), F.col("date").alias("trading")), "day", "left")
    ahead = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)  # a row a day, thousands in all
    rolled = marked.select("day", F.first("trading", ignorenulls=True).over(ahead).alias("effective_date"))
    out = reports.withColumn("day", F.date_add("announce_date", lag_days)).join(rolled, "day", "left").drop("day")
    return out.withColumn("early", F.col("announce_date") < F.col("report_date"))


def lag_statistics(effective: DataFrame) -> DataFrame:
    days = F.datediff("effective_date", "report_date")
    return effective.agg(F.avg(days).alias("mean_lag"), F.min(days).alias("min_lag"), F.max(days).alias("max_lag"), F.sum(F.col("early").cast("int")).alias("n_early"))


def asof(rows: DataFrame, reports: DataFrame, columns: list[str], limit: int = 95) -> DataFrame:
    """``rows`` (ticker, date) with ``columns`` of the last report effective at the date, at most ``limit`` rows old.

    Both sides are laid into one order per ticker and the last report is carried
    on: linear in both, one shuffle by ticker.  Of reports effective on one day the
    latest report date counts; a report of the day itself is of age 0.
    """
    left = rows.select("*", F.lit(1).alias("_side"), *(F.lit(None).cast(reports.schema[c].dataType).alias(f"_r_{c}") for c in columns))
    right = reports.where("effective_date is not null").groupBy("ticker", F.col("effective_date").alias("date")).agg(
        *(F.max_by(c, "report_date").alias(f"_r_{c}") for c in columns)
    )
    both = left.unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("ticker").orderBy("date", "_side")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_n", F.sum("_side").over(past))
    held = F.struct("date", "_n", *(f"_r_{c}" for c in columns))
    both = both.withColumn("_held", F.last(F.when(F.col("_side") == 0, held), ignorenulls=True).over(past))
    # rows up to the effective day: a row of that day comes after the report and is of age 0
    on_day = F.max(F.when((F.col("_side") == 1) & (F.col("date") == F.col("_held.date")), 1)).over(Window.partitionBy("ticker", "_held.date"))
    age = F.col("_n") - F.col("_held._n") - F.coalesce(on_day, F.lit(0))
    out = both.withColumn("_age", age).where("_side = 1")
    return out.select(*rows.columns, *(F.when(F.col("_age") <= limit, F.col(f"_held._r_{c}")).alias(c) for c in columns))


def attach(bars: DataFrame, attributes: DataFrame, key: str = "ticker") -> DataFrame:
    """Attributes by key; the planner broadcasts them while their size is below its threshold."""
    return bars.join(attributes, key, "left")


def attach_valuation(panel: DataFrame, valuation: DataFrame) -> DataFrame:
    """``market_cap`` of the date, else the ticker's last one, else close times shares."""
    rows = panel.join(valuation.select("date", "ticker", F.col("market_cap").alias("_cap")), ["date", "ticker"], "left")
    filled = F.coalesce(forward_filled("_cap"), F.col("close") * F.col("shares_outstanding"))
    return rows.withColumn("market_cap", filled).drop("_cap")


def merge_new_columns(left: DataFrame, right: DataFrame, keys=("date", "ticker")) -> DataFrame:
    new = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(*keys, *new), list(keys), "left")


def common_rows(a: DataFrame, b: DataFrame, keys=("date", "ticker")) -> DataFrame:
    return a.join(b, list(keys))


def state_as_of(effective: DataFrame, day: str, kind: str = "latest") -> DataFrame:
    """Reports known on a day: the ``latest`` of each ticker, ``all``, or a ``summary``."""
    known = effective.where(F.col("effective_date") <= F.lit(day).cast("date"))
    if kind == "all":
        return known.orderBy("ticker", F.desc("report_date"))
    if kind == "summary":
        return known.groupBy("ticker").agg(F.max("report_date").alias("report_date"), F.max("effective_date").alias("effective_date"), F.count("*").alias("n_reports"))
    return known.groupBy("ticker").agg(F.max_by(F.struct(*[c for c in known.columns if c != "ticker"]), "report_date").alias("r")).select("ticker", "r.*")


def membership_changes(history: DataFrame) -> DataFrame:
    """``ticker, changes, n_dates`` of an index membership history."""
    changed = F.coalesce((F.col("in_index") != F.lag("in_index").over(wt())).cast("int"), F.lit(0))
    return history.withColumn("_c", changed).groupBy("ticker").agg(F.sum("_c").alias("changes"), F.countDistinct("date").alias("n_dates"))
