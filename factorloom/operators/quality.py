"""Data-quality reports and point-in-time checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.windows import wt
from factorloom.operators.order import exact_quantiles


def column_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, n, missing, extreme``: share of nulls, and of values outside the 1 % and 99 % quantiles."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "x")
    cuts = exact_quantiles(long, "x", ["feature"], [0.01, 0.99], "q")
    outside = F.coalesce((F.col("x") < F.col("q")[0]) | (F.col("x") > F.col("q")[1]), F.lit(False))
    return long.join(F.broadcast(cuts), "feature", "left").groupBy("feature").agg(
        F.count("*").alias("n"), F.avg(F.col("x").isNull().cast("int")).alias("missing"), F.avg(outside.cast("int")).alias("extreme")
    )


def panel_quality(df: DataFrame, most_gap: int = 15, most_duplicates: float = 0.01, least_tradable: float = 0.7, limit: float = 0.095) -> DataFrame:
    """One row of a panel's counts, shares, red flags and ``status``: WARNING with any flag, else PASS.

    Repeated keys count beyond their first row.  With ``tradable_flag`` the share
    of tradable rows is told, with ``volume`` that of suspended ones (volume 0), and
    of ``pct_change`` (else the change of ``close`` within the ticker) the moves
    beyond ``limit`` up and down; parts whose columns are missing are null.  Flags:
    ``duplicates`` above a share of 1 %, ``tradable`` below 70 %, ``gap`` between
    two dates above ``most_gap`` days.
    """
    has = set(df.columns)
    change = F.col("pct_change") if "pct_change" in has else F.col("close") / F.lag("close").over(wt()) - 1 if "close" in has else F.lit(None).cast("double")
    rows = df.withColumn("_change", change)
    hit = lambda c: F.count(F.when(c, 1))
    absent = F.lit(None).cast("long")
    counts = rows.agg(
        F.count("*").alias("n"), (F.sum("tradable_flag").cast("long") if "tradable_flag" in has else absent).alias("tradable"),
        (hit(F.col("volume") == 0) if "volume" in has else absent).alias("suspended"),
        hit(F.col("_change") > limit).alias("limit_up"), hit(F.col("_change") < -limit).alias("limit_down"),
    )
    keys = df.groupBy("date", "ticker").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_keys"))
    dates = df.select("date").distinct()
    gap = dates.withColumn("g", F.datediff("date", F.lag("date").over(Window.orderBy("date")))).agg(F.max("g").alias("largest_gap"))
    out = counts.join(F.broadcast(keys), F.lit(True)).join(F.broadcast(gap), F.lit(True))
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    out = out.withColumns({"tradable_share": share("tradable"), "suspended_share": share("suspended"), "limit_share": F.try_divide(F.col("limit_up") + F.col("limit_down"), F.col("n"))})
    flags = F.concat_ws(
        ",", F.when(share("duplicate_keys") > most_duplicates, "duplicates"), F.when(F.col("tradable_share") < least_tradable, "tradable"), F.when(F.col("largest_gap") > most_gap, "gap")
    )
    out = out.withColumn("flags", flags)
    return out.withColumn("status", F.when(F.col("flags") != "", "WARNING").otherwise("PASS"))


def red_flags(columns: DataFrame, most_missing: float = 0.2, most_extreme: float = 0.021) -> DataFrame:
    flags = F.concat_ws(",", F.when(F.col("missing") > most_missing, "missing"), F.when(F.col("extreme") > most_extreme, "extreme"))
    return columns.withColumn("flags", flags)


def pit_tail(returns: DataFrame, target: str, horizon: int) -> DataFrame:
    """One row ``tail_ok``: every ticker's missing targets are exactly its last ``horizon`` rows' number."""
    per = returns.groupBy("ticker").agg((F.count("*") - F.count(target)).alias("n"), F.count("*").alias("total"))
    return per.agg(F.bool_and(F.col("n") == F.least(F.lit(horizon), "total")).alias("tail_ok"))


def pit_validation(
    df: DataFrame, target: str, core: list[str], financial: list[str] | None = None, rows: int = 10, most_core: float = 0.01, most_financial: float = 0.35, order: str | None = None
) -> DataFrame:
    """One row ``tail_kept, core_missing, financial_missing, features_valid, time_ordered, passed``.

    The target must have nulls in the last ``rows`` rows by date and ticker (what
    is beyond the data can't be known), market columns may miss less than 1 % of
    their values, financial ones less than 35 %.  Rows are in time order if along
    ``order``, the column that tells how they are stored, no date is before an
    earlier one; without it that check passes.
    """
    missing = lambda cs: sum(F.avg(F.col(c).isNull().cast("double")) for c in cs) / len(cs) if cs else F.lit(None).cast("double")
    shares = df.agg(missing(core).alias("core_missing"), missing(financial or []).alias("financial_missing"))
    tail = df.select("date", "ticker", target).orderBy(F.desc("date"), F.desc("ticker")).limit(rows).agg((F.count("*") > F.count(target)).alias("tail_kept"))
    ordered = df.groupBy().agg(F.lit(True).alias("time_ordered"))
    if order:  # dates rise along the order if every date's rows lie behind those of all dates before
        spans = df.groupBy("date").agg(F.min(order).alias("a"), F.max(order).alias("b"))
        before = F.max("b").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))  # a row a date
        ordered = spans.withColumn("_before", before).agg(F.coalesce(F.bool_and(F.col("a") > F.col("_before")), F.lit(True)).alias("time_ordered"))
    out = shares.join(F.broadcast(tail), F.lit(True)).join(F.broadcast(ordered), F.lit(True))
    valid = (F.col("core_missing") < most_core) & (F.coalesce("financial_missing", F.lit(0.0)) < most_financial)
    out = out.withColumn("features_valid", valid)
    return out.withColumn("passed", F.col("tail_kept") & F.col("features_valid") & F.col("time_ordered"))


def feature_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing count, mean, deviation, corrected skewness and kurtosis, and outliers by the quartile rule."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "x")
    n = F.count("x")
    stats = long.groupBy("feature").agg(
        (F.count("*") - n).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.when(n >= 3, F.sqrt(n * (n - 1.0)) / (n - 2) * F.skewness("x")).alias("skew"),
        F.when(n >= 4, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * F.kurtosis("x") + 6)).alias("kurt"),
    ).join(exact_quantiles(long, "x", ["feature"], [0.25, 0.75], "q"), "feature", "left")
    reach = 1.5 * (F.col("q")[1] - F.col("q")[0])
    out = (F.col("x") < F.col("q")[0] - reach) | (F.col("x") > F.col("q")[1] + reach)
    counts = long.join(F.broadcast(stats.select("feature", "q")), "feature").groupBy("feature").agg(F.count(F.when(out, 1)).alias("outliers"))
    return stats.drop("q").join(counts, "feature")
