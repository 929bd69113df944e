"""Cleaning of factors within each date, on the long form ``date, ticker, factor, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.windows import average_rank


def to_long(wide: DataFrame, columns: list[str] | None = None, name: str = "factor") -> DataFrame:
    columns = columns or [c for c in wide.columns if c not in ("date", "ticker")]
    return wide.unpivot(["date", "ticker"], columns, name, "value")


def _keys(cross_section: bool) -> list[str]:
    return ["date", "factor"] if cross_section else ["factor"]


def winsorize(long: DataFrame, low: float = 0.01, high: float = 0.99, cross_section: bool = True) -> DataFrame:
    """Values outside the group's quantiles become the quantiles; groups of fewer than 3 values stay."""
    keys = _keys(cross_section)
    cuts = long.groupBy(*keys).agg(F.percentile("value", [low, high]).alias("_q"), F.count("value").alias("_n"))
    clipped = F.when(F.col("value").isNotNull(), F.least(F.greatest("value", F.col("_q")[0]), F.col("_q")[1]))
    out = long.join(cuts, keys, "left").withColumn("value", F.when(F.col("_n") >= 3, clipped).otherwise(F.col("value")))
    return out.select(*long.columns)


def standardize(long: DataFrame, method: str = "zscore", cross_section: bool = True) -> DataFrame:
    """``zscore`` (a flat group is 0), ``minmax`` (flat: 0.5) or ``rank`` ((r - 1) / (n - 1)); under 3 values stay."""
    keys = _keys(cross_section)
    x = F.col("value")
    if method == "rank":
        own = long.where(x.isNotNull())
        n = F.count("*").over(Window.partitionBy(*keys))
        own = own.withColumn("value", F.when(n >= 3, (average_rank("value", keys) - 1) / (n - 1)).otherwise(x))
        return own.unionByName(long.where(x.isNull()))
    stats = long.groupBy(*keys).agg(
        F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.min("value").alias("_a"), F.max("value").alias("_b"), F.count("value").alias("_n")
    )
    z = F.when(F.col("_s") > 0, (x - F.col("_m")) / F.col("_s")).otherwise(x * 0)
    m = F.when(F.col("_b") > F.col("_a"), (x - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(x * 0 + 0.5)
    out = long.join(stats, keys, "left").withColumn("value", F.when(F.col("_n") >= 3, z if method == "zscore" else m).otherwise(x))
    return out.select(*long.columns)


def neutralize(long: DataFrame, cap: str = "market_cap", industry: str = "industry", constant: bool = True) -> DataFrame:
    """Residual of each date's regression on log cap and industry.

    With industry dummies and a constant: values and log caps are demeaned by
    industry, and one slope a date is taken (Frisch, Waugh, Lovell).  A null
    industry is a group of its own; rows without a positive cap or a value have no
    residual and stay; dates with fewer than 3 complete rows stay.  ``constant``
    false regresses on log cap and the dummies of all but the first industry.
    """
    x = F.when(F.col(cap) > 0, F.ln(cap))
    df = long.withColumn("_x", x).withColumn("_i", F.coalesce(industry, F.lit("?")))
    done = df.where("_x is not null and value is not null")
    rest = df.where("_x is null or value is null")
    keys = ["date", "factor"]
    if not constant:
        import numpy as np

        def residual(pdf):
            if len(pdf) < 3:
                return pdf
            groups = sorted(pdf["_i"].unique())[1:]
            a = np.column_stack([pdf["_x"], *((pdf["_i"] == g).astype(float) for g in groups)])
            coef = np.linalg.lstsq(a, pdf["value"].to_numpy(), rcond=None)[0]
            return pdf.assign(value=pdf["value"] - a @ coef)

        return done.groupBy(*keys).applyInPandas(residual, done.schema).unionByName(rest).select(*long.columns)
    own, all_ = Window.partitionBy(*keys, "_i"), Window.partitionBy(*keys)
    done = done.withColumns({"_dy": F.col("value") - F.avg("value").over(own), "_dx": F.col("_x") - F.avg("_x").over(own), "_n": F.count("*").over(all_)})
    sxx, sxy = F.sum(F.col("_dx") * F.col("_dx")).over(all_), F.sum(F.col("_dx") * F.col("_dy")).over(all_)
    left = F.when(sxx > 1e-18, F.col("_dy") - sxy / sxx * F.col("_dx")).otherwise(F.col("_dy"))
    done = done.withColumn("value", F.when(F.col("_n") >= 3, left).otherwise(F.col("value")))
    return done.select(*long.columns).unionByName(rest.select(*long.columns))


def neutralize_one(long: DataFrame, by: str) -> DataFrame:
    """Residual of each date's regression on one variable; under 3 complete rows, or a constant variable, stay."""
    w = Window.partitionBy("date", "factor")
    y, x = F.when(F.col(by).isNotNull(), F.col("value")), F.when(F.col("value").isNotNull(), F.col(by))
    slope, n = F.try_divide(F.covar_pop(y, x).over(w), F.var_pop(x).over(w)), F.count(y + x).over(w)
    left = F.col("value") - F.avg(y).over(w) - slope * (F.col(by) - F.avg(x).over(w))
    return long.withColumn("value", F.when((n >= 3) & left.isNotNull(), left).otherwise(F.col("value")))


def preprocess(long: DataFrame, low: float = 0.01, high: float = 0.99, method: str = "zscore") -> DataFrame:
    """Winsorized, standardized and neutralized values; ``long`` also has market_cap and industry."""
    return neutralize(standardize(winsorize(long, low, high), method))
