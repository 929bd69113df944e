"""Forward returns, labels and sliding samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.tests import inverse_normal
from factorloom.functions.windows import average_rank, wd, wt, wt_last
from factorloom.operators.order import exact_quantiles, with_ranks


def forward_return(n: int, price: str = "close", lag: int = 0, log: bool = False) -> Column:
    """Return from ``lag`` rows ahead over the next ``n`` rows of the ticker."""
    ratio = F.lead(price, lag + n).over(wt()) / F.lead(price, lag).over(wt())
    return F.ln(ratio) if log else ratio - 1


def forward_returns(panel: DataFrame, periods=(1, 5, 10), price: str = "close", lag: int = 1, log: bool = False) -> DataFrame:
    return panel.select("date", "ticker", *(forward_return(n, price, lag, log).alias(f"ret_{n}d") for n in periods))


def future_returns(panel: DataFrame, periods=(1, 5, 10)) -> DataFrame:
    return panel.select("date", "ticker", *(forward_return(n).alias(f"future_return_{n}d") for n in periods))


def tail_nulls(returns: DataFrame, periods=(1, 5, 10)) -> DataFrame:
    """Per ticker: is the number of missing forward returns the horizon (or the whole history)?"""
    ok = [(F.count(F.when(F.col(f"future_return_{n}d").isNull(), 1)) == F.least(F.lit(n), F.count("*"))).alias(f"ok_{n}d") for n in periods]
    return returns.groupBy("ticker").agg(*ok)


def binary_label(r: str) -> Column:
    """1 for a positive return, 0 for others; null stays null."""
    return F.when(F.col(r).isNotNull(), (F.col(r) > 0).cast("int"))


def history_quantile_label(df: DataFrame, r: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """``label``: 0 up to the ticker's low quantile, 2 above its high one, else 1."""
    cuts = df.groupBy("ticker").agg(F.percentile(r, [low, high]).alias("_cuts"))
    label = F.when(F.col(r) <= F.col("_cuts")[0], 0).when(F.col(r) <= F.col("_cuts")[1], 1).when(F.col(r).isNotNull(), 2)
    return df.join(cuts, "ticker", "left").withColumn("label", label).drop("_cuts")


def excess_over_index(df: DataFrame, r: str, index: DataFrame) -> DataFrame:
    """``residual`` = return less the index's (``date, index_ret``); the raw value where the index has none."""
    out = df.join(index.select("date", "index_ret"), "date", "left")
    return out.withColumn("residual", F.coalesce(F.col(r) - F.col("index_ret"), r)).drop("index_ret")


def demeaned(df: DataFrame, r: str, keys=("date",), least: int = 10) -> DataFrame:
    """``residual`` = return less the mean of its group; the raw value where the date has too few names."""
    n = F.count(r).over(wd())
    mean = F.avg(r).over(Window.partitionBy(*keys))
    return df.withColumn("residual", F.when(n >= least, F.col(r) - mean).otherwise(F.col(r)))


def percent_rank(df: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    """``rank_pct`` = average rank / n per date or over all rows.

    Over all rows, ranks come from pieces of the value's range: no task sorts all.
    """
    keys = ["date"] if keys is None else keys
    own = df.where(F.col(x).isNotNull())
    if keys:
        n = F.count(x).over(Window.partitionBy(*keys))
        ranked = own.withColumn("rank_pct", average_rank(x, keys) / n)
        return ranked.unionByName(df.where(F.col(x).isNull()).withColumn("rank_pct", F.lit(None).cast("double")))
    ranked = with_ranks(own, x, []).join(F.broadcast(own.agg(F.count("*").alias("_total"))), F.lit(True))
    ranked = ranked.withColumn("rank_pct", F.col("rank") / F.col("_total")).drop("rank", "_total")
    return ranked.unionByName(df.where(F.col(x).isNull()).withColumn("rank_pct", F.lit(None).cast("double")))


def rank_labels(df: DataFrame, r: str, kind: str = "zscore", least: int = 30) -> DataFrame:
    """``rank_label`` per date: average rank to [0, 1], as it is (``uniform``), standardized or Gaussian; thin dates go."""
    own = df.where(F.col(r).isNotNull()).withColumn("_n", F.count("*").over(wd())).where(F.col("_n") >= least)
    own = own.withColumn("_p", (average_rank(r, ["date"]) - 1) / (F.col("_n") - 1))
    if kind == "zscore":
        label = (F.col("_p") - F.avg("_p").over(wd())) / F.stddev_samp("_p").over(wd())
    elif kind == "gaussian":
        label = inverse_normal(F.least(F.greatest("_p", F.lit(0.001)), F.lit(0.999)))
    else:
        label = F.col("_p")
    return own.withColumn("rank_label", label).drop("_n", "_p")


def grade_labels(df: DataFrame, r: str, grades: int = 5) -> DataFrame:
    """``grade`` = min(int(pct * grades), grades - 1) with the average rank / n per date."""
    own = df.where(F.col(r).isNotNull())
    pct = average_rank(r, ["date"]) / F.count("*").over(wd())
    return own.withColumn("grade", F.least(F.floor(pct * grades), F.lit(grades - 1)).cast("int"))


def quantile_labels(df: DataFrame, r: str, q: int = 5, per_date: bool = True) -> DataFrame:
    """``label`` from 0 by quantiles of the date or of all rows: the different edges below the value.

    Intervals are closed on the right, equal edges count once, so there may be
    fewer than ``q`` labels.  A date with fewer than ``q`` values has none, nor has
    a group of one value only; null stays null.
    """
    shares = [k / q for k in range(q)]
    if per_date:
        cuts = df.groupBy("date").agg(F.percentile(r, shares).alias("_e"), F.max(r).alias("_m"), F.count(r).alias("_n")).where(F.col("_n") >= q)
        out = df.join(cuts, "date", "left")
    else:
        cuts = exact_quantiles(df, r, [], shares, "_e").join(F.broadcast(df.agg(F.max(r).alias("_m"))), F.lit(True))
        out = df.join(F.broadcast(cuts), F.lit(True), "left")
    label = F.size(F.filter(F.array_distinct("_e"), lambda e: e < F.col(r))) - 1  # the first edge is the smallest value
    label = F.when(F.col(r).isNotNull() & (F.col("_e")[0] < F.col("_m")), F.greatest(label, F.lit(0)))
    return out.select(*df.columns, label.alias("label"))


def forward_returns_with(panel: DataFrame, periods: tuple[int, ...] = (1, 5), transform: str = "none", index: DataFrame | None = None, price: str = "close") -> DataFrame:
    """``panel`` with ``fwd_k`` for each period: the forward return as it is, or its ``excess`` over ``index``, its
    residual from the date's mean (``demeaned``) or the date's and industry's (``industry``), or its ``rank`` in the date."""
    out = panel.withColumns({f"fwd_{k}": forward_return(k, price) for k in periods})
    for k in periods:
        c = f"fwd_{k}"
        if transform == "excess":
            out = excess_over_index(out, c, index).withColumn(c, F.col("residual")).drop("residual")
        elif transform in ("demeaned", "industry"):
            keys = ("date",) if transform == "demeaned" else ("date", "industry")
            out = demeaned(out, c, keys).withColumn(c, F.col("residual")).drop("residual")
        elif transform == "rank":
            out = percent_rank(out, c, ["date"]).withColumn(c, F.col("rank_pct")).drop("rank_pct")
        elif transform != "none":
            raise ValueError(transform)
    return out


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """``label, n, share`` of each class, nulls included as a class."""
    rows = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(df.agg(F.count("*").alias("_t"))), F.lit(True)).select("label", "n", (F.col("n") / F.col("_t")).alias("share"))


def group_sizes(df: DataFrame) -> DataFrame:
    """``date, n`` in date order, as ranking trainers take them."""
    return df.groupBy("date").agg(F.count("*").alias("n")).orderBy("date")


def window_targets(panel: DataFrame, k: int = 5) -> DataFrame:
    """Targets over the next ``k`` rows: price, return, compounded return, direction, highest, lowest."""
    ahead = wt().rowsBetween(1, k)
    full = F.count("close").over(ahead) == k
    df = panel.withColumn("_r", F.col("close") / F.lag("close").over(wt()) - 1)
    ret = F.lead("close", k).over(wt()) / F.col("close") - 1
    return df.select(
        "date", "ticker", F.lead("close", k).over(wt()).alias("target_price"), ret.alias("target_return"),
        F.when(full, F.product(1 + F.col("_r")).over(ahead) - 1).alias("target_return_multi"),
        F.when(ret.isNotNull(), (ret > 0).cast("int")).alias("target_direction"),
        F.when(full, F.max("high").over(ahead)).alias("target_high"), F.when(full, F.min("low").over(ahead)).alias("target_low"),
    )


def sliding_samples(panel: DataFrame, columns: list[str], n: int = 10, stride: int = 5, horizon: int = 1) -> DataFrame:
    """``ticker, start_date, end_date, prediction_date, samples``: windows of ``n`` rows, every ``stride`` rows."""
    row = F.row_number().over(wt())
    picked = panel.select(
        "ticker", F.first("date").over(wt_last(n)).alias("start_date"), F.col("date").alias("end_date"),
        F.lead("date", horizon).over(wt()).alias("prediction_date"), F.lead("close", horizon).over(wt()).alias("target"), row.alias("_n"),
        F.collect_list(F.array(*columns)).over(wt_last(n)).alias("samples"),
    )
    keep = (F.col("_n") >= n) & ((F.col("_n") - n) % stride == 0) & F.col("target").isNotNull()
    return picked.where(keep).drop("_n")
