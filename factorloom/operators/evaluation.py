"""Scoring of factors against forward returns, on long frames.

``factors`` is ``date, ticker, factor, value``; ``returns`` is ``date, ticker, ret, value``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.tests import p_of_kendall, p_of_ks, p_of_t
from factorloom.functions.windows import average_rank, corr_of
from factorloom.operators.decay import pooled_rank_ic
from factorloom.operators.order import exact_quantiles, two_sample, with_ranks
from factorloom.sources import versions

KEYS = ["date", "factor", "ret"]


def paired(factors: DataFrame, returns: DataFrame) -> DataFrame:
    """``date, ticker, factor, ret, x, y`` with both sides present."""
    x = factors.where("value is not null").select("date", "ticker", "factor", F.col("value").alias("x"))
    y = returns.where("value is not null").select("date", "ticker", "ret", F.col("value").alias("y"))
    return x.join(y, ["date", "ticker"])


def pairs_of(wide: DataFrame, factors: list[str], returns: list[str]) -> DataFrame:
    """``paired`` for factors and returns that are columns of one frame: one pass, no join."""
    cells = [F.struct(F.lit(f).alias("factor"), F.lit(r).alias("ret"), F.col(f).alias("x"), F.col(r).alias("y")) for f in factors for r in returns]
    return wide.select("date", "ticker", F.explode(F.array(*cells)).alias("c")).select("date", "ticker", "c.*").where("x is not null and y is not null")


def daily_ic(pairs: DataFrame, method: str = "spearman", least: int = 3, keys: list[str] = KEYS) -> DataFrame:
    """``date, factor, ret, ic, n``: correlation of values or of their average ranks."""
    if method == "spearman":
        pairs = pairs.withColumns({"x": average_rank("x", keys), "y": average_rank("y", keys)})
    out = pairs.groupBy(*keys).agg(corr_of("x", "y").alias("ic"), F.count("*").alias("n"))
    return out.where((F.col("n") >= least) & F.col("ic").isNotNull())


def ic_summary(ic: DataFrame, per_year: int = 252, keys=("factor", "ret"), p: bool = True) -> DataFrame:
    """Mean, deviation, ICIR, annual ICIR, t, p, n and share of positive dates (beyond rounding of a zero)."""
    out = ic.groupBy(*keys).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("n"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive_ratio")
    )
    out = out.withColumn("icir", F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")))
    out = out.withColumns({"icir_annual": F.col("icir") * math.sqrt(per_year), "t_stat": F.col("icir") * F.sqrt("n")})
    return out.withColumn("p_value", p_of_t("t_stat", F.col("n") - 1.0)) if p else out


def bucket_of(x: Column | str, edges: Column, closed: str = "left") -> Column:
    """Bucket from 1 by inner edges: left-closed counts edges <= x, right-closed different edges < x."""
    x = F.col(x) if isinstance(x, str) else x
    if closed == "left":
        return F.size(F.filter(edges, lambda e: e <= x)) + 1
    return F.size(F.filter(F.array_distinct(edges), lambda e: e < x)) + 1


def inner_edges(x: str, q: int) -> Column:
    return F.percentile(x, [k / q for k in range(1, q)])


def equal_width_edges(x: str, q: int) -> Column:
    low, high = F.min(x), F.max(x)
    return F.array(*(low + (high - low) * (k / q) for k in range(1, q)))


def with_buckets(pairs: DataFrame, q: int, method: str = "quantile", closed: str = "left", keys: list[str] = KEYS) -> DataFrame:
    """``pairs`` with ``bucket``; groups with fewer rows than buckets go."""
    edges = inner_edges("x", q) if method == "quantile" else equal_width_edges("x", q)
    cuts = pairs.groupBy(*keys).agg(edges.alias("_e"), F.count("*").alias("_n"), F.min("x").alias("_m")).where(F.col("_n") >= q)
    if closed == "right":  # an edge that is the smallest value too adds no bucket
        cuts = cuts.withColumn("_e", F.filter("_e", lambda e: e > F.col("_m")))
    return pairs.join(cuts, keys).withColumn("bucket", bucket_of("x", F.col("_e"), closed)).drop("_e", "_n", "_m")


def quantile_returns(pairs: DataFrame, q: int = 5, method: str = "quantile") -> DataFrame:
    """``date, factor, ret, bucket, mean_ret, n``."""
    return with_buckets(pairs, q, method).groupBy(*KEYS, "bucket").agg(F.avg("y").alias("mean_ret"), F.count("*").alias("n"))


def bucket_profile(quantiles: DataFrame) -> DataFrame:
    return quantiles.groupBy("factor", "ret", "bucket").agg(
        F.avg("mean_ret").alias("mean_ret"), F.stddev_samp("mean_ret").alias("std_ret"), F.count("*").alias("n_dates")
    )


def cumulative_returns(quantiles: DataFrame) -> DataFrame:
    """Compounded mean return of each bucket over its dates, and the log of its growth, which does not overflow."""
    w = Window.partitionBy("factor", "ret", "bucket").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = quantiles.select(*KEYS, "bucket", F.sum(F.log1p("mean_ret")).over(w).alias("log_growth"))
    return rows.withColumn("cum_ret", F.expm1("log_growth"))


def spread(quantiles: DataFrame, q: int = 5, method: str = "top_minus_bottom") -> DataFrame:
    """``date, factor, ret, spread``: top bucket less the bottom one or less the mean of all."""
    top = F.avg(F.when(F.col("bucket") == q, F.col("mean_ret")))
    other = F.avg(F.when(F.col("bucket") == 1, F.col("mean_ret"))) if method == "top_minus_bottom" else F.avg("mean_ret")
    return quantiles.groupBy(*KEYS).agg((top - other).alias("spread")).where("spread is not null")


def spread_summary(spreads: DataFrame, per_year: int = 252) -> DataFrame:
    out = spreads.groupBy("factor", "ret").agg(
        F.avg("spread").alias("spread_mean"), F.stddev_samp("spread").alias("spread_std"), F.avg((F.col("spread") > 0).cast("double")).alias("positive_ratio")
    )
    return out.withColumn("sharpe", F.when(F.col("spread_std") > 0, F.col("spread_mean") / F.col("spread_std") * math.sqrt(per_year)))


def monotonicity(quantiles: DataFrame, p: bool = True) -> DataFrame:
    """Kendall's tau of the bucket means over buckets (few rows a factor), and the share of dates in order."""
    means = quantiles.groupBy("factor", "ret", "bucket").agg(F.avg("mean_ret").alias("m"))
    pair = means.alias("a").join(means.alias("b"), ["factor", "ret"]).where("a.bucket < b.bucket")
    tau = pair.groupBy("factor", "ret").agg(F.avg(F.signum(F.col("b.m") - F.col("a.m"))).alias("tau"), F.max("b.bucket").cast("double").alias("q"))
    before = F.lag("mean_ret").over(Window.partitionBy(*KEYS).orderBy("bucket"))
    steps = quantiles.withColumn("_up", F.col("mean_ret") >= before)
    dates = steps.groupBy(*KEYS).agg(F.bool_and("_up").alias("ordered"))
    share = dates.groupBy("factor", "ret").agg(F.avg(F.col("ordered").cast("double")).alias("ordered_ratio"))
    out = tau.join(share, ["factor", "ret"])
    return out.withColumn("p_value", p_of_kendall("tau", "q")) if p else out


def holdings_turnover(factors: DataFrame, q: int = 5, bucket: int = 5) -> DataFrame:
    """``date, factor, turnover`` of a bucket's holdings: 1 - overlap with the previous valid date / size."""
    rows = factors.where("value is not null").withColumnRenamed("value", "x")
    held = with_buckets(rows, q, keys=["date", "factor"]).where(F.col("bucket") == bucket).select("date", "factor", "ticker")
    dates = held.select("date", "factor").distinct()
    dates = dates.withColumn("k", F.row_number().over(Window.partitionBy("factor").orderBy("date")))
    held = held.join(dates, ["date", "factor"])
    before = held.select("factor", "ticker", (F.col("k") + 1).alias("k"), F.lit(1).alias("kept"))
    out = held.where("k > 1").join(before, ["factor", "ticker", "k"], "left")
    return out.groupBy("date", "factor").agg((1 - F.count("kept") / F.count("*")).alias("turnover"))


def autocorrelation(factors: DataFrame, lags=(1, 5, 10)) -> DataFrame:
    """``factor, lag, autocorr``: correlation of a ticker's value with its earlier one, averaged over tickers."""
    w = Window.partitionBy("factor", "ticker").orderBy("date")
    rows = factors.where("value is not null")
    rows = rows.withColumns({f"_l{k}": F.lag("value", k).over(w) for k in lags} | {"_n": F.count("*").over(Window.partitionBy("factor", "ticker"))})
    by_ticker = rows.groupBy("factor", "ticker").agg(*(F.when(F.max("_n") >= k + 10, corr_of("value", f"_l{k}")).alias(str(k)) for k in lags))
    long = by_ticker.unpivot(["factor", "ticker"], [str(k) for k in lags], "lag", "c").where("c is not null")
    return long.groupBy("factor", F.col("lag").cast("int").alias("lag")).agg(F.avg("c").alias("autocorr"))


def psi(rows: DataFrame, keys: list[str], n_bins: int = 10, smooth: str = "floor") -> DataFrame:
    """``keys, psi`` of later rows against earlier ones; ``rows`` has ``keys, x, later`` (boolean).

    Bins are the earlier rows' quantiles, right-closed, open at both ends.  Empty
    shares become 1e-4 (``floor``), or every count gets one more (``add_one``).
    """
    rows = rows.where("x is not null")
    edges = exact_quantiles(rows.where("not later"), "x", keys, [k / n_bins for k in range(1, n_bins)], "_e")
    binned = rows.join(F.broadcast(edges), keys).withColumn("bin", bucket_of("x", F.col("_e"), "right"))
    counts = binned.groupBy(*keys, "bin").agg(
        F.count(F.when(~F.col("later"), 1)).alias("a"), F.count(F.when(F.col("later"), 1)).alias("b"),
    )
    w = Window.partitionBy(*keys)
    a, b = F.col("a"), F.col("b")
    if smooth == "add_one":
        bins = F.count("*").over(w)
        shares = {"p": (a + 1) / (F.sum("a").over(w) + bins), "q": (b + 1) / (F.sum("b").over(w) + bins)}
    else:
        shares = {"p": F.greatest(a / F.sum("a").over(w), F.lit(1e-4)), "q": F.greatest(b / F.sum("b").over(w), F.lit(1e-4))}
    return counts.withColumns(shares).groupBy(*keys).agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))


def ks(rows: DataFrame, keys: list[str], p: bool = True) -> DataFrame:
    """``keys, ks, n1, n2``: largest distance of the two distributions, from running counts by value in pieces of its range."""
    out = two_sample(rows, keys).select(*keys, "ks", "n1", "n2")
    return out.withColumn("p_value", p_of_ks("ks", "n1", "n2")) if p else out


def by_date_share(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds ``later``: the date is beyond the first ``share`` of the distinct dates."""
    dates = rows.select("date").distinct()
    n = dates.count()
    ranked = dates.withColumn("later", F.row_number().over(Window.orderBy("date")) > int(n * share))
    return rows.join(F.broadcast(ranked), "date")


def ic_decay(wide: DataFrame, factors: list[str], horizons: int = 20, price: str = "close") -> DataFrame:
    """``factor, horizon, ic``: pooled rank correlation of each factor with the return over each horizon.

    ``wide`` has a row a date and ticker.  A factor and a horizon rank all complete
    rows, so ranks are counted for few horizons at a time; no row is repeated.
    """
    found = pooled_rank_ic(wide.select("ticker", "date", price, *(f for f in factors if f != price)), factors, horizons, price)
    return wide.sparkSession.createDataFrame(found, "factor string, horizon int, ic double")


def half_life(decay: DataFrame) -> DataFrame:
    """The first horizon whose absolute IC is below half of that of the first."""
    first = F.abs(F.min_by("ic", "horizon").over(Window.partitionBy("factor")))
    rows = decay.withColumn("_first", first)
    return rows.groupBy("factor").agg(F.min(F.when(F.abs("ic") < F.col("_first") / 2, F.col("horizon"))).alias("half_life"))


def combined(wide: DataFrame, columns: list[str], name: str = "combined") -> DataFrame:
    """Long frame of the row mean of the kept factors."""
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(present).cast("double"), F.lit(0.0))
    return wide.select("date", "ticker", F.lit(name).alias("factor"), mean.alias("value"))


def analyze(pairs: DataFrame, q: int = 5, least: int = 3, method: str = "spearman", p: bool = True) -> DataFrame:
    """A row for each factor and return: IC summary, spread of the extreme buckets and monotonicity, all in one."""
    buckets = quantile_returns(pairs, q)
    summary = ic_summary(daily_ic(pairs, method, least), p=p)
    return summary.join(spread_summary(spread(buckets, q)), ["factor", "ret"], "left").join(monotonicity(buckets, p=False).drop("q"), ["factor", "ret"], "left")


def qualified(analysis: DataFrame, least_icir: float = 0.5, most_p: float = 0.05, top: int | None = None) -> DataFrame:
    """``analysis`` with ``qualified`` (ICIR above and p below the bounds), the largest ICIR first."""
    ok = (F.col("icir") > least_icir) & (F.col("p_value") < most_p)
    rows = analysis.withColumn("qualified", F.coalesce(ok, F.lit(False))).orderBy(F.desc("icir"), "factor", "ret")
    return rows if top is None else rows.where("qualified").limit(top)


# ---- factor library: an append-only history, one row a factor and version

LIBRARY = "factor string, status string, ic_mean double, icir double"


def add_to_library(candidates: DataFrame, root: str) -> int:
    """``library_add`` to the library written below ``root``; returns the new version's number, 0 if nothing is new."""
    return versions.append(candidates.sparkSession, root, LIBRARY, lambda h, v: _new(library_add(_shaped(h), candidates, v), v))


def update_library(quality: DataFrame, root: str) -> int:
    return versions.append(quality.sparkSession, root, LIBRARY, lambda h, v: _new(library_update(_shaped(h), quality, v), v))


def remove_from_library(factors: DataFrame, root: str) -> int:
    return versions.append(factors.sparkSession, root, LIBRARY, lambda h, v: _new(library_remove(_shaped(h), factors, v), v))


def library_at(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame:
    """The library's history as it stood at a version (default: now)."""
    return _shaped(versions.history(spark, root, LIBRARY, as_of))


def _shaped(history: DataFrame) -> DataFrame:
    return history.select("factor", "version", "status", "ic_mean", "icir")


def _new(history: DataFrame, version: int) -> DataFrame:
    return history.where(F.col("version") == version)


def library_state(history: DataFrame) -> DataFrame:
    """The latest row of each factor."""
    columns = [c for c in history.columns if c != "factor"]
    return history.groupBy("factor").agg(F.max_by(F.struct(*columns), "version").alias("s")).select("factor", "s.*")


def library_add(history: DataFrame, candidates: DataFrame, version: int) -> DataFrame:
    """``history`` and the candidates (``factor, ic_mean, icir, passed``) that passed and are not active in it."""
    active = library_state(history).where("status = 'active'").select("factor")
    new = candidates.where("passed").join(active, "factor", "left_anti")
    return history.unionByName(new.select("factor", F.lit(version).alias("version"), F.lit("active").alias("status"), "ic_mean", "icir"))


def library_update(history: DataFrame, quality: DataFrame, version: int) -> DataFrame:
    """``history`` and a new version of each active factor with its new quality (``factor, ic_mean, icir``)."""
    active = library_state(history).where("status = 'active'").select("factor")
    rows = quality.join(active, "factor", "left_semi")
    return history.unionByName(rows.select("factor", F.lit(version).alias("version"), F.lit("active").alias("status"), "ic_mean", "icir"))


def library_remove(history: DataFrame, factors: DataFrame, version: int) -> DataFrame:
    """``history`` and a row with status ``removed`` of each active factor among ``factors``."""
    rows = library_state(history).where("status = 'active'").join(factors.select("factor"), "factor", "left_semi")
    return history.unionByName(rows.select("factor", F.lit(version).alias("version"), F.lit("removed").alias("status"), "ic_mean", "icir"))


def library_report(history: DataFrame) -> DataFrame:
    """Active factors with their number of versions, the largest absolute IC first."""
    versions = history.groupBy("factor").agg(F.count("*").alias("versions"))
    rows = library_state(history).where("status = 'active'").join(versions, "factor")
    return rows.orderBy(F.desc(F.abs("ic_mean")), "factor")


def prediction_metrics(df: DataFrame, y: str = "y_true", z: str = "y_pred") -> DataFrame:
    """MSE, MAE, RMSE, R2, IC and rank IC over all complete rows."""
    rows = df.where(F.col(y).isNotNull() & F.col(z).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))
    rows = with_ranks(with_ranks(rows, "y", [], "ry"), "z", [], "rz")
    e = F.col("y") - F.col("z")
    return rows.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.avg(e * e) / F.var_pop("y")).alias("r2"), corr_of("y", "z").alias("ic"), corr_of("ry", "rz").alias("rank_ic"), F.count("*").alias("n"),
    )


def bucket_performance(buckets: DataFrame, y: str = "y") -> DataFrame:
    """``bucket, n, mean_ret, std_ret`` of bucketed predictions."""
    return buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(y).alias("mean_ret"), F.stddev_samp(y).alias("std_ret"))


def family_summary(summary: DataFrame, registry: DataFrame) -> DataFrame:
    rows = summary.join(F.broadcast(registry), "factor").groupBy("family").agg(
        F.count("*").alias("n"), F.avg("ic_mean").alias("mean_ic"), F.avg("icir").alias("mean_icir"), F.stddev_samp("ic_mean").alias("std_ic")
    )
    return rows.orderBy(F.desc(F.abs("mean_ic")), "family")


def monthly_ic(ic: DataFrame) -> DataFrame:
    """``factor, ret, month`` and a mean IC column a year."""
    years = [r[0] for r in ic.select(F.year("date")).distinct().orderBy(F.year("date")).collect()]
    rows = ic.withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    return rows.groupBy("factor", "ret", "month").pivot("year", years).agg(F.avg("ic"))
