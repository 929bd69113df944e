"""Technical factors and features per ticker; all share one partitioning and one sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.functions.windows import corr_of, kurt_of, rolling, skew_of, wt, wt_last
from factorloom.operators.rules import exponential_means


def _named(name: str):
    return lambda: F.col(name)


close_, high_, low_, open_, volume_, amount_ = map(_named, ("close", "high", "low", "open", "volume", "amount"))


def change(x: str | Column, n: int = 1) -> Column:
    """Relative change over ``n`` rows of the ticker."""
    x = F.col(x) if isinstance(x, str) else x
    return x / F.lag(x, n).over(wt()) - 1


def roc(periods=(5, 10, 20, 60, 120)) -> dict[str, Column]:
    return {f"roc_{n}d": change(close_(), n) for n in periods}


def price_to_sma(periods=(10, 20, 60)) -> dict[str, Column]:
    return {f"price_to_sma_{n}d": close_() / rolling(F.avg, close_(), n) - 1 for n in periods}


def momentum_composite(long: int = 60, short: int = 5) -> dict[str, Column]:
    return {f"momentum_composite_{long}_{short}": change(close_(), long) - change(close_(), short)}


def rank_momentum(n: int = 20) -> dict[str, Column]:
    low, high = rolling(F.min, close_(), n), rolling(F.max, close_(), n)
    return {f"rank_momentum_{n}d": (close_() - low) / (high - low + 1e-8)}


def realized_volatility(periods=(20, 60)) -> dict[str, Column]:
    return {f"realized_vol_{n}d": rolling(F.stddev_samp, F.col("ret1"), n) for n in periods}


def range_volatility(n: int = 20) -> dict[str, Column]:
    """Parkinson and Garman-Klass volatility; the second is null where its mean is negative."""
    hl, co = F.pow(F.ln(high_() / low_()), 2), F.pow(F.ln(close_() / open_()), 2)
    gk = rolling(F.avg, 0.5 * hl - (2 * math.log(2) - 1) * co, n)
    return {
        f"parkinson_vol_{n}d": F.sqrt(rolling(F.avg, hl, n) / (4 * math.log(2))),
        f"garman_klass_vol_{n}d": F.when(gk >= 0, F.sqrt(gk)),
    }


def return_moments(n: int = 20) -> dict[str, Column]:
    full = F.count("ret1").over(wt_last(n)) == n
    return {f"skewness_{n}d": F.when(full, skew_of("ret1", wt_last(n))), f"kurtosis_{n}d": F.when(full, kurt_of("ret1", wt_last(n)))}


def turnover_factors(periods=(5, 20)) -> dict[str, Column]:
    t, out = F.col("turnover_"), {}
    for n in periods:
        out |= {f"turnover_mean_{n}d": rolling(F.avg, t, n), f"turnover_std_{n}d": rolling(F.stddev_samp, t, n), f"turnover_roc_{n}d": change(t, n)}
    return out


def volume_price(n: int = 20) -> dict[str, Column]:
    """Correlation of return and volume, deviation from the volume-weighted price, illiquidity."""
    w = wt_last(n)
    both = F.when(F.count(F.when(F.col("ret1").isNotNull(), volume_())).over(w) == n, corr_of("ret1", "volume", w))
    vwap = rolling(F.sum, close_() * volume_(), n) / rolling(F.sum, volume_(), n)
    return {
        f"volume_price_corr_{n}d": both, f"vwap_dev_{n}d": close_() / vwap - 1,
        f"amihud_illiq_{n}d": rolling(F.avg, F.abs("ret1") / (amount_() + 1e-8), n),
    }


def price_range(periods=(5, 20)) -> dict[str, Column]:
    return {f"hl_range_mean_{n}d": rolling(F.avg, (high_() - low_()) / close_(), n) for n in periods}


def core_factors() -> dict[str, Column]:
    r = F.col("ret1")
    return {
        "rev_20d": -change(close_(), 20), "rvol_20d": -rolling(F.stddev_samp, r, 20), "max_ret_20d": -rolling(F.max, r, 20),
        "turnover_20d": -rolling(F.avg, F.col("turnover_"), 20), "mom_frog_20d": change(close_(), 20) / (rolling(F.sum, F.abs(r), 20) + 1e-8),
    }


FAMILIES = {
    "momentum": lambda: roc() | price_to_sma() | momentum_composite() | rank_momentum(),
    "volatility": lambda: realized_volatility() | range_volatility() | return_moments(),
    "volume_price": lambda: turnover_factors() | volume_price(),
    "range": price_range,
    "core": core_factors,
}
TWINS = {"realized_vol_20d": "rvol_20d", "turnover_mean_20d": "turnover_20d"}  # redundant beside these core factors


def staged(panel: DataFrame) -> DataFrame:
    """``panel`` with ``ret1`` and ``turnover_``, on which the factor expressions stand."""
    from factorloom.operators.filters import turnover_of

    return panel.withColumns({"ret1": change(close_()), "turnover_": turnover_of(panel.columns)})


def factors(panel: DataFrame, families: list[str] | None = None) -> DataFrame:
    """``date, ticker`` and all factors of the families in one select: one shuffle by ticker, one sort."""
    columns = {}
    for f in families or FAMILIES:
        columns |= FAMILIES[f]()
    return staged(panel).select("date", "ticker", *(c.alias(n) for n, c in columns.items()))


def factor_registry(spark) -> DataFrame:
    """``factor, family, period`` of every factor."""
    import re

    rows = [(n, f, int(m[1]) if (m := re.search(r"_(\d+)d", n)) else None) for f, make in FAMILIES.items() for n in make()]
    schema = T.StructType().add("factor", "string").add("family", "string").add("period", "int")
    return spark.createDataFrame(rows, schema)


# ---- technical features


def returns_and_momentum() -> dict[str, Column]:
    return {f"return_{n}d": change(close_(), n) for n in (1, 5, 10, 20)} | {f"momentum_{n}d": close_() - F.lag(close_(), n).over(wt()) for n in (3, 5, 10, 20)}


def rolling_prices(periods=(5, 10, 20, 30)) -> dict[str, Column]:
    out = {}
    for n in periods:
        low, high = rolling(F.min, close_(), n), rolling(F.max, close_(), n)
        out |= {
            f"rolling_mean_{n}d": rolling(F.avg, close_(), n), f"rolling_std_{n}d": rolling(F.stddev_samp, close_(), n),
            f"rolling_median_{n}d": rolling(lambda x: F.percentile(x, 0.5), close_(), n),
            f"price_position_{n}d": F.when(high > low, 2 * (close_() - low) / (high - low) - 1),
        }
    return out


def true_range() -> Column:
    before = F.lag(close_()).over(wt())
    return F.greatest(high_() - low_(), F.abs(high_() - before), F.abs(low_() - before))


def volume_features() -> dict[str, Column]:
    out = {"volume_change": change(volume_())} | {f"volume_ma_{n}d": rolling(F.avg, volume_(), n) for n in (5, 20)}
    out |= {f"volume_ratio_{n}d": volume_() / rolling(F.avg, volume_(), n) for n in (5, 20)}
    return out | {f"volume_roc_{n}d": change(volume_(), n) for n in (3, 5, 10)}


def intraday() -> dict[str, Column]:
    return {
        "high_low_ratio": high_() / low_(), "open_close_ratio": open_() / close_(), "body": F.abs(close_() - open_()) / open_(), "upper_shadow": (high_() - F.greatest(open_(), close_())) / close_(),
        "lower_shadow": (F.least(open_(), close_()) - low_()) / close_(), "daily_range": (high_() - low_()) / open_(),
    }


def bollinger(n: int = 20, width: float = 2.0) -> dict[str, Column]:
    mid, sd = rolling(F.avg, close_(), n), rolling(F.stddev_samp, close_(), n)
    up, low = mid + width * sd, mid - width * sd
    return {"bb_middle": mid, "bb_upper": up, "bb_lower": low, "bb_position": (close_() - low) / (up - low), "bb_width": (up - low) / mid}


def features(panel: DataFrame) -> DataFrame:
    """``date, ticker`` and the technical features of the same day, without MACD."""
    gain = F.when(F.col("delta") > 0, F.col("delta")).otherwise(0.0)
    loss = F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0.0)
    df = staged(panel).withColumns({"delta": close_() - F.lag(close_()).over(wt()), "true_range": true_range()})
    df = df.withColumns({"gain": gain, "loss": loss})
    up, down = rolling(F.avg, F.col("gain"), 14), rolling(F.avg, F.col("loss"), 14)
    columns = returns_and_momentum() | rolling_prices() | {"atr_14": rolling(F.avg, F.col("true_range"), 14)}
    columns |= {f"volatility_{n}d": rolling(F.stddev_samp, F.col("ret1"), n) for n in (5, 20)} | return_moments(20)
    columns |= volume_features() | intraday() | {"rsi_14": 100 - 100 / (1 + up / F.when(down != 0, down))} | bollinger()
    return df.select("date", "ticker", *(c.alias(n) for n, c in columns.items()))


def shifted(df: DataFrame, columns: list[str], by: int = 1) -> DataFrame:
    """Day t sees the features of day t - ``by``."""
    return df.withColumns({c: F.lag(c, by).over(wt()) for c in columns})


def with_macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """``panel`` with ``macd, macd_signal, macd_hist`` by exponential means with adjusted weights."""
    df = exponential_means(panel, {"_fast": ("close", fast), "_slow": ("close", slow)})
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = exponential_means(df, {"macd_signal": ("macd", signal)})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """``date, ticker, macd, macd_signal, macd_hist``; see ``with_macd``."""
    return with_macd(panel.select("date", "ticker", "close"), fast, slow, signal).drop("close")


def window_summaries(panel: DataFrame, n: int = 10, columns=("close", "volume")) -> DataFrame:
    """Summary features of the ``n`` rows before each row."""
    w = wt().rowsBetween(-n, -1)
    out = {}
    for c in columns:
        x, full = F.col(c), F.count(c).over(w) == n
        made = {
            "sum": F.sum(x), "median": F.percentile(x, 0.5), "mean": F.avg(x), "length": F.count(x), "std": F.stddev_pop(x),
            "var": F.var_pop(x), "rms": F.avg(x * x), "max": F.max(x), "abs_max": F.max(F.abs(x)), "min": F.min(x),
        }
        for name, e in made.items():
            e = e.over(w)
            out[f"auto_{c}_{name}"] = F.when(full, F.sqrt(e) if name == "rms" else e.cast("double"))
    return panel.select("date", "ticker", *(e.alias(k) for k, e in out.items()))


def largest_variance(df: DataFrame, columns: list[str], k: int = 50) -> DataFrame:
    """``feature, variance`` of the ``k`` features that vary most, one aggregation over all."""
    row = df.agg(*(F.var_pop(c).alias(c) for c in columns))
    return row.unpivot([], columns, "feature", "variance").orderBy(F.desc("variance"), "feature").limit(k)


def report_ratios(reports: DataFrame) -> DataFrame:
    """Financial ratios in report order of each ticker."""
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("report_date")
    roe = F.col("net_profit") / F.col("assets")
    df = reports.withColumn("roe", roe)
    return df.select(
        "ticker", "report_date", "announce_date", (F.col("net_profit") / F.col("revenue")).alias("fin_profit_quality"),
        (F.col("roe") - F.lag("roe").over(w)).alias("fin_roe_change"), F.avg("roe").over(w.rowsBetween(-3, 0)).alias("fin_roe_mean_4q"),
        (F.col("debt") / F.col("assets")).alias("fin_leverage"),
    )


def fill_forward(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """The ticker's last value where it is at most ``limit`` rows old."""
    n = F.row_number().over(wt())
    past = wt().rowsBetween(-(1 << 30), 0)
    df = df.withColumn("_n", n)
    filled = {}
    for c in columns:
        held = F.last(F.when(F.col(c).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(c).alias("x"))), ignorenulls=True).over(past)
        filled[c] = F.when(F.col("_n") - held["n"] <= limit, held["x"])
    return df.withColumns(filled).drop("_n")
