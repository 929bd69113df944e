"""Top-k portfolios and rule strategies on the panel; nothing is expanded to a dense date x ticker grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.windows import rolling, wd, wt, wt_past
from factorloom.operators import rules


def top_scores(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each date by score, untradable ones last, ties by ticker; adds ``rank``."""
    flag = F.coalesce("tradable_flag", F.lit(1)) if "tradable_flag" in scores.columns else F.lit(1)
    w = Window.partitionBy("date").orderBy(F.desc(flag), F.desc_nulls_last("score"), "ticker")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rebalance_dates(dates: DataFrame, freq: str = "daily") -> DataFrame:
    """``date, rebalance``: the first available date of the date's week or month (or itself)."""
    if freq == "daily":
        return dates.select("date", F.col("date").alias("rebalance"))
    period = Window.partitionBy(F.date_trunc({"weekly": "week", "monthly": "month"}[freq], "date"))
    return dates.select("date", F.min("date").over(period).alias("rebalance"))


def weights(picked: DataFrame, method: str = "equal") -> DataFrame:
    """Equal weights, or a softmax of the scores over the held names."""
    if method == "equal":
        return picked.withColumn("weight", 1 / F.count("*").over(wd()))
    e = F.exp(F.col("score") - F.max("score").over(wd()))
    return picked.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(wd())).drop("_e")


def holdings(scores: DataFrame, k: int, freq: str = "daily", method: str = "equal") -> DataFrame:
    """``date, ticker, weight``: each date holds what its rebalance date picked (a join, no loop)."""
    dates = rebalance_dates(scores.select("date").distinct(), freq)
    picked = weights(top_scores(scores, k), method).select(F.col("date").alias("rebalance"), "ticker", "weight")
    return dates.join(picked, "rebalance").select("date", "ticker", "weight")


def open_to_open(panel: DataFrame) -> DataFrame:
    """``date, ticker, fwd``: from the next open to the one after; missing is 0."""
    ret = F.lead("open", 2).over(wt()) / F.lead("open", 1).over(wt()) - 1
    return panel.select("date", "ticker", F.coalesce(ret, F.lit(0.0)).alias("fwd"))


def turnover(held: DataFrame) -> DataFrame:
    """``date, turnover`` = half the sum of absolute weight changes; the first date buys everything.

    Every holding counts plus on its date and minus on the next, so changes are one
    sum over a signed union.
    """
    dates = held.select("date").distinct()
    following = dates.withColumn("next", F.lead("date").over(Window.orderBy("date")))
    gone = held.join(F.broadcast(following), "date").where("next is not null").select(F.col("next").alias("date"), "ticker", (-F.col("weight")).alias("weight"))
    change = held.select("date", "ticker", "weight").unionByName(gone).groupBy("date", "ticker").agg(F.sum("weight").alias("c"))
    return change.groupBy("date").agg((F.sum(F.abs("c")) / 2).alias("turnover"))


def daily_performance(held: DataFrame, forward: DataFrame, commission: float = 3e-4, stamp: float = 1e-3, slippage: float = 5e-4) -> DataFrame:
    """``date, gross, turnover, cost, net, equity, drawdown``; from here on there is a row a date."""
    gross = held.join(forward, ["date", "ticker"], "left").groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("gross"))
    out = gross.join(turnover(held), "date").withColumn("cost", F.col("turnover") * (2 * commission + stamp + slippage))
    return equity_curve(out.withColumn("net", F.col("gross") - F.col("cost")))


def equity_curve(daily: DataFrame, net: str = "net", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``equity`` and ``drawdown`` in date order (one row a date and key)."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("equity", F.product(1 + F.col(net)).over(w))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def statistics(daily: DataFrame, days: int = 252, rf: float = 0.02, keys: tuple[str, ...] = ()) -> DataFrame:
    """Annual return and volatility, Sharpe, Sortino, Calmar, drawdown, win rate, profit to loss, turnover, cost."""
    r = F.col("net")
    s = daily.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max_by("equity", "date").alias("final_equity"), (F.stddev_samp("net") * days**0.5).alias("annual_vol"),
        (F.stddev_samp(F.when(r < 0, r)) * days**0.5).alias("down_vol"), F.min("drawdown").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("win_rate"),
        F.try_divide(F.avg(F.when(r > 0, r)), -F.avg(F.when(r < 0, r))).alias("profit_loss"), F.avg("turnover").alias("mean_turnover"), F.sum("cost").alias("total_cost"),
    )
    s = s.withColumn("annual_return", F.when(F.col("final_equity") > 0, F.pow("final_equity", days / F.col("n")) - 1))
    over = F.col("annual_return") - rf
    return s.withColumns(
        {"sharpe": F.try_divide(over, "annual_vol"), "sortino": F.try_divide(over, "down_vol"), "calmar": F.try_divide("annual_return", F.abs("max_drawdown"))}
    ).drop("down_vol")


def against_benchmark(daily: DataFrame, forward: DataFrame, ticker=None, days: int = 252) -> DataFrame:
    """One row ``alpha, beta, information_ratio`` against the mean of all names, or one ticker."""
    rows = forward if ticker is None else forward.where(F.col("ticker") == ticker)
    both = daily.join(rows.groupBy("date").agg(F.avg("fwd").alias("bench")), "date")
    beta = F.try_divide(F.covar_samp("net", "bench"), F.var_samp("bench"))
    active = F.col("net") - F.col("bench")
    s = both.agg(beta.alias("beta"), F.avg("net").alias("a"), F.avg("bench").alias("b"), F.try_divide(F.avg(active), F.stddev_samp(active)).alias("ir"))
    return s.select(((F.col("a") - F.col("beta") * F.col("b")) * days).alias("alpha"), "beta", (F.col("ir") * days**0.5).alias("information_ratio"))


def monthly_returns(daily: DataFrame) -> DataFrame:
    """``year`` and a compounded return a month, ``m1`` to ``m12``."""
    rows = daily.withColumns({"month": F.month("date"), "year": F.year("date")})
    wide = rows.groupBy("year").pivot("month", list(range(1, 13)))
    out = wide.agg(F.product(1 + F.col("net")) - 1)
    return out.select("year", *(F.col(str(m)).alias(f"m{m}") for m in range(1, 13)))


# ---- rule strategies


def crossover(panel: DataFrame, fast: str | Column, slow: str | Column, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """``position`` 1 from a golden cross (fast rises above slow) to a death cross, else 0; ``ret`` is held with a row's delay."""
    w = Window.partitionBy(*keys).orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    df = panel.withColumns({"_f": fast if isinstance(fast, Column) else F.col(fast), "_s": slow if isinstance(slow, Column) else F.col(slow)})
    above = F.col("_f") > F.col("_s")
    df = df.withColumn("_above", above).withColumn("_before", F.lag("_above").over(w))
    signal = F.when(F.col("_above") & ~F.col("_before"), 1).when(~F.col("_above") & F.col("_before"), -1).otherwise(0)
    df = df.withColumn("signal", signal)
    position = F.coalesce(F.last(F.when(F.col("signal") != 0, (F.col("signal") > 0).cast("int")), ignorenulls=True).over(past), F.lit(0))
    df = df.withColumn("position", position)
    held = F.coalesce(F.lag("position").over(w), F.lit(0))
    ret = F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))
    return df.withColumns({"buy_hold": ret, "ret": held * ret}).drop("_f", "_s", "_above", "_before")


def ma_crossover(panel: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    return crossover(panel, rolling(F.avg, F.col("close"), fast), rolling(F.avg, F.col("close"), slow))


def ma_grid(panel: DataFrame, fast=range(3, 11), slow=(15, 20, 25, 30), days: int = 252) -> DataFrame:
    """``fast, slow, sharpe, mean_ret`` of every pair of windows, over all tickers' mean daily return, best first.

    A pair holds where the fast mean is above the slow one and has been below it
    before (else there was no golden cross), with a row's delay.  All pairs are
    columns of the one pass over a ticker; only their returns, summed up by date in
    the tasks that made them, are a row a pair.
    """
    averages = {n: rolling(F.avg, F.col("close"), n) for n in sorted({*fast, *slow})}
    df = panel.select("date", "ticker", "close", *(c.alias(f"_ma{n}") for n, c in averages.items()))
    pairs = [(a, b) for a in fast for b in slow if a < b]
    above = {(a, b): F.col(f"_ma{a}") > F.col(f"_ma{b}") for a, b in pairs}
    df = df.withColumns({f"_b{a}_{b}": F.max((~c).cast("int")).over(wt_past()) for (a, b), c in above.items()})
    ret = F.coalesce(F.col("close") / F.lag("close").over(wt()) - 1, F.lit(0.0))
    held = {(a, b): F.coalesce(F.lag(c & (F.col(f"_b{a}_{b}") == 1)).over(wt()), F.lit(False)) for (a, b), c in above.items()}
    df = df.select("date", ret.alias("r"), *(h.alias(f"_h{a}_{b}") for (a, b), h in held.items()))
    cells = F.array(*(F.struct(F.lit(a).alias("fast"), F.lit(b).alias("slow"), F.when(F.col(f"_h{a}_{b}"), F.col("r")).otherwise(0.0).alias("ret")) for a, b in pairs))
    daily = df.select("date", F.inline(cells)).groupBy("fast", "slow", "date").agg(F.avg("ret").alias("net"))
    sharpe = F.try_divide(F.avg("net"), F.stddev_samp("net")) * days**0.5
    return daily.groupBy("fast", "slow").agg(sharpe.alias("sharpe"), F.avg("net").alias("mean_ret")).orderBy(F.desc("sharpe"), "fast", "slow")


WARM_UP = 100  # rows that a ticker must have before a rule may act


def _ready(n: int) -> Column:
    return F.row_number().over(wt()) >= n


def bollinger_strategy(panel: DataFrame, n: int = 20, width: float = 2.0, stop: float = 0.05, target: float = 0.10, warm_up: int = WARM_UP) -> DataFrame:
    """Enter when the close crosses the upper band upwards or the lower one downwards; leave at or below the middle, a 5 % loss or a 10 % gain."""
    mid, sd = rolling(F.avg, F.col("close"), n), rolling(F.stddev_pop, F.col("close"), n)
    df = panel.withColumns({"mid": mid, "up": mid + width * sd, "low_band": mid - width * sd, "_ready": _ready(warm_up)})
    before = {c: F.lag(c).over(wt()) for c in ("close", "up", "low_band")}
    crossed = ((F.col("close") > F.col("up")) & (before["close"] <= before["up"])) | ((F.col("close") < F.col("low_band")) & (before["close"] >= before["low_band"]))
    df = df.withColumns({"enters": F.coalesce(crossed & F.col("_ready"), F.lit(False)), "back": F.coalesce((F.col("close") <= F.col("mid")) & F.col("_ready"), F.lit(False))})

    def step(state: Column, row: Column) -> Column:
        entry, close = state["entry"], row["close"]
        leaves = row["back"] | (close <= entry * (1 - stop)) | (close >= entry * (1 + target))
        return F.struct(F.when(entry == 0, F.when(row["enters"], close).otherwise(0.0)).when(leaves, 0.0).otherwise(entry).alias("entry"))

    out = rules.fold(df, ["close", "enters", "back"], F.struct(F.lit(0.0).alias("entry")), step)
    return rules.with_returns(out.withColumn("position", (F.col("state.entry") != 0).cast("int")))


def ma_atr_strategy(
    panel: DataFrame, fast: int = 5, slow: int = 20, atr: int = 14, layers: int = 3, stop: float = 2.0, add: float = 1.0, warm_up: int = WARM_UP
) -> DataFrame:
    """Enter on a golden cross; leave on a death cross or ``stop`` ATR below the first entry; while the fast mean is
    above, add a layer (of ``layers``) at ``add`` ATR above the last one.  ``position`` counts layers."""
    from factorloom.operators.factors import true_range

    df = panel.withColumns({"_tr": true_range(), "_ready": _ready(warm_up)})
    df = df.withColumns({"f": rolling(F.avg, F.col("close"), fast), "s": rolling(F.avg, F.col("close"), slow), "atr": rolling(F.avg, F.col("_tr"), atr)})
    f0, s0 = F.lag("f").over(wt()), F.lag("s").over(wt())
    signals = {"golden": (F.col("f") > F.col("s")) & (f0 <= s0), "death": (F.col("f") < F.col("s")) & (f0 >= s0), "up": F.col("f") > F.col("s")}
    known = F.col("_ready") & F.col("atr").isNotNull()
    df = df.withColumns({k: F.coalesce(c & known, F.lit(False)) for k, c in signals.items()} | {"atr": F.when(known, F.col("atr"))})

    def step(state: Column, row: Column) -> Column:
        n, entry, last, close, a = state["n"], state["entry"], state["last"], row["close"], row["atr"]
        made = lambda k, e, x: F.struct(F.lit(k).cast("int").alias("n") if isinstance(k, int) else k.alias("n"), e.alias("entry"), x.alias("last"))
        flat, zero = made(0, F.lit(0.0), F.lit(0.0)), n == 0
        adds = row["up"] & (n < layers) & F.coalesce(close >= last + a * add, F.lit(False))
        return (
            F.when(zero & row["golden"], made(1, close, close)).when(zero | row["death"], flat).when(adds, made(n + 1, entry, close))
            .when(F.coalesce(close <= entry - a * stop, F.lit(False)), flat).otherwise(state)
        )

    begin = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("entry"), F.lit(0.0).alias("last"))
    out = rules.fold(df, ["close", "golden", "death", "up", "atr"], begin, step)
    return rules.with_returns(out.withColumn("position", F.col("state.n")))


def stochastic(panel: DataFrame, n: int = 9, smooth: int = 3) -> DataFrame:
    """Adds ``k`` and ``d`` of the stochastic oscillator."""
    low, high = rolling(F.min, F.col("low"), n), rolling(F.max, F.col("high"), n)
    df = panel.withColumn("_rsv", F.try_divide(F.col("close") - low, high - low) * 100)
    df = df.withColumn("k", rolling(F.avg, F.col("_rsv"), smooth))
    return df.withColumn("d", rolling(F.avg, F.col("k"), smooth)).drop("_rsv")


def macd_kd_strategy(panel: DataFrame, low: float = 20, high: float = 80, warm_up: int = WARM_UP) -> DataFrame:
    """K crossing ``low`` upwards buys if K and D made a golden cross in the zone below before and MACD is above zero;
    K crossing ``high`` downwards sells if they made a death cross in the zone above and MACD is below zero.

    A cross is forgotten once K is in the opposite zone, or at such a crossing of
    K on MACD's right side.  No flag depends on the position, so flags and
    position are the last event of their kind: windows, no fold.
    """
    from factorloom.operators.factors import with_macd

    df = with_macd(stochastic(panel)).withColumn("_ready", _ready(warm_up))
    k, d, dif = F.col("k"), F.col("d"), F.col("macd")
    k0, d0 = F.lag("k").over(wt()), F.lag("d").over(wt())
    marks = {
        "_arm_buy": (k > d) & (k0 <= d0) & ((k <= low) | (d <= low)), "_arm_sell": (k < d) & (k0 >= d0) & ((k >= high) | (d >= high)),
        "_up": (dif > 0) & (k > low) & (k0 <= low), "_down": (dif < 0) & (k < high) & (k0 >= high), "_over": k >= high, "_under": k <= low,
    }
    df = df.withColumns({name: F.coalesce(c & F.col("_ready"), F.lit(False)) for name, c in marks.items()})
    armed = lambda arm, spent, away: F.last(F.when(F.col(spent) | F.col(away), 0).when(F.col(arm), 1), ignorenulls=True).over(wt_past())
    df = df.withColumns({"_buy_flag": armed("_arm_buy", "_up", "_over"), "_sell_flag": armed("_arm_sell", "_down", "_under")})
    was = lambda flag: F.coalesce(F.lag(flag).over(wt()), F.lit(0)) == 1
    df = df.withColumns({"_buy": F.col("_up") & (F.col("_arm_buy") | was("_buy_flag")), "_sell": F.col("_down") & (F.col("_arm_sell") | was("_sell_flag"))})
    position = F.coalesce(F.last(F.when(F.col("_buy"), 1).when(F.col("_sell"), 0), ignorenulls=True).over(wt_past()), F.lit(0))
    return rules.with_returns(df.withColumn("position", position))


def macd_crossover(panel: DataFrame) -> DataFrame:
    from factorloom.operators.factors import with_macd

    return crossover(with_macd(panel), "macd", "macd_signal")


def cumulative(df: DataFrame) -> DataFrame:
    """Adds compounded ``strategy`` and ``hold`` growth per ticker."""
    return df.withColumns({"strategy": F.product(1 + F.col("ret")).over(wt_past()), "hold": F.product(1 + F.col("buy_hold")).over(wt_past())})
