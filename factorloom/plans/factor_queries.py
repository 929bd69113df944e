"""Queries over factors and features, one a family, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions.windows import near
from factorloom.operators import factors as op
from factorloom.plans import sql as q
from factorloom.sources.panel import bars, panel, reports

QUERIES: dict = {}
SQL: dict = {}


def _add(name, make, columns: dict[str, str], ctes: str = q.STAGED, source: str = "staged", digits: int = 6):
    QUERIES[name] = lambda spark, d: _near(make(spark, d), digits)
    body = ", ".join(f"{q.near(e, digits)} as {c}" for c, e in columns.items())
    SQL[name] = q.with_(ctes, f"select ticker, date, {body} from {source}")


def _near(df, digits: int = 6):
    return df.select("ticker", "date", *(near(c, digits).alias(c) for c in df.columns if c not in ("ticker", "date")))


def _family(make):
    return lambda spark, d: op.staged(panel(spark, d)).select("date", "ticker", *(c.alias(n) for n, c in make().items()))


R = q.roll
_add("w1_roc", _family(op.roc), {f"roc_{n}d": q.change("close", n) for n in (5, 10, 20, 60, 120)})
_add("w2_price_to_sma", _family(op.price_to_sma), {f"price_to_sma_{n}d": f"close / ({R('avg', 'close', n)}) - 1" for n in (10, 20, 60)})
_add("w3_momentum_composite", _family(op.momentum_composite), {"momentum_composite_60_5": f"{q.change('close', 60)} - {q.change('close', 5)}"})
_add(
    "w4_rank_momentum", _family(op.rank_momentum),
    {"rank_momentum_20d": f"(close - ({R('min', 'close', 20)})) / (({R('max', 'close', 20)}) - ({R('min', 'close', 20)}) + 1e-8)"},
)
_add("w5_realized_vol", _family(op.realized_volatility), {f"realized_vol_{n}d": R("stddev_samp", "ret1", n) for n in (20, 60)})
_hl, _co = "(ln(high / low) ** 2)", "(ln(close / open) ** 2)"
_gk = R("avg", f"(0.5 * {_hl} - (2 * ln(2) - 1) * {_co})", 20)
_add(
    "w6_w7_range_vol", _family(op.range_volatility),
    {
        "parkinson_vol_20d": f"sqrt(({R('avg', _hl, 20)}) / (4 * ln(2)))",
        "garman_klass_vol_20d": f"case when ({_gk}) >= 0 then sqrt(greatest(({_gk}), 0)) end",
    },
)
_add("w8_return_moments", _family(op.return_moments), {"skewness_20d": R("skewness", "ret1", 20), "kurtosis_20d": R("kurtosis", "ret1", 20)})
_turn = {}
for _n in (5, 20):
    _turn |= {f"turnover_mean_{_n}d": R("avg", "turnover_", _n), f"turnover_std_{_n}d": R("stddev_samp", "turnover_", _n), f"turnover_roc_{_n}d": q.change("turnover_", _n)}
_add("w9_turnover", _family(op.turnover_factors), _turn)
_add(
    "w10_w11_w12_volume_price", _family(op.volume_price),
    {
        "volume_price_corr_20d": f"case when count(ret1) {q.over(20)} = 20 then corr(ret1, volume) {q.over(20)} end",
        "vwap_dev_20d": f"close / (({R('sum', '(close * volume)', 20)}) / ({R('sum', 'volume', 20)})) - 1",
        "amihud_illiq_20d": R("avg", "(abs(ret1) / (amount + 1e-8))", 20),
    },
)
_add("w13_price_range", _family(op.price_range), {f"hl_range_mean_{n}d": R("avg", "((high - low) / close)", n) for n in (5, 20)})
_core = {
    "rev_20d": f"-{q.change('close', 20)}", "rvol_20d": f"-({R('stddev_samp', 'ret1', 20)})", "max_ret_20d": f"-({R('max', 'ret1', 20)})",
    "turnover_20d": f"-({R('avg', 'turnover_', 20)})", "mom_frog_20d": f"{q.change('close', 20)} / (({R('sum', 'abs(ret1)', 20)}) + 1e-8)",
}
_add("w14_core_factors", _family(op.core_factors), _core)
_add("w15_all_factors", lambda spark, d: op.factors(panel(spark, d), ["momentum", "core"]), {
    **{f"roc_{n}d": q.change("close", n) for n in (5, 10, 20, 60, 120)}, **{f"price_to_sma_{n}d": f"close / ({R('avg', 'close', n)}) - 1" for n in (10, 20, 60)},
    "momentum_composite_60_5": f"{q.change('close', 60)} - {q.change('close', 5)}",
    "rank_momentum_20d": f"(close - ({R('min', 'close', 20)})) / (({R('max', 'close', 20)}) - ({R('min', 'close', 20)}) + 1e-8)", **_core,
})
_add(
    "w16_returns_momentum", _family(op.returns_and_momentum),
    {f"return_{n}d": q.change("close", n) for n in (1, 5, 10, 20)} | {f"momentum_{n}d": f"close - lag(close, {n}) over ({q.T})" for n in (3, 5, 10, 20)},
    digits=3,
)
_roll = {}
for _n in (5, 10, 20, 30):
    _lo, _up = f"({R('min', 'close', _n)})", f"({R('max', 'close', _n)})"
    _roll |= {
        f"rolling_mean_{_n}d": R("avg", "close", _n), f"rolling_std_{_n}d": R("stddev_samp", "close", _n),
        f"rolling_median_{_n}d": R("quantile_cont({}, 0.5)", "close", _n),
        f"price_position_{_n}d": f"case when {_up} > {_lo} then 2 * (close - {_lo}) / ({_up} - {_lo}) - 1 end",
    }
_add("w17_rolling_prices", _family(op.rolling_prices), _roll)
_tr = f"{q.STAGED}, tr as (select *, greatest(high - low, abs(high - lag(close) over ({q.T})), abs(low - lag(close) over ({q.T}))) as true_range, coalesce(greatest(close - lag(close) over ({q.T}), 0), 0) as gain, coalesce(greatest(lag(close) over ({q.T}) - close, 0), 0) as loss from staged)"
_up, _down = R("avg", "gain", 14), R("avg", "loss", 14)
_pick = lambda *names: lambda spark, d: op.features(panel(spark, d)).select("date", "ticker", *names)
_add(
    "w18_w19_w22_atr_volatility_rsi", _pick("atr_14", "volatility_5d", "volatility_20d", "rsi_14"),
    {
        "atr_14": R("avg", "true_range", 14), "volatility_5d": R("stddev_samp", "ret1", 5), "volatility_20d": R("stddev_samp", "ret1", 20),
        "rsi_14": f"100 - 100 / (1 + ({_up}) / nullif(({_down}), 0))",
    },
    _tr, "tr",
)
_vol = {"volume_change": q.change("volume")} | {f"volume_ma_{n}d": R("avg", "volume", n) for n in (5, 20)}
_vol |= {f"volume_ratio_{n}d": f"volume / ({R('avg', 'volume', n)})" for n in (5, 20)} | {f"volume_roc_{n}d": q.change("volume", n) for n in (3, 5, 10)}
_add("w20_volume_features", _family(op.volume_features), _vol)
_add(
    "w21_intraday", _family(op.intraday),
    {
        "high_low_ratio": "high / low", "open_close_ratio": "open / close", "body": "abs(close - open) / open",
        "upper_shadow": "(high - greatest(open, close)) / close", "lower_shadow": "(least(open, close) - low) / close", "daily_range": "(high - low) / open",
    },
)
_m, _s = f"({R('avg', 'close', 20)})", f"({R('stddev_samp', 'close', 20)})"
_boll = {
    "bb_middle": _m, "bb_upper": f"{_m} + 2 * {_s}", "bb_lower": f"{_m} - 2 * {_s}", "bb_position": f"(close - ({_m} - 2 * {_s})) / (4 * {_s})",
    "bb_width": f"4 * {_s} / {_m}",
}
_add("w23_bollinger", _family(op.bollinger), _boll)
_add("w24_macd", lambda spark, d: op.macd(bars(spark, d)), {c: c for c in ("macd", "macd_signal", "macd_hist")}, f"recursive {q.BARS}, {q.macd()}", "macd")
_add(
    "w25_shifted_features", lambda spark, d: op.shifted(_family(op.roc)(spark, d), ["roc_5d", "roc_20d"]).select("date", "ticker", "roc_5d", "roc_20d"),
    {f"roc_{n}d": f"lag(roc_{n}d) over ({q.T})" for n in (5, 20)},
    f"{q.STAGED}, f as (select ticker, date, {q.change('close', 5)} as roc_5d, {q.change('close', 20)} as roc_20d from staged)", "f",
)
_w = f"over ({q.T} rows between 10 preceding and 1 preceding)"
_sum = {}
for _c in ("close", "volume"):
    for _k, _e in {"sum": "sum({})", "median": "quantile_cont({}, 0.5)", "mean": "avg({})", "length": "count({})", "std": "stddev_pop({})", "var": "var_pop({})", "rms": "avg({0} * {0})", "max": "max({})", "abs_max": "max(abs({}))", "min": "min({})"}.items():
        _e = f"{_e.format(_c)} {_w}"
        _sum[f"auto_{_c}_{_k}"] = f"case when count({_c}) {_w} = 10 then {f'sqrt({_e})' if _k == 'rms' else f'cast({_e} as double)'} end"
_add("w26_window_summaries", lambda spark, d: op.window_summaries(bars(spark, d)), _sum, q.BARS, "bars", 2)


def w26_largest_variance(spark, d):
    made = op.window_summaries(bars(spark, d))
    found = op.largest_variance(made, [c for c in made.columns if c.startswith("auto_")], 12)
    return found.select("feature", F.format_string("%.6e", "variance").alias("variance"))


QUERIES["w26_largest_variance"] = w26_largest_variance
SQL["w26_largest_variance"] = q.with_(
    f"{q.BARS}, f as (select {', '.join(f'{e} as {c}' for c, e in _sum.items())} from bars), v as ("
    + " union all ".join(f"select '{c}' as feature, var_pop({c}) as variance from f" for c in _sum)
    + ")",
    "select feature, format('{:.6e}', variance) as variance from v order by v.variance desc, feature limit 12",
)


def w27_report_ratios(spark, d):
    df = op.report_ratios(reports(spark, d))
    return df.select("ticker", "report_date", *(near(c).alias(c) for c in df.columns[3:]))


QUERIES["w27_report_ratios"] = w27_report_ratios
_rw = "(partition by ticker order by report_date)"
SQL["w27_report_ratios"] = q.with_(
    q.REPORTS,
    f"""select ticker, report_date, {q.near('net_profit / revenue')} as fin_profit_quality,
  {q.near(f'net_profit / assets - lag(net_profit / assets) over {_rw}')} as fin_roe_change,
  {q.near('avg(net_profit / assets) over (partition by ticker order by report_date rows between 3 preceding and current row)')} as fin_roe_mean_4q,
  {q.near('debt / assets')} as fin_leverage from reports""",
)


def w28_fill_forward(spark, d):
    from factorloom.sources.panel import valuation

    rows = bars(spark, d).select("date", "ticker").join(valuation(spark, d), ["date", "ticker"], "left")
    return op.fill_forward(rows, ["market_cap"], 3).select("date", "ticker", near("market_cap", 2).alias("market_cap"))


QUERIES["w28_fill_forward"] = w28_fill_forward
SQL["w28_fill_forward"] = q.with_(
    f"""{q.PANEL}, v as (select ticker, date, case when (date_diff('day', date '1970-01-05', date) // 7) % 4 = 0 then close * shares_outstanding end as x,
  row_number() over ({q.T}) as n from panel)""",
    f"""select date, ticker, {q.near('case when n - held_n <= 3 then held_x end', 2)} as market_cap from (
  select *, last_value(x ignore nulls) over ({q.T} rows between unbounded preceding and current row) as held_x,
  last_value(case when x is not null then n end ignore nulls) over ({q.T} rows between unbounded preceding and current row) as held_n from v)""",
)
