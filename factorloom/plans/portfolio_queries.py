"""Queries over portfolios, strategies, regimes, signal checks, models and quotes, with their SQL."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from factorloom.functions.windows import near, rolling, wt
from factorloom.operators import factors as fac
from factorloom.operators import labels as lab
from factorloom.operators import models
from factorloom.operators import portfolio as pf
from factorloom.operators import regimes as rg
from factorloom.plans import sql as q
from factorloom.operators.evaluation import analyze, daily_ic, ic_summary
from factorloom.plans.evaluation_queries import _ALL, FACTORS, LEAST, WIDE, pairs, rounded, wide
from factorloom.sources import panel as src
from factorloom.sources.scratch import new_folder, path_of, written
from factorloom.streaming import quotes as st

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---- portfolios

_TOP = f"""{q.PANEL}, sc as (select date, ticker, -({q.change('close', 5)}) as score, st_flag, open from panel),
top as (select date, ticker, score, row_number() over (partition by date order by case when st_flag = 1 then 0 else 1 end desc, score desc nulls last, ticker) as rank from sc qualify rank <= 10)"""


def _scores(spark, d):
    rows = src.panel(spark, d)
    return rows.select("date", "ticker", (-fac.change("close", 5)).alias("score"), F.when(F.col("st_flag") == 1, 0).otherwise(1).alias("tradable_flag"))


@query(q.with_(_TOP, "select date, ticker, rank from top"))
def r1_top_k(spark, d):
    return pf.top_scores(_scores(spark, d), 10).select("date", "ticker", "rank")


_HELD = _TOP + """, dd as (select date, min(date) over (partition by date_trunc('month', date)) as rebalance from (select distinct date from sc)),
held as (select dd.date, t.ticker, 1 / count(*) over (partition by dd.date) as weight from dd join top t on t.date = dd.rebalance)"""


@query(q.with_(_HELD, f"select date, ticker, {q.near('weight')} as weight from held"))
def r2_monthly_holdings(spark, d):
    return rounded(pf.holdings(_scores(spark, d), 10, "monthly"), weight=6)


@query(q.with_(q.BARS, f"select date, ticker, {q.near(f'coalesce(lead(open, 2) over ({q.T}) / lead(open, 1) over ({q.T}) - 1, 0)')} as fwd from bars"))
def r3_open_to_open(spark, d):
    return rounded(pf.open_to_open(src.bars(spark, d)), fwd=6)


@query(q.with_(_TOP, f"select date, ticker, {q.near('exp(score - max(score) over (partition by date)) / sum(exp(score)) over (partition by date) * exp(max(score) over (partition by date))')} as weight from top where score is not null"))
def r4_score_weights(spark, d):
    picked = pf.top_scores(_scores(spark, d), 10).where("score is not null")
    return pf.weights(picked, "score").select("date", "ticker", near("weight").alias("weight"))


_DAILY = _HELD + f""", fw as (select date, ticker, coalesce(lead(open, 2) over ({q.T}) / lead(open, 1) over ({q.T}) - 1, 0) * 0.01 as fwd from panel),
nx as (select date, lead(date) over (order by date) as nd from (select distinct date from held)),
sg as (select date, ticker, weight as w from held union all select nd, ticker, -weight from held join nx using (date) where nd is not null),
tv as (select date, sum(abs(c)) / 2 as turnover from (select date, ticker, sum(w) as c from sg group by all) group by 1),
gr as (select h.date, sum(weight * coalesce(fwd, 0)) as gross from held h left join fw on fw.date = h.date and fw.ticker = h.ticker group by 1),
dy as (select gr.date, gross, turnover, turnover * (2 * 0.0003 + 0.001 + 0.0005) as cost, gross - turnover * (2 * 0.0003 + 0.001 + 0.0005) as net from gr join tv using (date)),
eq as (select *, product(1 + net) over (order by date rows between unbounded preceding and current row) as equity from dy),
perf as (select *, equity / max(equity) over (order by date rows between unbounded preceding and current row) - 1 as drawdown from eq)"""


def _daily(spark, d):
    forward = pf.open_to_open(src.bars(spark, d)).withColumn("fwd", F.col("fwd") * 0.01)  # damped: these bars are no real prices
    return pf.daily_performance(pf.holdings(_scores(spark, d), 10, "monthly"), forward), forward


@query(q.with_(_DAILY, f"select date, {', '.join(q.near(c) + f' as {c}' for c in ('gross', 'turnover', 'cost', 'net', 'drawdown'))}, {q.near('equity', 5)} as equity from perf"))
def r5_r6_daily_performance(spark, d):
    return rounded(_daily(spark, d)[0], gross=6, turnover=6, cost=6, net=6, drawdown=6, equity=5)


@query(
    q.with_(
        _DAILY + ", s as (select count(*) as n, arg_max(equity, date) as final_equity, stddev_samp(net) * sqrt(252) as annual_vol, stddev_samp(case when net < 0 then net end) * sqrt(252) as down_vol, min(drawdown) as max_drawdown, avg(cast(net > 0 as int)) as win_rate, avg(turnover) as mean_turnover, sum(cost) as total_cost from perf), t as (select *, final_equity ** (252 / n) - 1 as annual_return from s)",
        f"select n, {', '.join(q.near(c, 5) + f' as {c}' for c in ('annual_return', 'annual_vol', 'max_drawdown', 'win_rate', 'mean_turnover', 'total_cost'))}, {q.near('(annual_return - 0.02) / annual_vol', 5)} as sharpe, {q.near('(annual_return - 0.02) / down_vol', 5)} as sortino, {q.near('annual_return / abs(max_drawdown)', 5)} as calmar from t",
    )
)
def r7_statistics(spark, d):
    digits = dict.fromkeys(("annual_return", "annual_vol", "max_drawdown", "win_rate", "mean_turnover", "total_cost", "sharpe", "sortino", "calmar"), 5)
    return rounded(pf.statistics(_daily(spark, d)[0]).select("n", *digits), **digits)


@query(
    q.with_(
        _DAILY + ", b as (select date, avg(fwd) as bench from fw group by 1), j as (select net, bench from perf join b using (date)), s as (select covar_samp(net, bench) / var_samp(bench) as beta, avg(net) as a, avg(bench) as m, avg(net - bench) / stddev_samp(net - bench) as ir from j)",
        f"select {q.near('(a - beta * m) * 252', 5)} as alpha, {q.near('beta', 5)} as beta, {q.near('ir * sqrt(252)', 5)} as information_ratio from s",
    )
)
def r8_benchmark(spark, d):
    daily, forward = _daily(spark, d)
    return rounded(pf.against_benchmark(daily, forward), alpha=5, beta=5, information_ratio=5)


@query(q.with_(_DAILY, f"select year(date)::int as year, {', '.join(q.near(f'product(1 + net) filter (month(date) = {m}) - 1', 5) + f' as m{m}' for m in range(1, 13))} from perf group by 1"))
def a7_monthly_returns(spark, d):
    return rounded(pf.monthly_returns(_daily(spark, d)[0]), **{f"m{m}": 5 for m in range(1, 13)})


# ---- strategies

_CROSS = f"""{q.BARS}, ma as (select ticker, date, close, ({q.roll('avg', 'close', 5)}) > ({q.roll('avg', 'close', 20)}) as above from bars),
sg as (select *, case when above and not lag(above) over ({q.T}) then 1 when not above and lag(above) over ({q.T}) then -1 else 0 end as signal from ma),
ps as (select *, coalesce(last_value(case when signal <> 0 then cast(signal > 0 as int) end ignore nulls) over ({q.T} rows between unbounded preceding and current row), 0) as position from sg),
rs as (select *, coalesce(lag(position) over ({q.T}), 0) * coalesce(close / lag(close) over ({q.T}) - 1, 0) as ret from ps)"""


@query(q.with_(_CROSS, f"select ticker, date, signal, position, {q.near('ret')} as ret from rs"))
def r9_ma_crossover(spark, d):
    return pf.ma_crossover(src.bars(spark, d)).select("ticker", "date", "signal", "position", near("ret").alias("ret"))


_HELD_RET = f"coalesce(lag(position) over ({q.T}), 0) * coalesce(close / lag(close) over ({q.T}) - 1, 0)"


@query(
    q.with_(
        f"recursive {q.BARS}, {q.macd()}" + _CROSS[_CROSS.index(", ma as") :].replace(f"({q.roll('avg', 'close', 5)}) > ({q.roll('avg', 'close', 20)})", "macd > macd_signal").replace("from bars)", "from macd)"),
        f"select ticker, date, signal, position, {q.near('ret')} as ret from rs",
    )
)
def r10_macd_crossover(spark, d):
    return pf.macd_crossover(src.bars(spark, d)).select("ticker", "date", "signal", "position", near("ret").alias("ret"))


_READY = "i >= 100"
_BOLL = f"""recursive {q.BARS}, bb as (select *, row_number() over ({q.T}) as i, {q.roll('avg', 'close', 20)} as mid, 2 * {q.roll('stddev_pop', 'close', 20)} as sd from bars),
bx as materialized (select *, coalesce({_READY} and (close > mid + sd and lag(close) over ({q.T}) <= lag(mid + sd) over ({q.T}) or close < mid - sd and lag(close) over ({q.T}) >= lag(mid - sd) over ({q.T})), false) as enters,
  coalesce({_READY} and close <= mid, false) as back from bb),
st as (select ticker, date, i, close, case when enters then close else 0.0 end as entry from bx where i = 1
  union all select b.ticker, b.date, b.i, b.close, case when s.entry = 0 then case when b.enters then b.close else 0.0 end
    when b.back or b.close <= s.entry * (1 - 0.05::double) or b.close >= s.entry * (1 + 0.1::double) then 0.0 else s.entry end
  from st s join bx b on b.ticker = s.ticker and b.i = s.i + 1),
ps as (select *, cast(entry <> 0 as int) as position from st)"""


@query(q.with_(_BOLL, f"select ticker, date, position, {q.near(_HELD_RET)} as ret from ps"))
def r11_bollinger_strategy(spark, d):
    return rounded(pf.bollinger_strategy(src.bars(spark, d)), ret=6)


_LAYERS = f"""recursive {q.BARS}, tr as (select *, row_number() over ({q.T}) as i, greatest(high - low, abs(high - lag(close) over ({q.T})), abs(low - lag(close) over ({q.T}))) as tr from bars),
mm as (select *, {q.roll('avg', 'close', 5)} as f, {q.roll('avg', 'close', 20)} as s, {q.roll('avg', 'tr', 14)} as atr from tr),
mx as materialized (select ticker, date, i, close, case when {_READY} then atr end as a, coalesce({_READY} and f > s and lag(f) over ({q.T}) <= lag(s) over ({q.T}), false) as golden,
  coalesce({_READY} and f < s and lag(f) over ({q.T}) >= lag(s) over ({q.T}), false) as death, coalesce({_READY} and f > s, false) as up from mm),
st as (select ticker, date, i, close, 0 as n, 0.0::double as entry, 0.0::double as last from mx where i = 1
  union all select ticker, date, i, close, case e when 'enter' then 1 when 'out' then 0 when 'add' then n + 1 else n end, case e when 'enter' then close when 'out' then 0.0 else entry end,
    case when e in ('enter', 'add') then close when e = 'out' then 0.0 else last end
  from (select m.*, s.n, s.entry, s.last, case when s.n = 0 and golden then 'enter' when s.n = 0 or death then 'out' when up and s.n < 3 and coalesce(m.close >= s.last + m.a, false) then 'add'
    when coalesce(m.close <= s.entry - 2 * m.a, false) then 'out' end as e from st s join mx m on m.ticker = s.ticker and m.i = s.i + 1)),
ps as (select ticker, date, close, n as position from st)"""


@query(q.with_(_LAYERS, f"select ticker, date, position, {q.near(_HELD_RET)} as ret from ps"))
def r12_ma_atr_strategy(spark, d):
    return rounded(pf.ma_atr_strategy(src.bars(spark, d)), ret=6)


_LOW, _HIGH = q.roll("min", "low", 9), q.roll("max", "high", 9)
_W = f"over ({q.T} rows between unbounded preceding and current row)"
_KD = f"""recursive {q.BARS}, {q.macd()}, rv as (select ticker, date, (close - ({_LOW})) / nullif(({_HIGH}) - ({_LOW}), 0) * 100 as rsv from bars),
kk as (select *, {q.roll('avg', 'rsv', 3)} as k from rv), kd as (select ticker, date, k, {q.roll('avg', 'k', 3)} as d from kk),
kx as (select m.*, k, d, lag(k) over ({q.T}) as k0, lag(d) over ({q.T}) as d0 from macd m join kd using (ticker, date)),
ev as (select *, coalesce({_READY} and k > d and k0 <= d0 and (k <= 20 or d <= 20), false) as arm_b, coalesce({_READY} and k < d and k0 >= d0 and (k >= 80 or d >= 80), false) as arm_s,
  coalesce({_READY} and macd > 0 and k > 20 and k0 <= 20, false) as up, coalesce({_READY} and macd < 0 and k < 80 and k0 >= 80, false) as down,
  coalesce({_READY} and k >= 80, false) as above, coalesce({_READY} and k <= 20, false) as below from kx),
fl as (select *, last_value(case when up or above then 0 when arm_b then 1 end ignore nulls) {_W} as fb, last_value(case when down or below then 0 when arm_s then 1 end ignore nulls) {_W} as fs from ev),
tr as (select *, up and (arm_b or coalesce(lag(fb) over ({q.T}), 0) = 1) as buy, down and (arm_s or coalesce(lag(fs) over ({q.T}), 0) = 1) as sell from fl),
ps as (select ticker, date, close, coalesce(last_value(case when buy then 1 when sell then 0 end ignore nulls) {_W}, 0) as position from tr)"""


@query(q.with_(_KD, f"select ticker, date, position, {q.near(_HELD_RET)} as ret from ps"))
def r13_macd_kd_strategy(spark, d):
    return rounded(pf.macd_kd_strategy(src.bars(spark, d)), ret=6)


_WINDOWS = [*range(3, 11), 15, 20, 25, 30]
_GRID14 = f"""{q.BARS}, mg as (select ticker, date, close, {', '.join(f"{q.roll('avg', 'close', n)} as ma{n}" for n in _WINDOWS)} from bars),
pg as ({' union all '.join(f"select ticker, date, close, {a} as fast, {b} as slow, ma{a} > ma{b} as above from mg" for a in _WINDOWS[:8] for b in _WINDOWS[8:])}),
sg as (select *, case when above and not lag(above) over w then 1 when not above and lag(above) over w then 0 end as cross_ from pg window w as (partition by fast, slow, ticker order by date)),
po as (select *, coalesce(last_value(cross_ ignore nulls) over (partition by fast, slow, ticker order by date rows between unbounded preceding and current row), 0) as position from sg),
rt as (select fast, slow, date, coalesce(lag(position) over w, 0) * coalesce(close / lag(close) over w - 1, 0) as ret from po window w as (partition by fast, slow, ticker order by date)),
dg as (select fast, slow, date, avg(ret) as net from rt group by all)"""


@query(q.with_(_GRID14, f"select fast, slow, {q.near('avg(net) / stddev_samp(net) * sqrt(252)', 5)} as sharpe, {q.near('avg(net)')} as mean_ret from dg group by 1, 2"))
def r14_ma_grid(spark, d):
    return rounded(pf.ma_grid(src.bars(spark, d)), sharpe=5, mean_ret=6)


# ---- regimes and signal checks


def _signal(spark, d):
    rows = fac.staged(src.panel(spark, d)).withColumnRenamed("ret1", "ret")
    raw = F.coalesce(F.col("close") > rolling(F.avg, F.col("close"), 10), F.lit(False)).cast("int")
    return rows.select("date", "ticker", F.col("ret") * 0.01, raw.alias("signal"), (lab.forward_return(1) * 0.01).alias("fwd"), rolling(F.stddev_samp, F.col("ret"), 10).alias("state")).toDF(
        "date", "ticker", "ret", "signal", "fwd", "state"
    )


_SIG = f"""{q.STAGED}, sig as (select date, ticker, ret1 * 0.01 as ret, cast(coalesce(close > ({q.roll('avg', 'close', 10)}), false) as int) as signal,
  (lead(close) over ({q.T}) / close - 1) * 0.01 as fwd, {q.roll('stddev_samp', 'ret1', 10)} as state from staged)"""


@query()
def g1_pca_states(spark, d):
    states, shares = rg.pca_states(rg.phases(wide(spark, d)), FACTORS)
    rows = states.groupBy("phase").agg(F.count("*").alias("n"), *(near(F.var_pop(f"PC{i + 1}"), 3).alias(f"var_{i + 1}") for i in range(len(shares))))
    return rows


def _states(spark, d):
    states, _ = rg.pca_states(rg.phases(wide(spark, d)), FACTORS)
    return states, [c for c in states.columns if c.startswith("PC")]


def _clusters(spark, d, ks=(4, 5, 6)):
    return rg.clusters(*_states(spark, d), ks)


def _selected(spark, d, rows):
    """Clusters chosen over all k; returns are measured against their deviation over all rows."""
    stats = rg.cluster_returns(rows, "r1")
    deviation = wide(spark, d).agg(F.stddev_samp("r1")).first()[0] or 0.0
    return rg.select_clusters(rg.rank_clusters(stats, rg.validate_clusters(stats, deviation)))


@query()
def g2_cluster_returns(spark, d):
    return rounded(rg.cluster_returns(_clusters(spark, d)[0], "r1"), mean_ret=5, std_ret=5, share=6)


@query()
def g3_cluster_quality(spark, d):
    return rounded(_clusters(spark, d)[1], silhouette=4, calinski_harabasz=1)


@query()
def g4_g5_g7_cluster_selection(spark, d):
    return rounded(_selected(spark, d, _clusters(spark, d)[0]).select("k", "cluster", "global_rank", "validated", "mean_ret"), mean_ret=5)


@query()
def g6_best_component(spark, d):
    return rounded(rg.strength_threshold(*_states(spark, d), "r1"), ic=4, threshold=3)


@query()
def g8_held_signal(spark, d):
    states, components = _states(spark, d)
    rows, _ = rg.clusters(states, components, (4, 5, 6))
    raw = rg.regime_signal(rows, _selected(spark, d, rows), rg.strength_threshold(states, components, "r1"), components)
    return rg.held_signal(raw, "raw")


_PERF = _SIG + f""", h as (select *, coalesce(lag(signal) over ({q.T}), 0) as h from sig), f as (select *, abs(h - coalesce(lag(h) over ({q.T}), 0)) as flip from h),
nt as (select *, h * coalesce(ret, 0) - flip * 0.0015 as net from f), e as (select *, product(1 + net) over ({q.T} rows between unbounded preceding and current row) as equity from nt),
dd as (select *, equity / max(equity) over ({q.T} rows between unbounded preceding and current row) - 1 as drawdown from e)"""


@query(q.with_(_PERF, f"select ticker, {q.near('arg_max(equity, date)', 5)} as final_equity, sum(flip)::bigint as flips, cast(floor(sum(flip) / 2) as bigint) as roundtrips, {q.near('(avg(net) - 0.03 / 250) / stddev_pop(net) * sqrt(250)', 5)} as sharpe, {q.near('min(drawdown)', 5)} as max_drawdown, {q.near('avg(case when h = 1 then cast(net > 0 as int) end)', 5)} as win_rate from dd group by 1"))
def g9_signal_performance(spark, d):
    return rounded(rg.signal_performance(_signal(spark, d)), final_equity=5, sharpe=5, max_drawdown=5, win_rate=5)


@query()
def g10_random_baseline(spark, d):
    return rounded(rg.random_baseline(_signal(spark, d)), mean_ret=6, percentile=6)


@query(
    q.with_(
        _SIG + f", k as (select *, lag(signal) over ({q.T}) as x, row_number() over ({q.T}) as i, count(*) over (partition by ticker) as n from sig), g as (select * from k where x is not null and fwd is not null)",
        f"select {q.near('corr(x, fwd)')} as corr, {q.near('avg(case when x > 0 then cast(fwd > 0 as int) end)')} as follow_ratio, {q.near('corr(x, fwd) filter (i * 2 <= n)')} as corr_first, {q.near('corr(x, fwd) filter (i * 2 > n)')} as corr_second from g",
    )
)
def h1_leak_check(spark, d):
    return rounded(rg.leak_check(_signal(spark, d)), corr=6, follow_ratio=6, corr_first=6, corr_second=6)


@query()
def h2_placebo_labels(spark, d):
    return rounded(rg.placebo_labels(_signal(spark, d), "state"), ic=6)


@query(
    q.with_(
        _SIG + f", h as (select *, coalesce(lag(signal) over ({q.T}), 0) as h from sig), f as (select *, abs(h - coalesce(lag(h) over ({q.T}), 0)) as flip from h), t as (select sum(h * coalesce(ret, 0)) as gross, sum(flip)::bigint as trades from f), p as (select unnest([0.0, 0.001, 0.002, 0.003]::double[]) as cost, unnest([0.0, 0.0005, 0.001, 0.002]::double[]) as slippage)",
        f"select cost, slippage, {q.near('gross', 3)} as gross, trades, {q.near('gross - trades * (cost + slippage)', 3)} as net from t, p",
    )
)
def h3_cost_scenarios(spark, d):
    return rounded(rg.cost_scenarios(_signal(spark, d)), gross=3, net=3)


@query(
    q.with_(
        _SIG + ", k as (select * from sig where state is not null and fwd is not null), e as (select quantile_cont(state, [0.2, 0.4, 0.6, 0.8]) as e from k)",
        f"select 1 + len(list_filter(e, lambda v: v <= state)) as bucket, count(*) as n, {q.near('avg(fwd)')} as mean_ret from k, e group by 1",
    )
)
def h4_ranking_power(spark, d):
    return rounded(rg.ranking_power(_signal(spark, d), "state"), mean_ret=6)


@query()
def h4_component_power(spark, d):
    return rounded(rg.component_power(*_states(spark, d), "r1"), ic=4, mean_ret=5)


@query()
def h5_state_filter(spark, d):
    return rounded(rg.state_filter(rg.cluster_returns(_clusters(spark, d, (3, 4, 5))[0], "r1")), train_ret=5, test_ret=5)


_WK = "partition by ticker, phase, p order by date"
_GRID = (
    "recursive " + _SIG + """, nd as (select date, row_number() over (order by date) as i, count(*) over () as n from (select distinct date from sig)),
ph as (select ticker, date, coalesce(state, 0) as x, coalesce(ret, 0) as r, case when i <= floor(nd.n * 0.8) - 5 then 'train' when i > floor(nd.n * 0.8) then 'test' end as phase from sig join nd using (date) where i <= floor(nd.n * 0.8) - 5 or i > floor(nd.n * 0.8)),
ct as (select unnest([0.6, 0.7, 0.8, 0.9]) as p, unnest(quantile_cont(x, [0.6, 0.7, 0.8, 0.9])) as c from ph where phase = 'train'),
og as (select ticker, phase, date, r, p, cast(x >= c as int) as o from ph, ct),
lg as materialized (select *, row_number() over (partition by ticker, phase, p, h order by date) as i from ("""
    + " union all ".join(f"select *, {h} as h, {'o' if h == 1 else f'greatest(o, coalesce(max(o) over ({_WK} rows between {h} preceding and 2 preceding), 0))'} as on_ from og" for h in (1, 3, 5))
    + """)), st as (select ticker, phase, p, h, r, i, on_, case when on_ = 1 then h else 0 end as lft from lg where i = 1
  union all select l.ticker, l.phase, l.p, l.h, l.r, l.i, l.on_, case when s.lft > 1 then s.lft - 1 when l.on_ = 1 then l.h else 0 end
  from st s join lg l on l.ticker = s.ticker and l.phase = s.phase and l.p = s.p and l.h = s.h and l.i = s.i + 1)"""
)


@query(
    q.with_(
        _GRID,
        "select p::double as quantile, h as hold, " + ", ".join(f"{q.near(f"sum(case when phase = '{x}' and lft > 0 then r else 0 end)", 4)} as {x}_return, {q.near(f"avg(case when phase = '{x}' then on_ end)")} as {x}_ratio" for x in ("train", "test"))
        + " from st group by 1, 2",
    )
)
def h6_threshold_grid(spark, d):
    rows = rg.threshold_grid(rg.phases(_signal(spark, d)), "state")
    return rounded(rows, train_return=4, test_return=4, train_ratio=6, test_ratio=6)


@query(q.with_(_SIG + f", h as (select *, coalesce(lag(signal) over ({q.T}), 0) as h from sig)", f"select year(date)::int as year, count(*) as n, {q.near('avg(ret)')} as mean_ret, {q.near('avg(case when h > 0 then ret end)')} as signal_ret, avg(case when h > 0 then ret end) > avg(ret) as better from h group by 1"))
def h7_yearly(spark, d):
    return rounded(rg.yearly(_signal(spark, d)), mean_ret=6, signal_ret=6)


# ---- models


def _train_valid(spark, d, ranks=False):
    rows, label = rg.phases(wide(spark, d), 0.7), "r5"
    if ranks:
        rows, label = lab.rank_labels(rows, "r5", "uniform", LEAST), "rank_label"
    data = models.vectors(rows, FACTORS, label).select("date", "ticker", "phase", "features", "label")
    data = written(data.withColumn("features", vector_to_array("features")), "vectors").withColumn("features", array_to_vector("features"))
    return data.where("phase = 'train'"), data.where("phase = 'test'")


def _model_errors(fit, ranks=False):
    def run(spark, d):
        train, valid = _train_valid(spark, d, ranks)
        return rounded(models.errors(fit(train, valid), {"train": train, "valid": valid}), mse=3, mae=4)

    return run


QUERIES["m1_ridge"] = _model_errors(lambda train, valid: models.ridge(train))
QUERIES["m2_forest"] = _model_errors(lambda train, valid: models.forest(train, 10, 5))
QUERIES["m3_boosted"] = _model_errors(lambda train, valid: models.boosted(train, valid, 10, 3))
QUERIES["m3_boosted_ranks"] = _model_errors(lambda train, valid: models.boosted(train, valid, 10, 3), ranks=True)


@query()
def m4_importances(spark, d):
    train, _ = _train_valid(spark, d)
    return rounded(models.importance_table(spark, models.forest(train, 10, 5), FACTORS), importance=4)


_GR = WIDE + f""", g as (select date, ticker, roc_5d as score, least(floor({q.avg_rank('r5', 'date')} / count(*) over (partition by date) * 5), 4) as grade from wide where r5 is not null),
p as (select date, 2 ** grade - 1 as g, row_number() over (partition by date order by score desc, ticker) as p, row_number() over (partition by date order by grade desc, ticker) as qq from g where score is not null)"""


@query(q.with_(_GR, f"select date, {', '.join(q.near(f'sum(case when p <= {k} then g / log2(1.0 + p) end) / nullif(sum(case when qq <= {k} then g / log2(1.0 + qq) end), 0)', 5) + f' as ndcg_{k}' for k in (10, 30, 50))} from p group by 1"))
def m5_ndcg(spark, d):
    rows = lab.grade_labels(wide(spark, d), "r5").withColumnRenamed("roc_5d", "score")
    return rounded(models.ndcg(rows), ndcg_10=5, ndcg_30=5, ndcg_50=5)


_TASK = _ALL + """, ta as (select s.factor as task, ic_mean as mean_ic, ic_mean / ic_std as icir, ic_mean / ic_std * sqrt(252) as icir_annual, ic_mean / ic_std * sqrt(n) as t_stat, positive_ratio as ic_positive_ratio, spread_mean, spread_mean / spread_std * sqrt(252) as spread_sharpe
  from summary s left join ss on s.factor = ss.factor and s.ret = ss.ret where s.ret = 'r5')"""
_METRICS = ("mean_ic", "icir", "icir_annual", "t_stat", "ic_positive_ratio", "spread_mean", "spread_sharpe")


@query(
    q.with_(
        _TASK,
        " union all ".join(
            f"select task, '{m}' as metric, {q.near(m, 5)} as value, "
            + (f"case when task <> 'roc_5d' then {q.near(f"(abs({m}) - (select abs({m}) from ta where task = 'roc_5d')) / nullif((select abs({m}) from ta where task = 'roc_5d'), 0) * 100", 2)} end" if m in ("mean_ic", "icir") else "null::double") + " as improvement from ta"
            for m in _METRICS
        ),
    )
)
def m6_compare_tasks(spark, d):
    """Three predictions of the five rows' return side by side, the first as the baseline."""
    p = written(pairs(spark, d).where("ret = 'r5'"), "pairs")
    rows = models.task_metrics(analyze(p, least=LEAST, p=False), ic_summary(daily_ic(p, least=LEAST), p=False))
    return rounded(models.compare(rows, "roc_5d").select("task", "metric", "value", "improvement"), value=5, improvement=2)


# ---- quotes

_Q = "quotes as (select event_id, ts, user_id as ticker, value as price, cast(json_extract_string(props, '$.k') as bigint) as size from events)"


@query(q.with_(_Q, "select event_id, ticker, price, size, cast(coalesce(size = 0, true) as int) as suspended from quotes where price is not null"))
def z1_normalized_quotes(spark, d):
    return st.normalize(src.quotes(spark, d)).select("event_id", "ticker", "price", "size", "suspended")


@query(q.with_(_Q + ", l as (select *, row_number() over (partition by ticker order by ts desc, event_id desc) as k from quotes)", "select ticker, ts, event_id, price, size from l where k = 1 and ts >= timestamp '2024-01-30 12:00:00' - interval 720 minute"))
def z2_latest_quotes(spark, d):
    return st.recent(st.latest(src.quotes(spark, d)), "2024-01-30 12:00:00", 720)


@query(q.with_(_Q, "select ticker, date_trunc('day', ts)::timestamp as start, first(price order by ts, event_id) as open, max(price) as high, min(price) as low, last(price order by ts, event_id) as close, sum(size)::bigint as size, count(*) as n from quotes group by 1, 2"))
def z3_daily_bars(spark, d):
    return st.bars(src.quotes(spark, d), "1 day")


@query(q.with_(_Q, "select ticker, date_trunc('minute', ts)::timestamp as start, first(price order by ts, event_id) as open, max(price) as high, min(price) as low, last(price order by ts, event_id) as close, sum(size)::bigint as size, count(*) as n from quotes group by 1, 2"))
def z3_minute_bars(spark, d):
    return st.bars(src.quotes(spark, d), "1 minute")


def _arriving(spark, d, chunk, name):
    """A folder that event files arrive in one after the other, in the order of ``chunk``."""
    rows = written(src.table(spark, d, "events").withColumn("_chunk", chunk), name)
    path = new_folder(spark, name)
    for (k,) in sorted(rows.select("_chunk").distinct().collect()):  # a handful
        rows.where(F.col("_chunk") == k).drop("_chunk").coalesce(1).write.mode("append").parquet(path)
    return path


def _places(spark):
    root = new_folder(spark, "stream")
    return f"{root}/table", f"{root}/checkpoint"


_LATEST = "l as (select *, row_number() over (partition by ticker order by ts desc, event_id desc) as k from quotes)"


@query(q.with_(f"{_Q}, {_LATEST}", "select ticker, ts, event_id, price, size from l where k = 1 and ts >= timestamp '2024-01-30 12:00:00' - interval 720 minute"))
def z2_streamed_latest(spark, d):
    """The latest quotes by a stream in update mode over files that do not come in time order, read back as of a time."""
    stream = st.read_events(spark, _arriving(spark, d, F.col("event_id") % 4, "events-by-turn"))
    return st.recent(st.run_latest(src.quotes_of(stream), *_places(spark)), "2024-01-30 12:00:00", 720)


_ARRIVAL = "ts + case when event_id % 7 = 0 then interval 5 day else interval 0 day end"
_LATE = _Q + f""", ar as (select *, (epoch({_ARRIVAL})::bigint // 432000) as c, date_trunc('day', ts)::timestamp as start from quotes),
mx as (select c, max(ts) as m from ar group by 1), wm as (select c, max(m) over (order by c rows between unbounded preceding and 2 preceding) - interval 1 day as wm from mx),
lt as (select ar.*, coalesce(start + interval 1 day <= wm, false) as late from ar join wm using (c)), fin as (select max(ts) - interval 1 day as f from ar)"""


@query(q.with_(_LATE, "select start, count(*) filter (not late and start + interval 1 day <= f) as in_bars, count(*) filter (late) as too_late from lt, fin group by 1 having in_bars + too_late > 0"))
def z4_late_ticks(spark, d):
    """Ticks by day in bars of a stream with a watermark of a day, and those that came too late; every seventh tick comes five days late."""
    arrival = F.unix_timestamp("ts") + F.when(F.col("event_id") % 7 == 0, 432_000).otherwise(0)
    stream = src.quotes_of(st.read_events(spark, _arriving(spark, d, F.floor(arrival / 432_000), "events-by-arrival")))
    made, late = st.run_bars_and_late(stream, "1 day", "1 day", *_places(spark))
    counts = late.groupBy(F.date_trunc("day", "ts").alias("start")).agg(F.count("*").alias("too_late"))
    return made.groupBy("start").agg(F.sum("n").alias("in_bars")).join(counts, "start", "full").select("start", F.coalesce("in_bars", F.lit(0)).alias("in_bars"), F.coalesce("too_late", F.lit(0)).alias("too_late"))


@query(q.with_(_Q + ", b as (select ticker, date_trunc('day', ts)::timestamp as start, last(price order by ts, event_id) as close from quotes group by 1, 2)", "select ticker, start, close from b"))
def z3_streamed_daily_closes(spark, d):
    """The daily bars by a streaming query over the event files."""
    quotes = src.quotes_of(st.read_events(spark, d, "events.parquet"))
    return st.run_to_parquet(st.bars(quotes, "1 day"), *_places(spark), "complete").select("ticker", "start", "close")


@query()
def z5_live_positions(spark, d):
    """Crossover positions over the stream of daily bars, replayed from the bars of the events."""
    made = written(st.bars(src.quotes(spark, d), "1 day").select("ticker", "start", "close"), "bars")
    stream = spark.readStream.schema("ticker long, start timestamp, close double").parquet(path_of(made))
    return st.run_to_parquet(st.live_crossover(stream), *_places(spark))
