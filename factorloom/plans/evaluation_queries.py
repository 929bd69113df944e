"""Queries over cross-section cleaning, factor evaluation, splits, selection and drift, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions.tests import p_of_ks
from factorloom.functions.windows import near, wt
from factorloom.operators import cross_section as xs
from factorloom.operators import drift, selection, splits
from factorloom.operators import evaluation as ev
from factorloom.operators import factors as fac
from factorloom.operators import labels as lab
from factorloom.operators.by_date import cleaned_drift, daily_ic_of, quantile_returns_of, scored
from factorloom.plans import sql as q
from factorloom.operators.screening import correlation_matrix, correlations, screen
from factorloom.sources import panel as src
from factorloom.sources.scratch import new_folder, written

QUERIES: dict = {}
SQL: dict = {}

FACTORS = ["roc_5d", "vol_20d", "price_to_sma_10d"]
LEAST = 5


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---- the frames that the queries start from

WIDE = f"""{q.STAGED}, wide as materialized (
  select date, ticker, industry, close, close * shares_outstanding as market_cap, {q.change('close', 5)} as roc_5d,
    {q.roll('stddev_samp', 'ret1', 20)} as vol_20d, close / ({q.roll('avg', 'close', 10)}) - 1 as price_to_sma_10d,
    lead(close, 6) over ({q.T}) / lead(close, 1) over ({q.T}) - 1 as r5, lead(close, 2) over ({q.T}) / lead(close, 1) over ({q.T}) - 1 as r1 from staged)"""
LONG = WIDE + ", long as materialized (" + " union all ".join(f"select date, ticker, industry, market_cap, '{f}' as factor, {f} as value from wide" for f in FACTORS) + ")"
PAIRS = (
    LONG
    + """, rets as (select date, ticker, 'r5' as ret, r5 as y from wide where r5 is not null union all select date, ticker, 'r1', r1 from wide where r1 is not null),
pairs as (select l.date, l.ticker, l.factor, r.ret, l.value as x, r.y from long l join rets r on l.date = r.date and l.ticker = r.ticker where l.value is not null)"""
)
IC = (
    PAIRS
    + f""", ranked as (select *, {q.avg_rank('x', 'date, factor, ret')} as rx, {q.avg_rank('y', 'date, factor, ret')} as ry from pairs),
ic as (select date, factor, ret, corr(rx, ry) as ic, count(*) as n from ranked group by all having count(*) >= {LEAST} and stddev_pop(rx) > 0 and stddev_pop(ry) > 0)"""
)


def wide(spark, d):
    rows = fac.staged(src.panel(spark, d))
    return rows.select(
        "date", "ticker", "industry", "close", (F.col("close") * F.col("shares_outstanding")).alias("market_cap"), fac.change("close", 5).alias("roc_5d"),
        fac.realized_volatility((20,))["realized_vol_20d"].alias("vol_20d"), fac.price_to_sma((10,))["price_to_sma_10d"].alias("price_to_sma_10d"),
        lab.forward_return(5, "close", 1).alias("r5"), lab.forward_return(1, "close", 1).alias("r1"),
    )


def long(spark, d, w=None):
    w = wide(spark, d) if w is None else w
    return w.unpivot(["date", "ticker", "industry", "market_cap"], FACTORS, "factor", "value")


def pairs(spark, d):
    return ev.pairs_of(wide(spark, d), FACTORS, ["r5", "r1"])


def ic(spark, d):
    return ev.daily_ic(pairs(spark, d), least=LEAST)


def rounded(df, **digits):
    return df.select(*(near(c, digits[c]).alias(c) if c in digits else c for c in df.columns))


# ---- cleaning

_CUT = LONG + ", c as (select date, factor, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi, count(value) as n from long group by all)"
_WINS = _CUT + ", wins as (select l.date, l.ticker, l.industry, l.market_cap, l.factor, case when n >= 3 and value is not null then least(greatest(value, lo), hi) else value end as value from long l join c on l.date = c.date and l.factor = c.factor)"
_STD = _WINS + """, st as (select date, factor, avg(value) as m, stddev_samp(value) as s, count(value) as n, min(value) as a, max(value) as b from wins group by all),
std as materialized (select w.date, w.ticker, w.industry, w.market_cap, w.factor, case when n >= 3 then case when s > 0 then (value - m) / s else value * 0 end else value end as value from wins w join st on w.date = st.date and w.factor = st.factor)"""
_NEU = """, ok as (select date, ticker, factor, value, ln(market_cap) as lx, coalesce(industry, '?') as ind from {0} where value is not null and market_cap > 0),
dm as (select date, ticker, factor, value, value - avg(value) over w as dy, lx - avg(lx) over w as dx from ok window w as (partition by date, factor, ind)),
gd as (select date, ticker, factor, value, dx, dy, count(*) over w as n, sum(dx * dx) over w as sxx, sum(dx * dy) over w as sxy from dm window w as (partition by date, factor)),
neu as (select date, ticker, factor, case when n >= 3 then case when sxx > 1e-18 then dy - sxy / sxx * dx else dy end else value end as value from gd
  union all select date, ticker, factor, value from {0} where value is null or market_cap is null or market_cap <= 0)"""


@query(q.with_(_WINS, f"select date, ticker, factor, {q.near('value')} as value from wins"))
def x1_winsorize(spark, d):
    return xs.winsorize(long(spark, d)).select("date", "ticker", "factor", near("value").alias("value"))


@query(q.with_(_STD, f"select date, ticker, factor, {q.near('value', 5)} as value from std"))
def x2_zscore(spark, d):
    return xs.standardize(xs.winsorize(long(spark, d))).select("date", "ticker", "factor", near("value", 5).alias("value"))


@query(
    q.with_(
        LONG + ", st as (select *, count(value) over (partition by date, factor) as n, min(value) over (partition by date, factor) as a, max(value) over (partition by date, factor) as b from long), k as (select * from long where value is not null)",
        f"""select s.date, s.ticker, s.factor, {q.near('case when n >= 3 then case when b > a then (s.value - a) / (b - a) else s.value * 0 + 0.5 end else s.value end', 5)} as minmax,
  {q.near('r.rk', 5)} as rank from st s left join (select date, ticker, factor, case when count(*) over (partition by date, factor) >= 3 then ({q.avg_rank('value', 'date, factor')} - 1) / (count(*) over (partition by date, factor) - 1) else value end as rk from k) r
  on s.date = r.date and s.ticker = r.ticker and s.factor = r.factor""",
    )
)
def x2_minmax_and_rank(spark, d):
    rows = long(spark, d)
    a = xs.standardize(rows, "minmax").select("date", "ticker", "factor", near("value", 5).alias("minmax"))
    b = xs.standardize(rows, "rank").select("date", "ticker", "factor", near("value", 5).alias("rank"))
    return a.join(b, ["date", "ticker", "factor"])


@query(q.with_(LONG + _NEU.format("long"), f"select date, ticker, factor, {q.near('value', 5)} as value from neu"))
def x3_neutralize(spark, d):
    return xs.neutralize(long(spark, d)).select("date", "ticker", "factor", near("value", 5).alias("value"))


@query()
def x3_neutralize_without_constant(spark, d):
    return xs.neutralize(long(spark, d), constant=False).select("date", "ticker", "factor", near("value", 5).alias("value"))


@query(
    q.with_(
        LONG + ", g as (select date, factor, covar_pop(value, market_cap) / nullif(var_pop(market_cap), 0) as slope, avg(value) as my, avg(market_cap) as mx, count(*) as n from long where value is not null and market_cap is not null group by all)",
        f"select l.date, l.ticker, l.factor, {q.near('case when n >= 3 and slope is not null and value is not null then value - my - slope * (market_cap - mx) else value end', 5)} as value from long l left join g on l.date = g.date and l.factor = g.factor",
    )
)
def x4_neutralize_one(spark, d):
    return xs.neutralize_one(long(spark, d), "market_cap").select("date", "ticker", "factor", near("value", 5).alias("value"))


@query(q.with_(_STD + _NEU.format("std"), f"select date, ticker, factor, {q.near('value', 5)} as value from neu"))
def x5_pipeline(spark, d):
    return xs.preprocess(long(spark, d)).select("date", "ticker", "factor", near("value", 5).alias("value"))


# ---- evaluation


@query(q.with_(IC, f"select date, factor, ret, {q.near('ic')} as ic, n from ic"))
def e1_daily_ic(spark, d):
    return rounded(ic(spark, d), ic=6)


@query(q.with_(PAIRS, f"select date, factor, ret, {q.near('corr(x, y)')} as ic, count(*) as n from pairs group by all having count(*) >= {LEAST} and stddev_pop(x) > 0 and stddev_pop(y) > 0"))
def e1_daily_pearson_ic(spark, d):
    return rounded(ev.daily_ic(pairs(spark, d), "pearson", LEAST), ic=6)


_SUM = IC + ", summary as (select factor, ret, avg(ic) as ic_mean, stddev_samp(ic) as ic_std, count(ic) as n, avg(cast(ic > 1e-12 as int)) as positive_ratio from ic group by all)"


@query(
    q.with_(
        _SUM,
        f"""select factor, ret, n, {q.near('ic_mean')} as ic_mean, {q.near('ic_std')} as ic_std, {q.near('positive_ratio')} as positive_ratio, {q.near('ic_mean / ic_std')} as icir,
  {q.near('ic_mean / ic_std * sqrt(252)')} as icir_annual, {q.near('ic_mean / ic_std * sqrt(n)')} as t_stat from summary""",
    )
)
def e2_ic_summary(spark, d):
    rows = ev.ic_summary(ic(spark, d), p=False)
    return rounded(rows, ic_mean=6, ic_std=6, positive_ratio=6, icir=6, icir_annual=6, t_stat=6)


@query(q.with_(_SUM, f"select factor, ret, {q.near(q.p_t('(ic_mean / ic_std * sqrt(n))', '(n - 1)'))} as p_value from summary"))
def e2_ic_p_values(spark, d):
    return rounded(ev.ic_summary(ic(spark, d)).select("factor", "ret", "p_value"), p_value=6)


_EDGES = PAIRS + ", e as (select date, factor, ret, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) as e from pairs group by all having count(*) >= 5), b as (select p.*, 1 + len(list_filter(e.e, lambda v: v <= p.x)) as bucket from pairs p join e on p.date = e.date and p.factor = e.factor and p.ret = e.ret), qr as (select date, factor, ret, bucket, avg(y) as mean_ret, count(*) as n from b group by all)"


def quantiles(spark, d):
    return ev.quantile_returns(pairs(spark, d), 5)


@query(q.with_(_EDGES, f"select date, factor, ret, bucket, {q.near('mean_ret')} as mean_ret, n from qr"))
def e3_quantile_returns(spark, d):
    return rounded(quantiles(spark, d), mean_ret=6)


@query(q.with_(_EDGES, f"select factor, ret, bucket, {q.near('avg(mean_ret)')} as mean_ret, {q.near('stddev_samp(mean_ret)')} as std_ret, count(*) as n_dates from qr group by all"))
def e3_bucket_profile(spark, d):
    return rounded(ev.bucket_profile(quantiles(spark, d)), mean_ret=6, std_ret=6)


@query(q.with_(_EDGES, f"select factor, ret, bucket, date, {q.near('sum(ln(1 + mean_ret)) over (partition by factor, ret, bucket order by date rows between unbounded preceding and current row)', 4)} as log_growth from qr"))
def e4_cumulative_returns(spark, d):
    return rounded(ev.cumulative_returns(quantiles(spark, d)), log_growth=4).select("factor", "ret", "bucket", "date", "log_growth")


_SPREAD = _EDGES + ", sp as (select date, factor, ret, avg(case when bucket = 5 then mean_ret end) - avg(case when bucket = 1 then mean_ret end) as spread from qr group by all)"


@query(q.with_(_SPREAD, f"select factor, ret, {q.near('avg(spread)')} as spread_mean, {q.near('stddev_samp(spread)')} as spread_std, {q.near('avg(cast(spread > 0 as int))')} as positive_ratio, {q.near('avg(spread) / stddev_samp(spread) * sqrt(252)')} as sharpe from sp where spread is not null group by all"))
def e5_spread(spark, d):
    return rounded(ev.spread_summary(ev.spread(quantiles(spark, d), 5)), spread_mean=6, spread_std=6, positive_ratio=6, sharpe=6)


@query(
    q.with_(
        _EDGES + """, m as (select factor, ret, bucket, avg(mean_ret) as m from qr group by all), t as (select a.factor, a.ret, avg(sign(b.m - a.m)) as tau from m a join m b on a.factor = b.factor and a.ret = b.ret and a.bucket < b.bucket group by all),
o as (select date, factor, ret, bool_and(up) as ordered from (select *, mean_ret >= lag(mean_ret) over (partition by date, factor, ret order by bucket) as up from qr) group by all)""",
        f"select t.factor, t.ret, {q.near('any_value(tau)')} as tau, {q.near('avg(cast(ordered as int))')} as ordered_ratio from t join o on t.factor = o.factor and t.ret = o.ret group by t.factor, t.ret",
    )
)
def e6_monotonicity(spark, d):
    return rounded(ev.monotonicity(quantiles(spark, d), p=False), tau=6, ordered_ratio=6).select("factor", "ret", "tau", "ordered_ratio")


@query(q.with_(_EDGES + ", m as (select factor, ret, bucket, avg(mean_ret) as m from qr group by all), t as (select a.factor, a.ret, avg(sign(b.m - a.m)) as tau from m a join m b on a.factor = b.factor and a.ret = b.ret and a.bucket < b.bucket group by all)", f"select factor, ret, {q.near(q.p_kendall('tau'))} as p_value from t"))
def e6_kendall_p(spark, d):
    return rounded(ev.monotonicity(quantiles(spark, d)).select("factor", "ret", "p_value"), p_value=6)


@query(
    q.with_(
        LONG + """, k as (select * from long where value is not null), e as (select date, factor, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) as e from k group by all having count(*) >= 5),
h as (select k.date, k.factor, k.ticker from k join e on k.date = e.date and k.factor = e.factor where 1 + len(list_filter(e.e, lambda v: v <= k.value)) = 5),
n as (select date, factor, row_number() over (partition by factor order by date) as k from (select distinct date, factor from h)),
hn as (select h.*, n.k from h join n on h.date = n.date and h.factor = n.factor)""",
        f"select a.date, a.factor, {q.near('1 - count(b.ticker) / count(*)')} as turnover from hn a left join hn b on a.factor = b.factor and a.ticker = b.ticker and a.k = b.k + 1 where a.k > 1 group by all",
    )
)
def e7_turnover(spark, d):
    return rounded(ev.holdings_turnover(long(spark, d)), turnover=6)


@query(
    q.with_(
        LONG + ", k as (select *, " + ", ".join(f"lag(value, {n}) over (partition by factor, ticker order by date) as l{n}" for n in (1, 5, 10)) + ", count(*) over (partition by factor, ticker) as n from long where value is not null)",
        " union all ".join(f"select factor, {n} as lag, {q.near('avg(c)')} as autocorr from (select factor, ticker, corr(value, l{n}) as c from k where n >= {n + 10} group by all) group by factor" for n in (1, 5, 10)),
    )
)
def e8_autocorrelation(spark, d):
    return rounded(ev.autocorrelation(long(spark, d)), autocorr=6)


_LATER = LONG + ", dd as (select date, row_number() over (order by date) > floor(count(*) over () * 0.8) as later from (select distinct date from long)), lt as (select l.*, later from long l join dd using (date) where value is not null)"
_PSI = _LATER + """, ed as (select factor, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as e from lt where not later group by 1),
bn as (select lt.factor, 1 + len(list_filter(e, lambda v: v < value)) as bin, count(*) filter (not later) as a, count(*) filter (later) as b from lt join ed using (factor) group by all)"""


@query(q.with_(_PSI + ", sh as (select factor, greatest(a / sum(a) over (partition by factor), 1e-4) as p, greatest(b / sum(b) over (partition by factor), 1e-4) as s from bn)", f"select factor, {q.near('sum((s - p) * ln(s / p))')} as psi from sh group by 1"))
def e10_psi(spark, d):
    rows = ev.by_date_share(long(spark, d).withColumnRenamed("value", "x"))
    return rounded(ev.psi(rows, ["factor"]), psi=6)


@query(q.with_(_PSI + ", sh as (select factor, (a + 1) / (sum(a) over (partition by factor) + count(*) over (partition by factor)) as p, (b + 1) / (sum(b) over (partition by factor) + count(*) over (partition by factor)) as s from bn)", f"select factor, {q.near('sum((s - p) * ln(s / p))')} as psi from sh group by 1"))
def d1_psi_smoothed(spark, d):
    rows = ev.by_date_share(long(spark, d).withColumnRenamed("value", "x"))
    return rounded(ev.psi(rows, ["factor"], smooth="add_one"), psi=6)


@query(
    q.with_(
        _LATER + ", cv as (select factor, value, count(*) filter (not later) as a, count(*) filter (later) as b from lt group by all), g as (select factor, abs(sum(a) over w / sum(a) over (partition by factor) - sum(b) over w / sum(b) over (partition by factor)) as dist, a, b from cv window w as (partition by factor order by value rows between unbounded preceding and current row))",
        f"select factor, {q.near('max(dist)')} as ks, sum(a)::bigint as n1, sum(b)::bigint as n2 from g group by 1",
    )
)
def e11_ks(spark, d):
    rows = ev.by_date_share(long(spark, d).withColumnRenamed("value", "x"))
    return rounded(ev.ks(rows, ["factor"], p=False), ks=6)


_DECAY = WIDE + ", hz as (" + " union all ".join(f"select date, ticker, {h} as horizon, lead(close, {h}) over ({q.T}) / close - 1 as y from wide" for h in range(1, 21)) + "), fx as (" + " union all ".join(f"select date, ticker, '{f}' as factor, {f} as x from wide" for f in FACTORS) + f"), p as (select factor, horizon, x, y from hz join fx on hz.date = fx.date and hz.ticker = fx.ticker where x is not null and y is not null), r as (select factor, horizon, {q.avg_rank('x', 'factor, horizon')} as rx, {q.avg_rank('y', 'factor, horizon')} as ry from p)"


@query(q.with_(_DECAY, f"select factor, horizon, {q.near('corr(rx, ry)')} as ic from r group by all"))
def e12_ic_decay(spark, d):
    return rounded(ev.ic_decay(wide(spark, d), FACTORS, 20), ic=6)


@query(q.with_(_DECAY + ", dc as (select factor, horizon, abs(corr(rx, ry)) as a from r group by all)", "select factor, min(case when dc.a < f.a / 2 then horizon end) as half_life from dc join (select factor, a from dc where horizon = 1) f using (factor) group by factor"))
def e12_half_life(spark, d):
    return ev.half_life(ev.ic_decay(wide(spark, d), FACTORS, 20))


_CLEAN = _STD + f""", pairs as (select s.date, s.ticker, s.factor, 'r5' as ret, s.value as x, w.r5 as y from std s join wide w on s.date = w.date and s.ticker = w.ticker where s.value is not null and w.r5 is not null),
ranked as (select *, {q.avg_rank('x', 'date, factor')} as rx, {q.avg_rank('y', 'date, factor')} as ry from pairs),
ic as (select date, factor, corr(rx, ry) as ic from ranked group by all having count(*) >= {LEAST} and stddev_pop(rx) > 0 and stddev_pop(ry) > 0),
sm as (select factor, avg(ic) as ic_mean, avg(ic) / stddev_samp(ic) as icir, count(ic) as n from ic group by 1),
e as (select date, factor, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) as e from pairs group by all having count(*) >= 5),
qr as (select p.date, p.factor, 1 + len(list_filter(e.e, lambda v: v <= p.x)) as bucket, avg(y) as mean_ret from pairs p join e on p.date = e.date and p.factor = e.factor group by all),
sp as (select factor, avg(spread) as spread_mean from (select date, factor, avg(case when bucket = 5 then mean_ret end) - avg(mean_ret) as spread from qr group by all) where spread is not null group by 1),
bm as (select factor, bucket, avg(mean_ret) as m from qr group by all), ta as (select a.factor, avg(sign(b.m - a.m)) as tau from bm a join bm b on a.factor = b.factor and a.bucket < b.bucket group by 1),
dd as (select date, row_number() over (order by date) > floor(count(*) over () * 0.8) as later from (select distinct date from std)), lt as (select s.factor, value, later from std s join dd on s.date = dd.date where value is not null),
ed as (select factor, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as e from lt where not later group by 1),
bn as (select lt.factor, 1 + len(list_filter(e, lambda v: v < value)) as bin, count(*) filter (not later) as a, count(*) filter (later) as b from lt join ed using (factor) group by all),
sh as (select factor, greatest(a / sum(a) over (partition by factor), 1e-4) as p, greatest(b / sum(b) over (partition by factor), 1e-4) as s from bn), ps as (select factor, sum((s - p) * ln(s / p)) as psi from sh group by 1),
cv as (select factor, value, count(*) filter (not later) as a, count(*) filter (later) as b from lt group by all),
g as (select factor, abs(sum(a) over w / sum(a) over (partition by factor) - sum(b) over w / sum(b) over (partition by factor)) as dist, a, b from cv window w as (partition by factor order by value rows between unbounded preceding and current row)),
kk as (select factor, max(dist) as ks, sum(a) as n1, sum(b) as n2 from g group by 1),
al as (select sm.*, spread_mean, tau, psi, ks, {q.p_t('(icir * sqrt(sm.n))', '(sm.n - 1)')} as p, {q.p_kendall('tau')} as tau_p, {q.p_ks('ks', 'n1', 'n2')} as ks_p from sm left join sp using (factor) left join ta using (factor) left join ps using (factor) left join kk using (factor)),
fl as (select *, abs(ic_mean) >= 0.02 and p < 0.05 as ic_s, abs(icir * sqrt(252)) >= 0.5 as ir_s, abs(ic_mean) >= 0.005 and p < 0.1 as ic_e, abs(icir * sqrt(252)) >= 0.15 as ir_e from al),
ca as (select factor, coalesce(ic_s and ir_s or ic_e and ir_e, false) as ok from fl), co as (select abs(corr(roc_5d, vol_20d)) as c01, abs(corr(roc_5d, price_to_sma_10d)) as c02, abs(corr(vol_20d, price_to_sma_10d)) as c12 from wide),
a0 as (select co.*, coalesce((select ok from ca where factor = 'roc_5d'), false) as k0 from co), a1 as (select *, case when k0 then c01 else 0 end as m1 from a0),
a2 as (select *, m1 < 0.8 and coalesce((select ok from ca where factor = 'vol_20d'), false) as k1 from a1), a3 as (select *, greatest(case when k0 then c02 else 0 end, case when k1 then c12 else 0 end) as m2 from a2),
mc as (select 'roc_5d' as factor, 0.0::double as mc union all select 'vol_20d', m1 from a3 union all select 'price_to_sma_10d', m2 from a3),
vd as (select fl.*, mc, ic_s and ir_s and mc < 0.8 as strict, ic_e and ir_e and mc < 0.8 as explore from fl join mc using (factor))"""


@query(
    q.with_(
        _CLEAN,
        f"""select factor, case when ic_mean >= 0 then 'positive' else 'negative' end as direction, {q.near('ic_mean')} as ic_mean, {q.near('icir * sqrt(252)', 5)} as icir_annual, {q.near('p')} as p_value, {q.near('spread_mean')} as spread_mean,
  {q.near('tau')} as tau, {q.near('psi', 5)} as psi, {q.near('ks_p', 5)} as ks_p, {q.near('mc', 5)} as max_correlation, coalesce(spread_mean > 0, true) as pass_spread, case when tau is null then true else tau > 0 and tau_p < 0.05 end as pass_monotonic,
  coalesce(psi < 0.25, false) as pass_psi, coalesce(ks_p > 0.05, false) as pass_ks, mc < 0.8 as pass_correlation, case when strict then 'strict' when explore then 'exploratory' end as tier,
  case when explore then '' else concat_ws(',', case when not ic_e then 'ic' end, case when not ir_e then 'icir' end, case when mc >= 0.8 then 'correlation' end) end as fail_reasons, strict or explore as selected from vd""",
    )
)
def e14_screen(spark, d):
    w = written(wide(spark, d).select("date", *FACTORS, "r5"), "screened")
    scores = written(scored(w, FACTORS, ["r5"], 5, clean=(0.01, 0.99)), "scores")
    buckets = quantile_returns_of(scores)
    later = cleaned_drift(ev.by_date_share(scores))
    quality = ev.ic_summary(daily_ic_of(scores, LEAST)).select("factor", "ic_mean", "icir_annual", "p_value")
    for more in (
        ev.spread_summary(ev.spread(buckets, 5, "top_minus_mean")).select("factor", "spread_mean"), ev.monotonicity(buckets).select("factor", "tau", F.col("p_value").alias("tau_p")),
        later.select("factor", "psi", p_of_ks("ks", "n1", "n2").alias("ks_p")),
    ):
        quality = quality.join(more, "factor", "left")
    out = screen(written(quality, "quality"), correlation_matrix(w, FACTORS), FACTORS)
    kept = ["factor", "direction", "ic_mean", "icir_annual", "p_value", "spread_mean", "tau", "psi", "ks_p", "max_correlation", "pass_spread", "pass_monotonic", "pass_psi", "pass_ks", "pass_correlation", "tier", "fail_reasons", "selected"]
    return rounded(out.select(*kept), ic_mean=6, icir_annual=5, p_value=6, spread_mean=6, tau=6, psi=5, ks_p=5, max_correlation=5)


@query(q.with_(WIDE, f"select {q.near('corr(roc_5d, vol_20d)')} as c_0_1, {q.near('corr(roc_5d, price_to_sma_10d)')} as c_0_2, {q.near('corr(vol_20d, price_to_sma_10d)')} as c_1_2 from wide"))
def e15_correlations(spark, d):
    at = lambda c: F.array_position(F.array(*map(F.lit, FACTORS)), F.col(c)) - 1
    rows = correlations(wide(spark, d), FACTORS).withColumn("pair", F.concat(F.lit("c_"), at("a"), F.lit("_"), at("b")))
    return rows.groupBy().pivot("pair", ["c_0_1", "c_0_2", "c_1_2"]).agg(near(F.first("corr")))


@query(
    q.with_(
        WIDE + f", c as (select date, ticker, list_avg(list_filter([roc_5d, price_to_sma_10d], lambda v: v is not null)) as x, r5 as y from wide), k as (select * from c where x is not null and y is not null), r as (select date, {q.avg_rank('x', 'date')} as rx, {q.avg_rank('y', 'date')} as ry from k), ic as (select date, corr(rx, ry) as ic from r group by 1 having count(*) >= {LEAST} and stddev_pop(rx) > 0 and stddev_pop(ry) > 0)",
        f"select count(*) as n, {q.near('avg(ic)')} as ic_mean, {q.near('avg(ic) / stddev_pop(ic)')} as icir from ic",
    )
)
def e16_combined_factor(spark, d):
    w = wide(spark, d)
    rows = ev.daily_ic(ev.paired(ev.combined(w, ["roc_5d", "price_to_sma_10d"]), w.unpivot(["date", "ticker"], ["r5"], "ret", "value")), least=LEAST)
    return rows.agg(F.count("*").alias("n"), near(F.avg("ic")).alias("ic_mean"), near(F.avg("ic") / F.stddev_pop("ic")).alias("icir"))


@query(
    q.with_(
        WIDE + f", k as (select roc_5d as z, r5 as y from wide where roc_5d is not null and r5 is not null), r as (select *, {q.avg_rank('y', '1')} as ry, {q.avg_rank('z', '1')} as rz from k)",
        f"select {q.near('avg((y - z) ** 2)', 4)} as mse, {q.near('avg(abs(y - z))', 5)} as mae, {q.near('sqrt(avg((y - z) ** 2))', 5)} as rmse, {q.near('1 - avg((y - z) ** 2) / var_pop(y)', 5)} as r2, {q.near('corr(y, z)')} as ic, {q.near('corr(ry, rz)')} as rank_ic, count(*) as n from r",
    )
)
def e18_prediction_metrics(spark, d):
    rows = ev.prediction_metrics(wide(spark, d), "r5", "roc_5d")
    return rounded(rows, mse=4, mae=5, rmse=5, r2=5, ic=6, rank_ic=6)


@query(
    q.with_(
        WIDE + ", k as (select date, ticker, roc_5d as x, r5 as y from wide where roc_5d is not null and r5 is not null), e as (select date, min(x) as least, list_distinct(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) as e from k group by 1 having count(*) >= 5), b as (select k.*, 1 + len(list_filter(e, lambda v: v < x and v > least)) as bucket from k join e using (date))",
        f"select bucket, count(*) as n, {q.near('avg(y)')} as mean_ret, {q.near('stddev_samp(y)')} as std_ret from b group by 1",
    )
)
def b1_b2_bucket_performance(spark, d):
    rows = wide(spark, d).select("date", "ticker", F.col("roc_5d").alias("x"), F.col("r5").alias("y")).where("x is not null and y is not null")
    return rounded(ev.bucket_performance(ev.with_buckets(rows, 5, closed="right", keys=["date"])), mean_ret=6, std_ret=6)


@query(q.with_(_SUM, f"select case when factor = 'vol_20d' then 'volatility' else 'momentum' end as family, count(*) as n, {q.near('avg(ic_mean)')} as mean_ic, {q.near('avg(ic_mean / ic_std)')} as mean_icir, {q.near('stddev_samp(ic_mean)')} as std_ic from summary group by 1"))
def a5_family_summary(spark, d):
    registry = spark.createDataFrame([(f, "volatility" if f == "vol_20d" else "momentum") for f in FACTORS], "factor string, family string")
    return rounded(ev.family_summary(ev.ic_summary(ic(spark, d), p=False), registry), mean_ic=6, mean_icir=6, std_ic=6)


@query(q.with_(IC, f"select factor, ret, month(date)::int as month, {', '.join(q.near(f'avg(case when year(date) = {y} then ic end)') + f' as y{y}' for y in range(1995, 2002))} from ic group by all"))
def a6_monthly_ic(spark, d):
    rows = ev.monthly_ic(ic(spark, d))
    return rows.select("factor", "ret", "month", *(near(str(y) if str(y) in rows.columns else F.lit(None).cast("double")).alias(f"y{y}") for y in range(1995, 2002)))


_ALL = _SUM + """, e as (select date, factor, ret, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) as e from pairs group by all having count(*) >= 5), b as (select p.*, 1 + len(list_filter(e.e, lambda v: v <= p.x)) as bucket from pairs p join e on p.date = e.date and p.factor = e.factor and p.ret = e.ret), qr as (select date, factor, ret, bucket, avg(y) as mean_ret from b group by all),
sp as (select date, factor, ret, avg(case when bucket = 5 then mean_ret end) - avg(case when bucket = 1 then mean_ret end) as spread from qr group by all),
ss as (select factor, ret, avg(spread) as spread_mean, stddev_samp(spread) as spread_std from sp where spread is not null group by all),
m as (select factor, ret, bucket, avg(mean_ret) as m from qr group by all), t as (select a.factor, a.ret, avg(sign(b.m - a.m)) as tau from m a join m b on a.factor = b.factor and a.ret = b.ret and a.bucket < b.bucket group by all)"""


@query(q.with_(_ALL, f"select s.factor, s.ret, n, {q.near('ic_mean')} as ic_mean, {q.near('ic_mean / ic_std')} as icir, {q.near('spread_mean')} as spread_mean, {q.near('spread_mean / spread_std * sqrt(252)')} as sharpe, {q.near('tau')} as tau from summary s left join ss on s.factor = ss.factor and s.ret = ss.ret left join t on s.factor = t.factor and s.ret = t.ret"))
def e9_full_analysis(spark, d):
    rows = ev.analyze(pairs(spark, d), least=LEAST, p=False)
    return rounded(rows.select("factor", "ret", "n", "ic_mean", "icir", "spread_mean", "sharpe", "tau"), ic_mean=6, icir=6, spread_mean=6, sharpe=6, tau=6)


_Q13 = _SUM + f", pv as (select *, ic_mean / ic_std as icir, {q.p_t('(ic_mean / ic_std * sqrt(n))', '(n - 1)')} as p from summary)"


@query(q.with_(_Q13, f"select factor, ret, n, {q.near('icir')} as icir, {q.near('icir * sqrt(n)')} as t_stat, {q.near('p')} as p_value, coalesce(icir > 0.5 and p < 0.05, false) as qualified from pv"))
def e13_evaluate_all(spark, d):
    """All factors and returns with the bounds of the qualification as they are."""
    rows = ev.qualified(ev.analyze(pairs(spark, d), least=LEAST))
    return rounded(rows.select("factor", "ret", "n", "icir", "t_stat", "p_value", "qualified"), icir=6, t_stat=6, p_value=6)


@query(q.with_(_Q13, f"select factor, ret, {q.near('icir')} as icir from pv where icir > 0.1 and p < 0.05 order by icir desc, factor, ret limit 3"))
def e13_qualified(spark, d):
    """The three best of those that qualify at a lower ICIR."""
    return rounded(ev.qualified(ev.analyze(pairs(spark, d), least=LEAST), 0.1, 0.05, 3).select("factor", "ret", "icir"), icir=6)


@query(
    q.with_(
        IC + """, hv as (select factor, avg(case when year(date) < 1996 then ic end) as a, avg(case when year(date) >= 1996 then ic end) as b from ic where ret = 'r5' group by 1),
st as (select 1 as as_of, factor, 1::bigint as versions, a as m from hv where a is not null union all select 2, factor, 2::bigint, b from hv where a is not null union all select 3, factor, 2::bigint, b from hv where a is not null and factor <> 'vol_20d')""",
        f"select as_of, factor, versions, {q.near('m')} as ic_mean from st",
    )
)
def e17_factor_library(spark, d):
    """A written library: every factor added by its IC up to 1995, updated with the IC since, one removed; read as of each version."""
    rows = written(ic(spark, d).where("ret = 'r5'"), "ic")
    quality = lambda part: part.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), (F.avg("ic") / F.stddev_samp("ic")).alias("icir"))
    root = new_folder(spark, "library")
    early = quality(rows.where(F.year("date") < 1996)).withColumn("passed", F.lit(True))
    ev.add_to_library(early, root)
    ev.add_to_library(early, root)  # nothing new: no version
    ev.update_library(quality(rows.where(F.year("date") >= 1996)), root)
    ev.remove_from_library(spark.createDataFrame([("vol_20d",)], "factor string"), root)
    reports = [ev.library_report(ev.library_at(spark, root, v)).select(F.lit(v).alias("as_of"), "factor", "versions", "ic_mean") for v in (1, 2, 3)]
    return rounded(reports[0].unionByName(reports[1]).unionByName(reports[2]), ic_mean=6)


@query(q.with_(WIDE + f", k as (select date, roc_5d as x, r5 as y from wide where roc_5d is not null and r5 is not null), r as (select date, {q.avg_rank('x', 'date')} as rx, {q.avg_rank('y', 'date')} as ry from k)", f"select date, {q.near('corr(rx, ry)')} as ic, count(*) as n from r group by 1 having count(*) >= 3 and stddev_pop(rx) > 0 and stddev_pop(ry) > 0"))
def e19_prediction_ic(spark, d):
    """Rank IC by date of a prediction (here the last five rows' return) with three names or more."""
    rows = wide(spark, d).select("date", F.col("roc_5d").alias("x"), F.col("r5").alias("y")).where("x is not null and y is not null")
    return rounded(ev.daily_ic(rows, "spearman", 3, ["date"]), ic=6)


_CUTS = "list_distinct(quantile_cont(r5, [0, 0.25, 0.5, 0.75])) as e, min(r5) as a, max(r5) as b, count(r5) as n"


@query(
    q.with_(
        WIDE + f", g as (select {_CUTS} from wide), dt as (select date, {_CUTS} from wide group by 1)",
        "select w.date, w.ticker, " + ", ".join(f"case when r5 is not null and {t}.a < {t}.b{least} then greatest(len(list_filter({t}.e, lambda v: v < r5)) - 1, 0) end::int as {name}" for t, name, least in (("dt", "by_date", " and dt.n >= 4"), ("g", "over_all", "")))
        + " from wide w left join dt on w.date = dt.date, g",
    )
)
def t8_quantile_labels(spark, d):
    rows = lab.quantile_labels(wide(spark, d).select("date", "ticker", "r5"), "r5", 4).withColumnRenamed("label", "by_date")
    return lab.quantile_labels(rows, "r5", 4, per_date=False).select("date", "ticker", "by_date", F.col("label").alias("over_all"))


@query(q.with_(f"{q.BARS}, fw as (select date, ticker, lead(close) over ({q.T}) / close - 1 as f1, lead(close, 5) over ({q.T}) / close - 1 as f5 from bars)", f"select date, ticker, {q.near('case when count(f1) over (partition by date) >= 10 then f1 - avg(f1) over (partition by date) else f1 end', 5)} as fwd_1, {q.near('case when count(f5) over (partition by date) >= 10 then f5 - avg(f5) over (partition by date) else f5 end', 5)} as fwd_5 from fw"))
def t9_transformed_returns(spark, d):
    rows = lab.forward_returns_with(src.bars(spark, d), (1, 5), "demeaned")
    return rounded(rows.select("date", "ticker", "fwd_1", "fwd_5"), fwd_1=5, fwd_5=5)


@query(q.with_(f"{q.BARS}, lb as (select cast(lead(close) over ({q.T}) / close - 1 > 0 as int) as label from bars)", f"select label, count(*) as n, {q.near('count(*) / sum(count(*)) over ()')} as share from lb group by 1"))
def a4_label_counts(spark, d):
    rows = src.bars(spark, d).withColumn("r", lab.forward_return(1)).withColumn("label", lab.binary_label("r"))
    return rounded(lab.label_counts(rows, "label"), share=6)


# ---- splits


@query(
    q.with_(
        f"{q.BARS}, dd as (select date, row_number() over (order by date) as i, count(*) over () as n from (select distinct date from bars)), s as (select date, case when i <= floor(n * 0.6) - 5 then 'train' when i > floor(n * 0.6) + 2 and i <= floor(n * 0.8) - 5 then 'valid' when i > floor(n * 0.8) + 2 then 'test' end as split from dd)",
        "select split, count(*) as n, min(date) as first_date, max(date) as last_date from bars join s using (date) where split is not null group by 1",
    )
)
def p1_single_split(spark, d):
    rows = splits.single_split(src.bars(spark, d), 0.6, 0.2, purge=5, embargo=2)
    return rows.where("split is not null").groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(
    q.with_(
        f"""{q.BARS}, dd as (select date, row_number() over (order by date) as i, count(*) over () as n from (select distinct date from bars)),
f as (select k, 100 + k * ((n - 100) // 4) as cut, (n - 100) // 4 as step from (select distinct n from dd), (select unnest([0, 1, 2, 3]) as k)),
s as (select k as fold, date, case when i <= cut - 5 then 'train' when i > cut + 2 and i <= cut + step then 'test' end as split from dd, f)""",
        "select fold, split, count(*) as n, min(date) as first_date, max(date) as last_date from bars join s using (date) where split is not null group by all",
    )
)
def p2_walk_forward(spark, d):
    rows = splits.walk_forward(src.bars(spark, d), 4, 100, purge=5, embargo=2)
    return rows.groupBy("fold", "split").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


_SHARED = f"""{q.BARS}, dd as (select date, row_number() over (order by date) as i, count(*) over () as n from (select distinct date from bars)),
s0 as (select date, i, case when i <= floor(n * 0.6) - 5 then 'train' when i > floor(n * 0.6) + 2 and i <= floor(n * 0.8) - 5 then 'valid' when i > floor(n * 0.8) + 2 then 'test' end as split from dd),
s1 as (select date, i, split from s0 where split is not null), s2 as (select * from s1 union select date, i, 'valid' from s1 where i % 100 = 0),
gp as (select a - lag(b) over (order by a) as g from (select split, min(i) as a, max(i) as b from {{}} group by 1))"""


@query(
    " union all ".join(
        f"select '{name}' as rows, * from (with {_SHARED.format(t)} select (select count(*) from (select date from {t} group by 1 having count(distinct split) > 1)) as shared_dates, (select coalesce(min(g) > 5, true) from gp) as gap_ok)"
        for name, t in (("split", "s1"), ("planted", "s2"))
    )
)
def p3_leakage(spark, d):
    """The check of a clean split, and of one where every hundredth date is in the validation part as well."""
    clean = written(splits.single_split(src.bars(spark, d), 0.6, 0.2, purge=5, embargo=2), "split").where("split is not null").select("date", "split")
    i = splits.numbered_dates(src.bars(spark, d))
    planted = clean.unionByName(clean.join(F.broadcast(i.where("i % 100 = 0").select("date")), "date").withColumn("split", F.lit("valid")))
    parts = [splits.leakage(rows, 5, i).withColumn("rows", F.lit(name)) for name, rows in (("split", clean), ("planted", planted))]
    return parts[0].unionByName(parts[1])


@query(
    q.with_(
        f"{q.BARS}, dd as (select date, row_number() over (order by date) as i, count(*) over () as n from (select distinct date from bars)), s as (select date, case when i <= floor(n * 0.7) - 10 then 'train' when i > floor(n * 0.7) and i <= floor(n * 0.85) - 10 then 'valid' when i > floor(n * 0.85) then 'test' end as split from dd)",
        "select split, count(*) as n, min(date) as first_date, max(date) as last_date from bars join s using (date) where split is not null group by 1",
    )
)
def p4_split_by_position(spark, d):
    rows = splits.by_position(src.bars(spark, d), purge=10)
    return rows.where("split is not null").groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# ---- selection


_CLEANED = {"roc_5d": "roc_5d", "vol_20d": "coalesce(vol_20d, 0)", "close_std": "close", "close_var": "close * close", "close_sum": "10 * close", "level": "1e12 * close", "flat": "3.0", "odd_var": "close"}


@query(
    q.with_(
        WIDE + ", k as (select " + ", ".join(f"{e}::double as {c}" for c, e in _CLEANED.items()) + f" from wide), p as (select feature, x from k unpivot include nulls (x for feature in ({', '.join(_CLEANED)})))",
        f"""select feature, {q.near('stddev_samp(x)', 2)} as std, case when count(x) < count(*) then 'non-finite' when stddev_samp(x) < 1e-10 then 'constant' when abs(avg(x)) > 1e10 or stddev_samp(x) > 1e10 then 'magnitude' when feature like '%\\_sum' escape '\\' then 'window sum'
  when feature = 'close_var' then 'variance beside deviation' when abs(skewness(x)) > 15 or abs(kurtosis(x)) > 200 then 'shape' end as reason from p where feature <> 'level' group by 1
union all select 'level', null, 'magnitude'""",
    )
)
def k1_clean_features(spark, d):
    rows = wide(spark, d).select(*(F.expr(e).cast("double").alias(c) for c, e in _CLEANED.items()))
    out = selection.unusable(rows, list(_CLEANED))
    return out.select("feature", F.when(F.col("feature") != "level", near("std", 2)).alias("std"), "reason")


@query(q.with_(WIDE, " union all ".join(f"select '{f}' as feature, {q.near(f'var_pop(coalesce({f}, 0))', 5)} as variance from wide having var_pop(coalesce({f}, 0)) > 0.01" for f in FACTORS)))
def k2_variance_filter(spark, d):
    return rounded(selection.varying(wide(spark, d), FACTORS, 0.01), variance=5)


@query()
def k3_correlation_filter(spark, d):
    kept = selection.uncorrelated(wide(spark, d), FACTORS, 0.95)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query()
def k4_importances(spark, d):
    """Features by the sum of their normalized forest importances for the next row's and the next five rows' return."""
    found = selection.importances(wide(spark, d), FACTORS, ["r1", "r5"], len(FACTORS))
    return rounded(spark.createDataFrame(found, "feature string, importance double"), importance=6)


_TRAIN = WIDE + ", dd as (select date, row_number() over (order by date) <= floor(count(*) over () * 0.8) as train from (select distinct date from wide)), st as (select " + ", ".join(f"quantile_cont({f}, 0.25) as a_{f}, quantile_cont({f}, 0.5) as m_{f}, quantile_cont({f}, 0.75) as b_{f}" for f in FACTORS) + " from wide join dd using (date) where train)"


@query(q.with_(_TRAIN, f"select date, ticker, {', '.join(q.near(f'({f} - m_{f}) / nullif(b_{f} - a_{f}, 0)', 5) + f' as {f}' for f in FACTORS)} from wide, st"))
def k5_robust_scaling(spark, d):
    rows = selection.scale(wide(spark, d).select("date", "ticker", *FACTORS), FACTORS, "robust")
    return rounded(rows, **{f: 5 for f in FACTORS})


# ---- drift


_PARTS = "(select date, case when i <= floor(n * 0.6) then 'train' when i <= floor(n * 0.8) then 'valid' else 'test' end as split from (select date, row_number() over (order by date) as i, count(*) over () as n from (select distinct date from {0})))"


def _changes(rows: str, x: str, metrics: dict[str, str]) -> str:
    """``cg``: factor, ret, metric, the value of each split and the changes relative to the training part."""
    each = " union all ".join(f"select factor, ret, '{m}' as metric, split, {e.format(x)} as v from {rows} group by all" for m, e in metrics.items())
    base = "nullif(abs(train), 0)"
    return f"""mv as ({each}), pv as (select factor, ret, metric, {', '.join(f"max(v) filter (split = '{s}') as {s}" for s in ('train', 'valid', 'test'))} from mv group by all),
cg as (select *, abs(valid - train) / {base} as valid_vs_train, abs(test - train) / {base} as test_vs_train, abs(valid - test) / {base} as valid_vs_test from pv)"""


_IC_METRICS = {"mean": "avg({0})", "std": "stddev_samp({0})", "icir": "avg({0}) / stddev_samp({0})", "icir_annual": "avg({0}) / stddev_samp({0}) * sqrt(252)", "positive_ratio": "avg(cast({0} > 1e-12 as int))"}
_SP_METRICS = {"mean": "avg({0})", "sharpe": "avg({0}) / stddev_samp({0})", "positive_ratio": "avg(cast({0} > 0 as int))"}
_IC_SPLIT = IC + ", isp as (select ic.*, split from ic join " + _PARTS.format("ic") + " using (date))"
_SD = ", sd as (select * from sp where spread is not null), ssp as (select sd.*, split from sd join " + _PARTS.format("sd") + " using (date))"
_COMPARED = ("train", "valid", "test", "valid_vs_train", "test_vs_train", "valid_vs_test")
_COMPARED_SQL = "select factor, ret, metric, " + ", ".join(f"{q.near(c, 4)} as {c}" for c in _COMPARED) + ", valid_vs_test > 0.5 as drifted from cg"


@query(q.with_(_IC_SPLIT + ", " + _changes("isp", "ic", _IC_METRICS), _COMPARED_SQL))
def d3_ic_drift(spark, d):
    return rounded(drift.compare_ic(drift.with_split(ic(spark, d)), ["factor", "ret"]), **dict.fromkeys(_COMPARED, 4))


def _tests(rows: str, later: str) -> str:
    """``ts``: the statistics of the three tests of ``ic`` by ``later`` over the rows of ``rows``; ties are told to nine digits."""
    return f"""tx as (select factor, ret, {q.near('ic', 9)} as x, {later} as later from {rows}),
tr as (select *, rank() over w + (count(*) over (partition by factor, ret, x) - 1) / 2.0 as r, count(*) over (partition by factor, ret, x) as t from tx window w as (partition by factor, ret order by x)),
tm as (select factor, ret, count(*) filter (not later)::double as n1, count(*) filter (later)::double as n2, avg(x) filter (not later) as m1, avg(x) filter (later) as m2, var_samp(x) filter (not later) as v1, var_samp(x) filter (later) as v2,
  sum(r) filter (not later) as r1, sum(t * t - 1)::double as ties from tr group by all),
td as (select factor, ret, max(abs(f1 - f2)) as ks from (select factor, ret, x, count(*) filter (not later) over w / (count(*) filter (not later) over (partition by factor, ret))::double as f1, count(*) filter (later) over w / (count(*) filter (later) over (partition by factor, ret))::double as f2
  from tr window w as (partition by factor, ret order by x range between unbounded preceding and current row)) group by all),
ts as (select *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) as t_stat, r1 - n1 * (n1 + 1) / 2 as u_stat,
  greatest((abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) as z_stat from tm join td using (factor, ret) where n1 >= 5 and n2 >= 5)"""


_TESTED = ("t_stat", "u_stat", "z_stat", "ks", "p_t", "p_mann_whitney", "p_ks")


@query(
    q.with_(
        _IC_SPLIT + ", tt as (select * from isp where split <> 'valid'), " + _tests("tt", "split = 'test'"),
        f"select factor, ret, n1::bigint as n1, n2::bigint as n2, {', '.join(f'{q.near(c, 5)} as {c}' for c in _TESTED[:4])}, {q.near(q.p_t('t_stat', '(n1 + n2 - 2)'), 5)} as p_t, {q.near(q.p_normal('z_stat'), 5)} as p_mann_whitney, {q.near(q.p_ks('ks', 'n1', 'n2'), 5)} as p_ks from ts",
    )
)
def d5_ic_tests(spark, d):
    rows = drift.with_split(ic(spark, d)).where("split in ('train', 'test')").withColumn("later", F.col("split") == "test")
    return rounded(drift.compare_series(rows.withColumn("x", near("ic", 9)), ["factor", "ret"]), **dict.fromkeys(_TESTED, 5))


@query(
    q.with_(
        LONG + ", ls as (select l.*, split from long l join " + _PARTS.format("long") + """ using (date) where value is not null), ed as (select factor, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as e from ls where split = 'train' group by 1),
bn as (select ls.factor, 1 + len(list_filter(e, lambda v: v < value)) as bin, split from ls join ed using (factor))"""
        + "".join(f", c_{s} as (select factor, bin, count(*) filter (split = 'train') as a, count(*) filter (split = '{s}') as b from bn where split in ('train', '{s}') group by all), s_{s} as (select factor, (a + 1) / (sum(a) over w + count(*) over w) as p, (b + 1) / (sum(b) over w + count(*) over w) as q from c_{s} window w as (partition by factor)), r_{s} as (select factor, sum((q - p) * ln(q / p)) as psi from s_{s} group by 1)" for s in ("valid", "test")),
        f"select v.factor, {q.near('v.psi', 5)} as psi_valid, {q.near('t.psi', 5)} as psi_test, greatest(v.psi, t.psi) > 0.2 as drifted from r_valid v join r_test t using (factor)",
    )
)
def d2_feature_drift(spark, d):
    rows = drift.with_split(long(spark, d))
    return rounded(drift.feature_drift(rows), psi_valid=5, psi_test=5)


@query(q.with_(_SPREAD + _SD + ", " + _changes("ssp", "spread", _SP_METRICS), _COMPARED_SQL))
def d4_spread_drift(spark, d):
    rows = drift.with_split(ev.spread(quantiles(spark, d), 5))
    return rounded(drift.compare_spreads(rows, ["factor", "ret"]), **dict.fromkeys(_COMPARED, 4))


@query(
    q.with_(
        _IC_SPLIT + _SPREAD[len(PAIRS):] + _SD + ", " + _changes("isp", "ic", _IC_METRICS) + ", " + _changes("ssp", "spread", _SP_METRICS).replace("mv as", "mw as").replace("from mv", "from mw").replace("pv as", "pw as").replace("from pv", "from pw").replace("cg as", "ch as")
        + ", tt as (select * from isp where split <> 'train'), " + _tests("tt", "split = 'test'") + f", tp as (select factor, ret, ks, {q.p_ks('ks', 'n1', 'n2')} as p from ts)"
        + ", ci as (select factor, ret, max(valid_vs_test) filter (metric = 'mean') as a, max(valid_vs_test) filter (metric = 'icir') as b from cg group by all), cs as (select factor, ret, valid_vs_test as c from ch where metric = 'mean')",
        f"select factor, ret, {q.near('a', 4)} as ic_change, {q.near('b', 4)} as icir_change, {q.near('c', 4)} as spread_change, {q.near('p', 5)} as ic_ks_p, p < 0.05 as significant, not (coalesce(a > 0.5, false) or coalesce(b > 0.5, false) or coalesce(c > 0.5, false)) as passed from ci full join cs using (factor, ret) left join tp using (factor, ret)",
    )
)
def d6_drift_report(spark, d):
    scores = written(scored(wide(spark, d), FACTORS, ["r5", "r1"], 5), "scores")
    rows = drift.drift_report(daily_ic_of(scores, LEAST), ev.spread(quantile_returns_of(scores), 5))
    return rounded(rows, ic_change=4, icir_change=4, spread_change=4, ic_ks_p=5).select("factor", "ret", "ic_change", "icir_change", "spread_change", "ic_ks_p", "significant", "passed")
