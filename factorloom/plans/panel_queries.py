"""Queries over sources, cleaning, filters, joins, labels and quality checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import clean
from factorloom.functions.windows import near
from factorloom.operators import filters, joins, labels, quality, sets
from factorloom.plans import sql as q
from factorloom.sources import panel as src
from factorloom.sources import tables
from factorloom.sources.scratch import new_folder, written

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers the function under its name, with its SQL where there is any."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---- sources


@query(q.with_(q.BARS, f"select ticker, date, {', '.join(f'{q.near(c, 4)} as {c}' for c in src.PRICES)} from bars"))
def s1_pivot_measurements(spark, d):
    wide = tables.pivot_measurements(src.measurements(spark, d), src.PRICES)
    return wide.select("ticker", F.col("time").alias("date"), *(near(c, 4).alias(c) for c in src.PRICES))


@query(q.with_(q.BARS, f"select ticker, date, {q.near('close', 4)} as close from bars where date between date '1996-01-01' and date '1997-12-31' and ticker in (1, 2, 3, 5, 8)"))
def s2_load_panel(spark, d):
    rows = tables.load_panel(src.bars(spark, d), [1, 2, 3, 5, 8, 8], "1996-01-01", "1997-12-31")
    return rows.select("ticker", "date", near("close", 4).alias("close"))


@query(q.with_(q.REPORTS, f"select ticker, report_date, {q.near('revenue', 3)} as revenue from reports where ticker in (1, 7)"))
def s3_read_by_key(spark, d):
    return tables.by_key(src.reports(spark, d), [1, 7]).select("ticker", "report_date", near("revenue", 3).alias("revenue"))


@query(
    """select s_suppkey as ticker, case when s_suppkey % 3 = 0 then s_name || '-new' else s_name end as name from supplier
union all select s_suppkey + 1000000, 'new' from supplier where s_suppkey % 10 = 0"""
)
def s4_upsert(spark, d):
    old = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"))
    changed = old.where("ticker % 3 = 0").withColumn("name", F.concat("name", F.lit("-new")))
    added = old.where("ticker % 10 = 0").select((F.col("ticker") + 1000000).alias("ticker"), F.lit("new").alias("name"))
    return tables.upsert(old, changed.unionByName(added), ["ticker"])


@query(
    q.with_(
        q.BARS,
        f"""select case when cast(ticker as varchar) like '00%' or cast(ticker as varchar) like '30%' then 'SZSE' else 'SSE' end as exchange,
  cast(ticker as varchar) as symbol, strftime(date, '%Y-%m-%d %H:%M:%S') as datetime, {q.near('close', 4)} as close, {q.near('volume', 2)} as volume,
  {q.near('amount', 2)} as turnover, 0 as open_interest from bars""",
    )
)
def s5_export_rows(spark, d):
    rows = tables.export_rows(src.bars(spark, d))
    return rows.select("exchange", "symbol", "datetime", near("close", 4).alias("close"), near("volume", 2).alias("volume"), near("turnover", 2).alias("turnover"), "open_interest")


# ---- cleaning


@query(
    """select event_id, value * 1e4 as units, value / 100 as pct, case when abs(value) <= 50 then value end as capped from events"""
)
def c1_c2_c3_c4_parse(spark, d):
    rows = src.table(spark, d, "events")
    text = rows.select("event_id", "value", F.concat(F.col("value").cast("string"), F.lit("万")).alias("u"), F.concat(F.col("value").cast("string"), F.lit("%")).alias("p"))
    return text.select(
        "event_id", clean.parse_unit_value("u").alias("units"), clean.parse_percentage("p").alias("pct"),
        clean.within_magnitude(clean.finite("value"), 50).alias("capped"),
    )


@query(
    q.with_(
        q.REPORTS,
        """, r as (select ticker, report_date, case when ticker % 3 = 0 then announce_date end as a, case when ticker % 5 <> 1 then announce_date end as i from reports),
f as (select *, coalesce(a, i) as own from r)
select ticker, report_date, coalesce(own, min(own) over (partition by report_date)) as announce_date from f
qualify coalesce(own, min(own) over (partition by report_date)) is not null""".lstrip(),
    ).replace("reports)\n, r", "reports), r")
)
def c5_announce_dates(spark, d):
    rows = src.reports(spark, d)
    first = rows.select("ticker", "report_date", F.when(F.col("ticker") % 3 == 0, F.col("announce_date")).alias("a"))
    other = rows.select("ticker", "report_date", F.when(F.col("ticker") % 5 != 1, F.col("announce_date")).alias("indicator_date"))
    return clean.announce_dates(first, other, ["a"]).select("ticker", "report_date", "announce_date")


@query(
    q.with_(
        q.MASTER,
        """select ticker, case substr(cast(ticker as varchar), 1, 1) when '6' then 'sh' when '9' then 'sh' when '0' then 'sz' when '3' then 'sz' else 'bj' end as market,
  cast(upper(name) like '%ST%' as int) as is_st from master""",
    )
)
def c6_c8_market_and_st(spark, d):
    return src.master(spark, d).select("ticker", clean.market_of("ticker").alias("market"), clean.is_special_treatment("name").alias("is_st"))


@query(
    """select event_id, cast(v = 0 and a = 0 as int) as history, cast(v = 0 or a = 0 as int) as realtime, cast(v = 0 or v is null as int) as loader,
  ts + interval 8 hour as local_ts from (select event_id, ts, event_id % 3 as v, event_id % 5 as a from events)"""
)
def c7_c9_suspended_and_local_time(spark, d):
    rows = src.table(spark, d, "events").select("event_id", "ts", (F.col("event_id") % 3).alias("v"), (F.col("event_id") % 5).alias("a"))
    flags = [clean.suspended("v", "a", m).alias(m) for m in ("history", "realtime", "loader")]
    return rows.select("event_id", *flags, clean.to_local_time("ts").alias("local_ts"))


@query(q.with_(q.PANEL, f"select ticker, date, {q.near('close * (1 + st_flag)', 4)} as close_adj, {q.near('open * (1 + st_flag)', 4)} as open_adj from panel"))
def c10_adjusted_prices(spark, d):
    rows = clean.adjust_prices(src.panel(spark, d).withColumn("f", 1 + F.col("st_flag")), "f", ["close", "open"])
    return rows.select("ticker", "date", near("close_adj", 4).alias("close_adj"), near("open_adj", 4).alias("open_adj"))


@query(q.with_(q.BARS, f"select ticker, date, {q.near('case when low < high then close / nullif(high - low, 0) end', 4)} as a from bars"))
def c11_clean_factors(spark, d):
    rows = src.bars(spark, d).select("ticker", "date", F.when(F.col("high") == F.col("low"), float("inf")).otherwise(F.try_divide("close", F.col("high") - F.col("low"))).alias("a"), F.col("close").alias("b"))
    return clean.clean_factors(rows, ["a", "b"], {"b": "a"}).select("ticker", "date", near("a", 4).alias("a"))


# ---- filters

_FLAGGED = f"""{q.PANEL}, lim as (
  select *, abs(close / lag(close) over ({q.T}) - 1) > case when st_flag = 1 then 0.048
    when (cast(ticker as varchar) like '300%' or cast(ticker as varchar) like '688%') then 0.198 else 5.0 end as hit from panel),
flagged as (select *, case when st_flag = 1 then 'st' when volume = 0 and amount = 0 then 'suspended' when coalesce(hit, false) then 'limit_move'
  when date_diff('day', list_date, date) < 60 then 'listing_age' when volume < 10 then 'volume' when close < 1000 then 'price'
  when volume / shares_outstanding < 1e-6 then 'turnover' end as reject_rule from lim)"""


def _flagged(spark, d):
    return filters.tradability(src.panel(spark, d), min_volume=10, min_price=1000, min_turnover=1e-6, limit_threshold=5.0)


@query(q.with_(_FLAGGED, "select ticker, date, reject_rule, cast(reject_rule is null as int) as tradable_flag from flagged"))
def f1_f2_f3_f4_tradability(spark, d):
    return _flagged(spark, d).select("ticker", "date", "reject_rule", "tradable_flag")


@query(
    q.with_(
        _FLAGGED
        + """, s as (select unnest([1, 2, 3, 4, 5, 6, 7]) as step, unnest(['st', 'suspended', 'limit_move', 'listing_age', 'volume', 'price', 'turnover']) as stage),
c as (select s.step, s.stage, count(f.ticker) as removed from s left join flagged f on f.reject_rule = s.stage group by 1, 2),
t as (select count(*) as total from flagged)""",
        "select step, stage, removed, cast(total - sum(removed) over (order by step) as bigint) as remaining, round((total - sum(removed) over (order by step)) / total, 9) as ratio from c, t",
    )
)
def f5_filter_log(spark, d):
    return filters.filter_log(_flagged(spark, d)).withColumn("ratio", F.round("ratio", 9))


@query(q.with_(_FLAGGED, f"select ticker, date, {q.near('case when reject_rule is null then close end', 4)} as close from flagged"))
def f6_mask_untradable(spark, d):
    return filters.mask_untradable(_flagged(spark, d), ["close"]).select("ticker", "date", near("close", 4).alias("close"))


@query(q.with_(q.PANEL, "select ticker, date from panel where volume >= 20 and close >= 1500"))
def f7_universe(spark, d):
    return filters.universe(src.panel(spark, d), 20, 1500).select("ticker", "date")


@query("select event_id, cast(ts as date) as date from events where isodow(ts) < 6")
def f8_on_calendar(spark, d):
    return filters.on_calendar(src.table(spark, d, "events").select("event_id", F.to_date("ts").alias("date")))


@query(
    q.with_(
        f"{q.PANEL}, f as (select ticker, date, lag(close, 5) over ({q.T}) as core, case when date_diff('day', date '1970-01-05', date) // 7 % 3 = 0 then amount end as fin from panel)",
        f"select ticker, date, {q.near('last_value(fin ignore nulls) over (partition by ticker order by date rows between unbounded preceding and current row)', 2)} as fin from f where core is not null",
    )
)
def f9_complete_features(spark, d):
    from factorloom.functions.windows import wt

    week = F.floor(F.datediff("date", F.lit("1970-01-05").cast("date")) / 7)
    rows = src.bars(spark, d).select("ticker", "date", F.lag("close", 5).over(wt()).alias("core"), F.when(week % 3 == 0, F.col("amount")).alias("fin"))
    return filters.complete_features(rows, ["core"], ["fin"]).select("ticker", "date", near("fin", 2).alias("fin"))


# ---- joins

_CAL = f"{q.BARS}, {q.REPORTS}, cal as (select distinct date from bars)"
_EFFECTIVE = f"{_CAL}, eff as (select r.*, (select min(date) from cal where date >= r.announce_date + 1) as effective_date from reports r)"


@query(q.with_(_EFFECTIVE, "select ticker, report_date, effective_date, announce_date < report_date as early from eff"))
def j1_effective_dates(spark, d):
    rows = joins.effective_dates(src.reports(spark, d), src.calendar(src.bars(spark, d)), 1)
    return rows.select("ticker", "report_date", "effective_date", "early")


@query(
    q.with_(
        f"""{_EFFECTIVE}, numbered as (select ticker, date, row_number() over ({q.T}) as n from bars),
last_of as (select ticker, effective_date, arg_max(report_date, report_date) as report_date, arg_max(revenue, report_date) as revenue from eff where effective_date is not null group by 1, 2),
j as (select b.ticker, b.date, b.n, e.report_date, e.revenue, e.effective_date from numbered b asof left join last_of e on b.ticker = e.ticker and b.date >= e.effective_date),
k as (select j.*, (select count(*) from numbered x where x.ticker = j.ticker and x.date > j.effective_date and x.date <= j.date) as age from j)""",
        f"select ticker, date, case when age <= 12 then report_date end as report_date, {q.near('case when age <= 12 then revenue end', 3)} as revenue from k",
    )
)
def j2_asof_reports(spark, d):
    b = src.bars(spark, d)
    eff = joins.effective_dates(src.reports(spark, d), src.calendar(b), 1)
    rows = joins.asof(b.select("ticker", "date"), eff, ["report_date", "revenue"], limit=12)
    return rows.select("ticker", "date", "report_date", near("revenue", 3).alias("revenue"))


@query(q.with_(q.PANEL, f"select ticker, date, name, industry, {q.near('shares_outstanding', 3)} as shares_outstanding from panel"))
def j3_attach_master(spark, d):
    rows = joins.attach(src.bars(spark, d), src.master(spark, d))
    return rows.select("ticker", "date", "name", "industry", near("shares_outstanding", 3).alias("shares_outstanding"))


_VAL = f"""{q.PANEL}, v as (select *, case when (date_diff('day', date '1970-01-05', date) // 7) % 4 = 0 then close * shares_outstanding end as mc from panel),
valued as (select *, coalesce(last_value(mc ignore nulls) over ({q.T} rows between unbounded preceding and current row), close * shares_outstanding) as market_cap from v)"""


@query(q.with_(_VAL, f"select ticker, date, {q.near('market_cap', 2)} as market_cap from valued"))
def j4_attach_valuation(spark, d):
    rows = joins.attach_valuation(src.panel(spark, d), src.valuation(spark, d))
    return rows.select("ticker", "date", near("market_cap", 2).alias("market_cap"))


@query(q.with_(q.BARS, f"select ticker, date, {q.near('close', 4)} as close, {q.near('volume', 2)} as volume from bars where close > 1500"))
def j5_merge_new_columns(spark, d):
    left = src.bars(spark, d).where("close > 1500").select("ticker", "date", "close")
    rows = joins.merge_new_columns(left, src.bars(spark, d).select("ticker", "date", "close", "volume"))
    return rows.select("ticker", "date", near("close", 4).alias("close"), near("volume", 2).alias("volume"))


@query(q.with_(q.BARS, "select count(*) as n from bars where close > 1500 and volume > 30"))
def j6_common_keys(spark, d):
    b = src.bars(spark, d)
    return joins.common_rows(b.where("close > 1500").select("ticker", "date", "close"), b.where("volume > 30").select("ticker", "date", "volume")).agg(F.count("*").alias("n"))


@query(
    q.with_(
        _EFFECTIVE,
        """select ticker, max(report_date) as report_date, count(*) as n_reports from eff where effective_date <= date '1998-06-30' group by 1""",
    )
)
def j7_state_as_of(spark, d):
    eff = joins.effective_dates(src.reports(spark, d), src.calendar(src.bars(spark, d)), 1)
    return joins.state_as_of(eff, "1998-06-30", "summary").select("ticker", "report_date", "n_reports")


@query(
    q.with_(
        f"{q.BARS}, m as (select ticker, date, cast(close > 1500 as int) as in_index from bars), c as (select *, coalesce(cast(in_index <> lag(in_index) over ({q.T}) as int), 0) as changed from m)",
        "select ticker, sum(changed)::bigint as changes, count(distinct date) as n_dates from c group by 1",
    )
)
def j8_index_history(spark, d):
    return joins.membership_changes(src.bars(spark, d).select("ticker", "date", (F.col("close") > 1500).cast("int").alias("in_index")))


# ---- quality


@query(
    q.with_(
        f"""{q.PANEL}, r as (select *, close / lag(close) over ({q.T}) - 1 as ret1 from panel), f as (select feature, x from (select close, ret1 from r) unpivot include nulls (x for feature in (close, ret1))),
c as (select feature, quantile_cont(x, 0.01) as a, quantile_cont(x, 0.99) as b from f group by 1),
s as (select feature, count(*) as n, avg(cast(x is null as int)) as missing, avg(cast(coalesce(x < a or x > b, false) as int)) as extreme from f join c using (feature) group by 1)""",
        f"select feature, n, {q.near('missing')} as missing, {q.near('extreme')} as extreme, concat_ws(',', case when missing > 0.005 then 'missing' end, case when extreme > 0.021 then 'extreme' end) as flags from s",
    )
)
def a1_column_quality(spark, d):
    from factorloom.operators.factors import staged

    rows = quality.red_flags(quality.column_quality(staged(src.panel(spark, d)), ["close", "ret1"]), 0.005)
    return rows.select("feature", "n", near("missing").alias("missing"), near("extreme").alias("extreme"), "flags")


_SHARES = f"""rw as (select *, close / lag(close) over ({q.T}) - 1 as chg from {{0}}),
ct as (select count(*) as n, sum(tradable_flag)::bigint as tradable, count(*) filter (volume = 0) as suspended, count(*) filter (chg > 0.095) as limit_up, count(*) filter (chg < -0.095) as limit_down from rw),
kd as (select sum(k - 1)::bigint as duplicate_keys from (select count(*) as k from {{0}} group by date, ticker)), gp as (select max(g)::int as largest_gap from (select date_diff('day', lag(date) over (order by date), date) as g from (select distinct date from {{0}}))),
fl as (select *, concat_ws(',', case when duplicate_keys / n > 0.01 then 'duplicates' end, case when tradable / n < 0.7 then 'tradable' end, case when largest_gap > 15 then 'gap' end) as flags from ct, kd, gp)"""
_SHARES_OUT = f"select n, duplicate_keys, largest_gap, tradable, suspended, limit_up, limit_down, {q.near('tradable / n')} as tradable_share, {q.near('suspended / n')} as suspended_share, {q.near('(limit_up + limit_down) / n')} as limit_share, flags, case when flags <> '' then 'WARNING' else 'PASS' end as status from fl"


def _panel_quality(rows):
    out = quality.panel_quality(rows)
    shares = ("tradable_share", "suspended_share", "limit_share")
    return out.select("n", "duplicate_keys", "largest_gap", "tradable", "suspended", "limit_up", "limit_down", *(near(c).alias(c) for c in shares), "flags", "status")


def _with_flags(spark, d):
    return src.bars(spark, d).withColumns({"tradable_flag": (F.col("ticker") % 3 != 0).cast("int"), "volume": F.when(F.col("ticker") % 11 == 0, 0.0).otherwise(F.col("volume"))})


_WITH_FLAGS = f"{q.BARS}, flagged as (select date, ticker, close, cast(ticker % 3 <> 0 as int) as tradable_flag, case when ticker % 11 = 0 then 0 else volume end as volume from bars)"


@query(q.with_(f"{_WITH_FLAGS}, planted as (select * from flagged union all select date, ticker, null, tradable_flag, volume from flagged where ticker % 7 = 0), " + _SHARES.format("planted").replace("close / lag(close)", "null / lag(close)"), _SHARES_OUT))
def a1_panel_quality(spark, d):
    """A third of the names untradable, some suspended, and a seventh of all keys repeated; no prices, so no limit moves."""
    rows = _with_flags(spark, d).drop("close")
    return _panel_quality(rows.unionByName(rows.where("ticker % 7 = 0")))


@query(q.with_(f"{_WITH_FLAGS}, " + _SHARES.format("flagged"), _SHARES_OUT))
def a1_panel_quality_of_bars(spark, d):
    return _panel_quality(_with_flags(spark, d))


@query(
    q.with_(
        f"{q.BARS}, fr as (select *, lead(close, 5) over ({q.T}) / close - 1 as f5, case when ticker % 4 = 0 then close end as fin from bars), l10 as (select f5 from fr order by date desc, ticker desc limit 10), m as (select (avg(cast(close is null as int)) + avg(cast(volume is null as int))) / 2 as core, avg(cast(fin is null as int)) as fin from fr), tk as (select count(*) > count(f5) as k from l10)",
        f"select k as tail_kept, {q.near('core')} as core_missing, {q.near('fin')} as financial_missing, core < 0.01 and fin < 0.35 as features_valid, true as time_ordered, k and core < 0.01 and fin < 0.35 as passed from m, tk",
    )
)
def a2_pit_validation(spark, d):
    """Three quarters of a financial column missing: too much; the other checks pass."""
    rows = src.bars(spark, d).withColumns({"future_return_5d": labels.forward_return(5), "fin": F.when(F.col("ticker") % 4 == 0, F.col("close"))})
    out = quality.pit_validation(rows, "future_return_5d", ["close", "volume"], ["fin"])
    return out.select("tail_kept", near("core_missing").alias("core_missing"), near("financial_missing").alias("financial_missing"), "features_valid", "time_ordered", "passed")


@query(q.with_(q.BARS, f"select bool_and(n = least(5, total)) as tail_ok from (select ticker, count(*) as total, count(*) - count(r) as n from (select ticker, lead(close, 5) over ({q.T}) as r from bars) group by 1)"))
def a2_pit_tail(spark, d):
    return quality.pit_tail(labels.future_returns(src.bars(spark, d)), "future_return_5d", 5)


_PROFILE = "select '{0}' as feature, count(*) - count({0}) as missing, {1} as mean, {2} as std, {3} as skew, {4} as kurt, count(case when {0} < (select quantile_cont({0}, 0.25) - 1.5 * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)) from bars) or {0} > (select quantile_cont({0}, 0.75) + 1.5 * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)) from bars) then 1 end) as outliers from bars"


@query(
    q.with_(q.BARS, " union all ".join(_PROFILE.format(c, q.near(f"avg({c})", 3), q.near(f"stddev_samp({c})", 3), q.near(f"skewness({c})", 5), q.near(f"kurtosis({c})", 5)) for c in ("close", "volume")))
)
def a3_feature_profile(spark, d):
    rows = quality.feature_profile(src.bars(spark, d), ["close", "volume"])
    return rows.select("feature", "missing", near("mean", 3).alias("mean"), near("std", 3).alias("std"), near("skew", 5).alias("skew"), near("kurt", 5).alias("kurt"), "outliers")


# ---- labels

_T = q.T


@query(
    q.with_(q.BARS, f"select ticker, date, {', '.join(f'{q.near(f'lead(open, {1 + n}) over ({_T}) / lead(open, 1) over ({_T}) - 1')} as ret_{n}d' for n in (1, 5, 10))}, {q.near(f'ln(lead(open, 6) over ({_T}) / lead(open, 1) over ({_T}))')} as log_5d from bars")
)
def t1_forward_returns(spark, d):
    b = src.bars(spark, d)
    rows = b.select("ticker", "date", *(near(labels.forward_return(n, "open", 1)).alias(f"ret_{n}d") for n in (1, 5, 10)), near(labels.forward_return(5, "open", 1, True)).alias("log_5d"))
    return rows


_FUT = f"{q.PANEL}, fut as (select ticker, date, industry, st_flag, close, lead(close, 5) over ({_T}) / close - 1 as r from panel)"


@query(q.with_(_FUT, f"select ticker, date, {q.near('r')} as r, case when r is not null then cast(r > 0 as int) end as label from fut"))
def t2_t3_binary_label(spark, d):
    rows = labels.future_returns(src.bars(spark, d))
    return rows.select("ticker", "date", near("future_return_5d").alias("r"), labels.binary_label("future_return_5d").alias("label"))


@query(
    q.with_(
        f"{_FUT}, c as (select ticker, quantile_cont(r, 0.2) as lo, quantile_cont(r, 0.8) as hi from fut group by 1)",
        "select ticker, date, case when r <= lo then 0 when r <= hi then 1 when r is not null then 2 end as label from fut left join c using (ticker)",
    )
)
def t4_quantile_label(spark, d):
    rows = labels.history_quantile_label(labels.future_returns(src.bars(spark, d)), "future_return_5d")
    return rows.select("ticker", "date", "label")


def _future(spark, d):
    rows = src.panel(spark, d)
    return rows.select("ticker", "date", "industry", labels.forward_return(5).alias("r"))


@query(q.with_(f"{_FUT}, i as (select date, avg(r) as index_ret from fut where ticker % 2 = 0 group by 1)", f"select ticker, date, {q.near('coalesce(r - index_ret, r)')} as residual from fut left join i using (date)"))
def t5_excess_over_index(spark, d):
    rows = _future(spark, d)
    index = rows.where("ticker % 2 = 0").groupBy("date").agg(F.avg("r").alias("index_ret"))
    return labels.excess_over_index(rows, "r", index).select("ticker", "date", near("residual").alias("residual"))


@query(q.with_(_FUT, f"select ticker, date, {q.near('case when count(r) over (partition by date) >= 10 then r - avg(r) over (partition by date, industry) else r end')} as residual from fut"))
def t6_industry_neutral(spark, d):
    return labels.demeaned(_future(spark, d), "r", ("date", "industry")).select("ticker", "date", near("residual").alias("residual"))


@query(
    q.with_(
        f"{_FUT}, k as (select * from fut where r is not null)",
        f"select ticker, date, {q.near(q.avg_rank('r', 'date') + ' / count(*) over (partition by date)')} as pct, {q.near(q.avg_rank('r', '1') + ' / count(*) over ()')} as pct_all from k",
    )
)
def t7_percent_rank(spark, d):
    rows = _future(spark, d).where("r is not null")
    a = labels.percent_rank(rows, "r").select("ticker", "date", near("rank_pct").alias("pct"))
    b = labels.percent_rank(rows, "r", []).select("ticker", "date", near("rank_pct").alias("pct_all"))
    return a.join(b, ["ticker", "date"])


_RANKED = f"{_FUT}, k as (select *, count(*) over (partition by date) as n from fut where r is not null), p as (select *, ({q.avg_rank('r', 'date')} - 1) / (n - 1) as p from k where n >= 30)"


@query(q.with_(_RANKED, f"select ticker, date, {q.near('(p - avg(p) over (partition by date)) / stddev_samp(p) over (partition by date)')} as rank_label from p"))
def t10_rank_labels(spark, d):
    return labels.rank_labels(_future(spark, d), "r").select("ticker", "date", near("rank_label").alias("rank_label"))


@query()
def t10_gaussian_labels(spark, d):
    return labels.rank_labels(_future(spark, d), "r", "gaussian").select("ticker", "date", near("rank_label").alias("rank_label"))


@query(
    q.with_(
        f"{_FUT}, k as (select * from fut where r is not null)",
        f"select ticker, date, cast(least(floor({q.avg_rank('r', 'date')} / count(*) over (partition by date) * 5), 4) as int) as grade, count(*) over (partition by date) as n from k",
    )
)
def t11_grades_and_groups(spark, d):
    rows = labels.grade_labels(_future(spark, d), "r")
    return rows.join(labels.group_sizes(rows), "date").select("ticker", "date", "grade", "n")


_AHEAD = f"over ({_T} rows between 1 following and 5 following)"


@query(
    q.with_(
        f"{q.BARS}, s as (select *, close / lag(close) over ({_T}) - 1 as ret from bars)",
        f"""select ticker, date, {q.near(f'lead(close, 5) over ({_T})', 4)} as target_price, {q.near(f'lead(close, 5) over ({_T}) / close - 1')} as target_return,
  {q.near(f'case when count(close) {_AHEAD} = 5 then product(1 + ret) {_AHEAD} - 1 end')} as target_return_multi,
  cast(lead(close, 5) over ({_T}) / close - 1 > 0 as int) as target_direction,
  {q.near(f'case when count(close) {_AHEAD} = 5 then max(high) {_AHEAD} end', 4)} as target_high, {q.near(f'case when count(close) {_AHEAD} = 5 then min(low) {_AHEAD} end', 4)} as target_low from s""",
    )
)
def t12_window_targets(spark, d):
    rows = labels.window_targets(src.bars(spark, d))
    digits = {"target_price": 4, "target_high": 4, "target_low": 4, "target_return": 6, "target_return_multi": 6}
    return rows.select("ticker", "date", "target_direction", *(near(c, k).alias(c) for c, k in digits.items()))


@query(
    q.with_(
        f"{q.BARS}, s as (select ticker, date, close, row_number() over ({_T}) as n, lag(date, 9) over ({_T}) as start_date, lead(date) over ({_T}) as prediction_date, avg(close) {q.over(10)} as m from bars)",
        f"select ticker, start_date, date as end_date, prediction_date, 10 as n_rows, {q.near('m', 4)} as mean_close from s where n >= 10 and (n - 10) % 5 = 0 and prediction_date is not null",
    )
)
def t13_sliding_samples(spark, d):
    rows = labels.sliding_samples(src.bars(spark, d), ["close", "volume"])
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x[0]) / F.size("samples")
    return rows.select("ticker", "start_date", "end_date", "prediction_date", F.size("samples").alias("n_rows"), near(mean, 4).alias("mean_close"))


# ---- sets


@query(q.with_(q.BARS, "select ticker, date, rn from (select ticker, date, row_number() over (partition by ticker order by date desc) as rn from bars) where rn <= 3"))
def l2_last_rows(spark, d):
    return sets.last_rows(src.bars(spark, d), 3).select("ticker", "date", "rn")


@query(q.with_(q.BARS, f"select ticker, {q.near('sum(amount)', 2)} as amount from bars group by 1 order by sum(amount) desc, ticker limit 10"))
def l1_top_k(spark, d):
    rows = src.bars(spark, d).groupBy("ticker").agg(F.sum("amount").alias("amount"))
    return sets.top_k(rows, "amount", 10, "ticker").select("ticker", near("amount", 2).alias("amount"))


@query(q.with_(q.BARS, "select ticker, date, close > 2000 as a, case when not close > 2000 then volume > 10 end as b from bars"))
def l3_union(spark, d):
    b = src.bars(spark, d)
    x = b.where("close > 2000").select("ticker", "date", F.lit(True).alias("a"))
    y = b.where("not close > 2000").select("ticker", "date", F.lit(False).alias("a"), (F.col("volume") > 10).alias("b"))
    return sets.union_all([x, y])


@query(q.with_(f"{q.BARS}, {q.REPORTS}", "select ticker, date from bars intersect select ticker, cast(date_trunc('week', announce_date) as date) from reports"))
def l4_common_dates(spark, d):
    """Weeks of all tickers that have both a bar and an announcement."""
    weeks = src.reports(spark, d).select("ticker", F.to_date(F.date_trunc("week", "announce_date")).alias("date"))
    return sets.common(src.bars(spark, d).select("ticker", "date"), weeks, ["ticker", "date"])


@query(q.with_(q.BARS, "select count(distinct date) as n_dates, count(distinct ticker) as n_tickers from bars"))
def l5_distinct(spark, d):
    b = src.bars(spark, d)
    return b.agg(F.countDistinct("date").alias("n_dates"), F.countDistinct("ticker").alias("n_tickers"))


@query("select o_custkey as ticker, count(e.event_id) as n, count(e.event_id) = 0 as missing from (select distinct o_custkey from orders) left join events e on e.user_id = o_custkey group by 1")
def l6_missing_keys(spark, d):
    wanted = src.table(spark, d, "orders").select(F.col("o_custkey").alias("ticker")).distinct()
    counts = src.quotes(spark, d).groupBy("ticker").agg(F.count("*").alias("n"))
    return sets.with_missing(wanted, counts, "ticker").select("ticker", F.coalesce("n", F.lit(0)).alias("n"), "missing")


# ---- written tables: what a query returns has been written and read again


@query(q.with_(q.BARS, f"select f.form, year(date)::int as year, count(*) as n, {q.near('sum(close)', 3)} as close from bars, (values ('csv'), ('parquet')) f(form) group by 1, 2"))
def s6_written_panel(spark, d):
    root, parts = new_folder(spark, "panel"), []
    bars = written(src.bars(spark, d).select("date", "ticker", "close"), "bars")
    for form in ("csv", "parquet"):
        tables.write_panel(bars, f"{root}/{form}", form)
        back = spark.read.schema("date date, ticker long, close double, year int").option("header", True).format(form).load(f"{root}/{form}")
        parts.append(back.groupBy(F.lit(form).alias("form"), "year").agg(F.count("*").alias("n"), near(F.sum("close"), 3).alias("close")))
    return parts[0].unionByName(parts[1])


_SNAPS = f"""{q.BARS}, sn as (select date, ticker, close, lead(close) over ({q.T}) / close - 1 as fwd from bars),
both_ as (select 'ds_2001Q4_v1' as snapshot_id, *, case when fwd > 0 then '1' when fwd is not null then '0' else 'null' end as label from sn
  union all select 'ds_2001Q4_v2', *, case when fwd > 0 then '1' when fwd is not null then '0' else 'null' end from sn where close >= 1000)"""


@query(
    q.with_(
        _SNAPS,
        f"select snapshot_id, count(*) as n_rows, {q.near('avg(cast(fwd is null as int))')} as missing, count(*) filter (label = '1') as up, count(*) filter (label = '0') as down, true as verified, {q.near('sum(close)', 3)} as close from both_ group by 1",
    )
)
def s7_s8_snapshots(spark, d):
    """Two versions of a panel: created, listed, loaded with their hashes verified, and summed up from what was loaded."""
    root = new_folder(spark, "snapshots")
    rows = src.bars(spark, d).select("date", "ticker", "close", labels.forward_return(1).alias("fwd")).withColumn("up", labels.binary_label("fwd"))
    rows = written(rows, "panel")
    tables.create_next_snapshot(rows, root, 2001, 4, label="up")
    tables.create_next_snapshot(rows.where("close >= 1000"), root, 2001, 4, label="up", filters={"least_close": "1000"})
    parts = []
    for meta in tables.list_snapshots(spark, root).collect():  # a row a version
        loaded = tables.load_snapshot(spark, root, meta["snapshot_id"])
        count = lambda k, m=meta: F.coalesce(F.get_json_object(F.lit(m["labels"]), f"$.{k}").cast("long"), F.lit(0))
        parts.append(
            loaded.agg(F.count("*").alias("n"), near(F.sum("close"), 3).alias("close")).select(
                F.lit(meta["snapshot_id"]).alias("snapshot_id"), F.lit(meta["n_rows"]).alias("n_rows"), near(F.get_json_object(F.lit(meta["missing"]), "$.fwd").cast("double")).alias("missing"),
                count("1").alias("up"), count("0").alias("down"), (F.col("n") == meta["n_rows"]).alias("verified"), "close",
            )
        )
    return parts[0].unionByName(parts[1])


@query(q.with_(q.BARS, f"select 'buckets' as table_name, ticker % 5 as bucket, count(*) as n, {q.near('avg(close)', 4)} as mean_close from bars group by all union all select 'summary', -1, count(*), {q.near('avg(close)', 4)} from bars"))
def s9_written_evaluation(spark, d):
    bars = src.bars(spark, d)
    stats = lambda df: df.agg(F.count("*").alias("n"), near(F.avg("close"), 4).alias("mean_close"))
    root = new_folder(spark, "evaluation")
    tables.write_evaluation({"buckets": stats(bars.groupBy((F.col("ticker") % 5).alias("bucket"))), "summary": stats(bars.groupBy()).select(F.lit(-1).cast("long").alias("bucket"), "n", "mean_close")}, root)
    a = spark.read.schema("bucket long, n long, mean_close double").option("header", True).csv(f"{root}/buckets").withColumn("table_name", F.lit("buckets"))
    b = spark.read.schema("bucket long, n long, mean_close double").json(f"{root}/summary_json").withColumn("table_name", F.lit("summary"))
    return a.unionByName(b).select("table_name", "bucket", "n", "mean_close")
