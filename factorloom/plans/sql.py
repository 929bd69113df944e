"""Pieces of DuckDB SQL shared by the oracles."""

_KEY = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_DKEY = ", ".join(f"{c} desc" for c in _KEY.split(", "))

BARS = f"""bars as (
  select l_suppkey as ticker, cast(date_trunc('week', l_shipdate) as date) as date,
    first(l_extendedprice / l_quantity order by {_KEY}) as open, max(l_extendedprice / l_quantity) as high,
    min(l_extendedprice / l_quantity) as low, first(l_extendedprice / l_quantity order by {_DKEY}) as close,
    sum(l_quantity) as volume, sum(l_extendedprice) as amount
  from lineitem group by 1, 2)"""

MASTER = """master as (
  select s_suppkey as ticker, s_name as name, n_name as industry, list_date, 1000 * (1 + abs(s_acctbal)) as shares_outstanding,
    cast(s_suppkey % 20 = 0 as int) as st_flag
  from supplier left join nation on s_nationkey = n_nationkey
  left join (select l_suppkey, cast(date_trunc('week', min(l_shipdate)) as date) as list_date from lineitem group by 1) on l_suppkey = s_suppkey)"""

PANEL = f"""{BARS}, {MASTER}, panel as (
  select b.*, m.name, m.industry, m.list_date, m.shares_outstanding, m.st_flag from bars b left join master m using (ticker))"""

REPORTS = """reports as (
  select l_suppkey as ticker, cast(date_trunc('quarter', l_shipdate) + interval 3 month - interval 1 day as date) as report_date,
    sum(l_extendedprice * (1 - l_discount)) as revenue, sum(l_extendedprice * (l_tax + 0.02)) as net_profit,
    sum(l_extendedprice) as assets, sum(l_extendedprice * l_discount * 5) as debt,
    cast(cast(date_trunc('quarter', l_shipdate) + interval 3 month - interval 1 day as date) + cast(20 + l_suppkey % 40 as int) as date) as announce_date
  from lineitem group by l_suppkey, date_trunc('quarter', l_shipdate))"""

STAGED = f"""{PANEL}, staged as (
  select *, close / lag(close) over (partition by ticker order by date) - 1 as ret1, volume / shares_outstanding as turnover_ from panel)"""

T = "partition by ticker order by date"


def over(n: int) -> str:
    return f"over ({T} rows between {n - 1} preceding and current row)"


def roll(fn: str, x: str, n: int) -> str:
    """``fn`` with ``{}`` for the value, over the last n rows, null unless all n have one."""
    call = fn.format(x) if "{}" in fn else f"{fn}({x})"
    return f"case when count({x}) {over(n)} = {n} then {call} {over(n)} end"


def change(x: str, n: int = 1) -> str:
    return f"({x} / lag({x}, {n}) over ({T}) - 1)"


def near(x: str, digits: int = 6) -> str:
    return f"round(({x}) + {0.31415926 * 10.0**-digits!r}, {digits}) + 0.0"


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> str:
    """``macd`` with ``macd, macd_signal, macd_hist`` of ``bars``: the exponential means row after row (needs ``with recursive``)."""
    bf, bs, bg = (repr(1 - 2 / (n + 1)) for n in (fast, slow, signal))
    return f"""rn as materialized (select *, row_number() over ({T}) as i from bars),
em as (select ticker, date, i, close, close as nf, 1.0::double as df, close as ns, 1.0::double as ds, 0.0::double as line, 0.0::double as sn, 1.0::double as sd from rn where i = 1
  union all select ticker, date, i, close, nf, df, ns, ds, nf / df - ns / ds, nf / df - ns / ds + {bg} * sn, 1 + {bg} * sd from (
    select r.ticker, r.date, r.i, r.close, r.close + {bf} * e.nf as nf, 1 + {bf} * e.df as df, r.close + {bs} * e.ns as ns, 1 + {bs} * e.ds as ds, e.sn, e.sd
    from em e join rn r on r.ticker = e.ticker and r.i = e.i + 1)),
macd as (select ticker, date, close, i, line as macd, sn / sd as macd_signal, line - sn / sd as macd_hist from em)"""


def p_t(t: str, df: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom: the finite series in cos(atan(t / sqrt(df)))."""
    c2 = f"({df} / ({df} + ({t}) * ({t})))"
    sin = f"(abs({t}) / sqrt({df} + ({t}) * ({t})))"
    even = f"{sin} * coalesce(list_sum(list_transform(range(0, cast({df} // 2 as bigint)), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) - lgamma(0.5) + j * ln({c2})))), 0)"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {sin} * coalesce(list_sum(list_transform(range(0, cast(({df} - 1) // 2 as bigint)), lambda j: exp(lgamma(j + 1.0) - lgamma(j + 1.5) + lgamma(1.5) + (j + 0.5) * ln({c2})))), 0))"
    return f"(1 - case when {df} % 2 = 0 then {even} else {odd} end)"


def p_ks(d: str, n1: str, n2: str) -> str:
    """Asymptotic p of the two-sample Kolmogorov-Smirnov statistic."""
    s = f"(({d}) * sqrt(({n1}) * ({n2}) / (({n1}) + ({n2}))))"
    return f"case when {s} < 1e-9 then 1.0 else least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2 * (k * {s}) ** 2))))) end"


def p_normal(z: str) -> str:
    """Two-sided p of a normal value: 1 - erf(z / sqrt(2)) by the series of positive terms."""
    x = f"(abs({z}) / sqrt(2.0))"
    return f"case when {z} = 0 then 1.0 else 1 - 2 * exp(-{x} * {x}) * list_sum(list_transform(range(0, 200), lambda j: exp((2 * j + 1) * ln({x}) - ln(2.0) - lgamma(j + 1.5)))) end"


def p_kendall(tau: str, n: str = "5") -> str:
    """Exact p of Kendall's tau of five values: orders of five by their number of inversions."""
    assert n == "5"
    return f"least(1.0, 2 * list_sum([1, 4, 9, 15, 20, 22, 20, 15, 9, 4, 1][1:cast(round((1 - abs({tau})) * 5) as int) + 1]) / 120.0)"


def with_(ctes: str, body: str) -> str:
    return f"with {ctes}\n{body}"


def avg_rank(x: str, keys: str) -> str:
    return f"(rank() over (partition by {keys} order by {x}) + (count(*) over (partition by {keys}, {x}) - 1) / 2.0)"
