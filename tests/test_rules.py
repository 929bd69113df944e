"""Exponential means and rules with state, against plain loops."""

import datetime
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import factors, portfolio, rules


def walk(n, seed, step=0.04):
    """A price that swings enough to cross its bands."""
    rng, price = random.Random(seed), 100.0
    for _ in range(n):
        price *= math.exp(rng.gauss(0, step))
        yield price


@pytest.fixture(scope="module")
def panel(spark):
    rows, begin = [], datetime.date(2020, 1, 1)
    for ticker in range(4):
        for i, close in enumerate(walk((400, 330, 90, 1)[ticker], ticker)):
            rows.append((begin + datetime.timedelta(i), ticker, close, close * 1.02, close * 0.97, close))
    return spark.createDataFrame(rows, "date date, ticker long, open double, high double, low double, close double")


def by_ticker(df, *columns):
    pdf = df.toPandas().sort_values(["ticker", "date"])
    return {t: [tuple(r) for r in g[list(columns)].itertuples(index=False)] for t, g in pdf.groupby("ticker")}


def test_macd_is_pandas_ewm(panel):
    got = factors.macd(panel).toPandas().sort_values(["ticker", "date"])
    base = panel.toPandas().sort_values(["ticker", "date"])
    for t, g in base.groupby("ticker"):
        line = g.close.ewm(span=12).mean() - g.close.ewm(span=26).mean()
        mine = got[got.ticker == t]
        assert mine.macd.tolist() == pytest.approx(line.tolist(), abs=1e-9)
        assert mine.macd_signal.tolist() == pytest.approx(line.ewm(span=9).mean().tolist(), abs=1e-9)


def test_macd_has_no_python(panel):
    plan = factors.macd(panel)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_linear_recurrence_over_long_history(spark):
    rows = [(1, i, float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "ticker long, date long, x double")
    got = [r.y for r in rules.linear_recurrence(df, {"y": ("x", 0.99)}).orderBy("date").collect()]
    y, want = 0.0, []
    for _, _, x in rows:
        y = x + 0.99 * y
        want.append(y)
    assert got == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("piece", [1, 7, 128])
def test_fold_carries_state_over_pieces(panel, piece):
    def step(state, row):
        up = row["close"] > state["high"]
        return F.struct(F.greatest(state["high"], row["close"]).alias("high"), (state["n"] + up.cast("int")).alias("n"))

    out = rules.fold(panel, ["close"], F.struct(F.lit(0.0).alias("high"), F.lit(0).alias("n")), step, piece)
    got = by_ticker(out.select("date", "ticker", F.col("state.n").alias("n")), "n")
    for t, closes in by_ticker(panel, "close").items():
        high = n = 0
        want = []
        for (c,) in closes:
            n += c > high
            high = max(high, c)
            want.append((n,))
        assert got[t] == want


def bands(closes, n=20, width=2.0):
    s = pd.Series(closes)
    mid, sd = s.rolling(n).mean(), s.rolling(n).std(ddof=0)
    return mid.tolist(), (mid + width * sd).tolist(), (mid - width * sd).tolist()


def test_bollinger_strategy_is_its_loop(panel):
    got = by_ticker(portfolio.bollinger_strategy(panel, warm_up=30), "position")
    seen = set()
    for t, rows in by_ticker(panel, "close").items():
        closes = [c for (c,) in rows]
        mid, up, low = bands(closes)
        entry, want = 0.0, []
        for i, c in enumerate(closes):
            if i + 1 >= 30:
                if entry == 0:
                    if c > up[i] and closes[i - 1] <= up[i - 1]:
                        entry = c
                        seen.add("upper")
                    elif c < low[i] and closes[i - 1] >= low[i - 1]:
                        entry = c
                        seen.add("lower")
                elif c <= mid[i]:
                    entry = 0.0
                    seen.add("middle")
                elif c <= entry * 0.95:
                    entry = 0.0
                    seen.add("stop")
                elif c >= entry * 1.10:
                    entry = 0.0
                    seen.add("target")
            want.append((int(entry != 0),))
        assert got[t] == want
    assert {"upper", "lower", "middle"} <= seen


def test_ma_atr_strategy_is_its_loop(panel):
    got = by_ticker(portfolio.ma_atr_strategy(panel, warm_up=30), "position")
    seen = set()
    for t, rows in by_ticker(panel, "close", "high", "low").items():
        df = pd.DataFrame(rows, columns=["c", "h", "l"])
        before = df.c.shift()
        tr = pd.concat([df.h - df.l, (df.h - before).abs(), (df.l - before).abs()], axis=1).max(axis=1)
        f, s, a = df.c.rolling(5).mean().tolist(), df.c.rolling(20).mean().tolist(), tr.rolling(14).mean().tolist()
        n, entry, last, want = 0, 0.0, 0.0, []
        for i, c in enumerate(df.c):
            if i + 1 >= 30:
                golden, death = f[i] > s[i] and f[i - 1] <= s[i - 1], f[i] < s[i] and f[i - 1] >= s[i - 1]
                if golden and n == 0:
                    n, entry, last = 1, c, c
                elif n and death:
                    n = 0
                    seen.add("death")
                elif n and c >= last + a[i] and n < 3 and f[i] > s[i]:
                    n, last = n + 1, c
                    seen.add("layer")
                elif n and c <= entry - 2 * a[i]:
                    n = 0
                    seen.add("stop")
            want.append((n,))
        assert got[t] == want
    assert {"death", "layer"} <= seen


def test_macd_kd_strategy_is_its_loop(panel):
    made = portfolio.macd_kd_strategy(panel, 40, 60, warm_up=30)
    got = by_ticker(made, "position")
    base = by_ticker(factors.with_macd(portfolio.stochastic(panel)), "k", "d", "macd")
    bought = 0
    for t, rows in base.items():
        position, buy_flag, sell_flag, want = 0, False, False, []
        for i, (k, d, dif) in enumerate(rows):
            if i + 1 >= 30:
                k0, d0, _ = rows[i - 1]
                if k > d and k0 <= d0 and (k <= 40 or d <= 40):
                    buy_flag = True
                if k < d and k0 >= d0 and (k >= 60 or d >= 60):
                    sell_flag = True
                buy = dif > 0 and buy_flag and k > 40 and k0 <= 40
                sell = dif < 0 and sell_flag and k < 60 and k0 >= 60
                buy_flag, sell_flag = buy_flag and not buy and k < 60, sell_flag and not sell and k > 40
                if buy and position == 0:
                    position = 1
                    bought += 1
                elif sell and position:
                    position = 0
            want.append((position,))
        assert got[t] == want
    assert bought
