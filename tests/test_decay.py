"""Rank correlations over horizons against pandas, and what they leave on disk."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import decay
from factorloom.operators import evaluation as ev

DAY = dt.date(2020, 1, 1)


def frame(tickers=9, dates=40, seed=3):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame([(DAY + dt.timedelta(days=d), t) for t in range(tickers) for d in range(dates - t)], columns=["date", "ticker"])
    rows["close"] = rng.integers(1, 6, len(rows)).astype(float)  # so returns tie
    rows["a"] = rng.normal(size=len(rows))
    rows["b"] = rng.integers(-2, 3, len(rows)) * 0.0 + rng.integers(0, 2, len(rows)) * (rng.random(len(rows)) < 0.3)  # most are zero, of either sign
    rows["flat"] = 1.0
    for c in ("close", "a", "b"):
        rows[c] = rows[c].astype(object).where(rng.random(len(rows)) > 0.1, None)
    return rows


def plain(rows, factors, horizons):
    rows = rows.sort_values(["ticker", "date"]).astype({c: float for c in ["close", *factors]})
    out = {}
    for h in range(1, horizons + 1):
        y = rows.groupby("ticker")["close"].shift(-h) / rows["close"] - 1
        for f in factors:
            both = pd.DataFrame({"x": rows[f] + 0.0, "y": y}).dropna()
            r = both.rank()
            if len(both):
                out[f, h] = None if r.x.nunique() < 2 or r.y.nunique() < 2 else r.x.corr(r.y)
    return out


@pytest.mark.parametrize(("block", "piece", "at_once"), [(65_536, 400_000, 4_000_000), (60, 25, 1), (60, 25, 1_000)])
def test_decay_equals_pandas(spark, monkeypatch, block, piece, at_once):
    monkeypatch.setattr(decay, "BLOCK_ROWS", block)
    monkeypatch.setattr(decay, "PIECE_ROWS", piece)
    monkeypatch.setattr(decay, "ROUND_ROWS", at_once)
    rows = frame()
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in rows.itertuples(index=False)], "date date, ticker int, close double, a double, b double, flat double")
    got = {(r["factor"], r["horizon"]): r["ic"] for r in ev.ic_decay(df.repartition(3), ["a", "b", "flat"], 7).collect()}
    want = plain(rows, ["a", "b", "flat"], 7)
    assert got.keys() == want.keys() and len(got) == 21
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-12)


def test_decay_of_nothing(spark):
    empty = spark.createDataFrame([], "date date, ticker int, close double, a double")
    assert ev.ic_decay(empty, ["a"], 3).collect() == []
    short = spark.createDataFrame([(DAY, 1, 2.0, 1.0), (DAY, 2, 2.0, None), (DAY + dt.timedelta(days=1), 1, 3.0, 1.0)], "date date, ticker int, close double, a double")
    assert [tuple(r) for r in ev.ic_decay(short, ["a"], 3).collect()] == [("a", 1, None)]


def test_sortable_orders_doubles():
    x = np.array([-np.inf, -2.5, -1e-300, 0.0, 1e-300, 7.0, np.inf, np.nan])
    assert (np.diff(decay.sortable(x).astype(object)) > 0).all() and decay.sortable(x)[-1] < decay.NULL
    assert decay.sortable(np.array([-0.0])) == decay.sortable(np.array([0.0]))


def test_decay_leaves_no_shuffle_files(spark):
    """What one round of horizons shuffles is gone before the next one adds to it."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    rows = frame()
    df = spark.createDataFrame([(r.date, r.ticker, r.close, r.a) for r in rows.itertuples()], "date date, ticker int, close double, a double")
    names = lambda: {f.getName() for f in (lambda s: [s.apply(k) for k in range(s.size())])(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = names()
    assert len(ev.ic_decay(df, ["a"], 5).collect()) == 5
    for _ in range(50):
        if not names() - before:
            break
        time.sleep(0.1)
    assert not names() - before
