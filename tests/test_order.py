"""Ranks, quantiles and two-sample statistics in pieces, against pandas and plain counts."""

import random

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import order


@pytest.fixture(scope="module")
def values(spark):
    rng, rows = random.Random(1), []
    for key, n in (("many", 3000), ("ties", 2000), ("few", 3), ("one", 1), ("same", 50)):
        for i in range(n):
            # a third of "ties" is zero, "same" has one value
            x = {"many": rng.gauss(0, 1), "ties": 0.0 if i % 3 == 0 else float(rng.randint(-9, 9)), "few": float(i), "one": 7.0, "same": 2.0}[key]
            rows.append((key, x, i % 4 == 0))
    rows += [("many", None, True), ("null", None, False)]
    return spark.createDataFrame(rows, "key string, x double, later boolean")


@pytest.mark.parametrize("pieces", [2, 16, 64])
def test_ranks_equal_pandas(values, pieces):
    got = order.with_ranks(values, "x", ["key"], pieces=pieces).toPandas()
    assert len(got) == 5054
    for _, g in got.groupby("key"):
        assert g["rank"].tolist() == g.x.rank().tolist()


def test_ranks_without_keys(values):
    got = order.with_ranks(values.select("x"), "x", []).toPandas()
    assert got["rank"].tolist() == got.x.rank().tolist()


@pytest.mark.parametrize("pieces", [2, 64])
def test_quantiles_equal_numpy(values, pieces):
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.key: r.q for r in order.exact_quantiles(values, "x", ["key"], shares, pieces=pieces).collect()}
    base = values.toPandas().dropna()
    assert set(got) == set(base.key)
    for key, g in base.groupby("key"):
        assert got[key] == pytest.approx(np.quantile(g.x, shares).tolist(), abs=1e-12)


def test_quantiles_without_keys_and_of_nothing(spark, values):
    base = values.toPandas().x.dropna()
    assert order.exact_quantiles(values, "x", [], [0.3]).first().q == pytest.approx([np.quantile(base, 0.3)])
    assert order.exact_quantiles(values.where("false"), "x", ["key"], [0.5]).count() == 0


def test_two_samples_equal_counts(values):
    got = {r.key: r for r in order.two_sample(values, ["key"]).collect()}
    base = values.toPandas().dropna()
    for key, g in base.groupby("key"):
        a, b = g.x[~g.later.astype(bool)].to_numpy(), g.x[g.later.astype(bool)].to_numpy()
        assert (got[key].n1, got[key].n2) == (len(a), len(b))
        assert got[key].r1 == pytest.approx(g.x.rank()[~g.later.astype(bool)].sum())
        if len(a) and len(b):
            at = np.unique(g.x)
            far = np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max()
            assert got[key].ks == pytest.approx(far)


def test_no_window_holds_a_key(values):
    """Every window over rows is partitioned by piece as well; those by key alone see one row a piece."""
    plan = order.with_ranks(values, "x", ["key"])._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window" in line and "rank(" in line]
    assert over_rows and all("_piece" in line and "_salt" in line for line in over_rows)


def test_a_frequent_value_is_spread(spark):
    rows = spark.range(4000).selectExpr("'k' as key", "if(id % 2 = 0, 0.0, id * 1.0) as x", "id")
    ranked = order.with_ranks(rows, "x", ["key"])
    assert {r.rank for r in ranked.where("x = 0").collect()} == {1000.5}
    pdf = ranked.toPandas()
    assert pdf["rank"].tolist() == pd.Series(pdf.x).rank().tolist()
