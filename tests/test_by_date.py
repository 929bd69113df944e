"""Cross-sections scored a date at a time against the operators over windows, and plans that read their input once."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import by_date, order
from factorloom.operators import cross_section as xs
from factorloom.operators import evaluation as ev
from factorloom.plans import evaluation_queries as eq
from tests.conftest import SF

FACTORS, RETURNS = ["a", "b", "flat"], ["r5", "r1"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d, n in enumerate([30, 12, 6, 4, 2, 1, 9]):
        for t in range(n):
            x = [rng.normal(), float(rng.integers(0, 4)), 0.1, float(rng.integers(-3, 4)), rng.normal()]
            rows.append((dt.date(2021, 1, 1 + d), t, *(None if d == 6 and k == 0 or rng.random() < 0.15 else v for k, v in enumerate(x))))
    return spark.createDataFrame(rows, "date date, ticker int, a double, b double, flat double, r5 double, r1 double").repartition(3)


def rows_of(df, digits=9):
    cut = lambda v: round(v, digits) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(cut, r)) for r in df.collect()), key=str)


@pytest.mark.parametrize("clean", [None, (0.1, 0.9)])
def test_scores_equal_windows(spark, wide, clean):
    long = xs.to_long(wide, FACTORS)
    if clean:
        long = xs.standardize(xs.winsorize(long, *clean))
    pairs = ev.paired(long, xs.to_long(wide, RETURNS, "ret"))
    scores = by_date.scored(wide, FACTORS, RETURNS, 4, clean)
    assert rows_of(by_date.daily_ic_of(scores, 5)) == rows_of(ev.daily_ic(pairs, least=5))
    got, want = by_date.quantile_returns_of(scores), ev.quantile_returns(pairs, 4)
    assert got.columns == want.columns and rows_of(got) == rows_of(want) and want.count() > 40
    if clean:
        values = by_date.cleaned_of(scores, "date")
        assert rows_of(values.select("date", "factor", "x")) == rows_of(long.where("value is not null").select("date", "factor", "value"))
        later = by_date.cleaned_of(ev.by_date_share(scores), "later")
        assert dict(rows_of(ev.ks(later, ["factor"], p=False).select("factor", "n1"))) == dict(
            rows_of(ev.by_date_share(long).where("value is not null and not later").groupBy("factor").agg(F.count("*")))
        )


@pytest.mark.parametrize(("piece", "sampled"), [(400_000, 32_768), (8, 32_768), (8, 4)])
def test_drift_of_cleaned_values_equals_windows(spark, wide, monkeypatch, piece, sampled):
    monkeypatch.setattr(by_date.decay, "PIECE_ROWS", piece)
    monkeypatch.setattr(by_date.decay, "SAMPLED", sampled)
    scores = ev.by_date_share(by_date.scored(wide, FACTORS, RETURNS, 4, (0.1, 0.9)), 0.5)
    rows = by_date.cleaned_of(scores, "later")
    want = ev.psi(rows, ["factor"]).join(ev.ks(rows, ["factor"], p=False), "factor")
    assert rows_of(by_date.cleaned_drift(scores)) == rows_of(want.select("factor", "psi", "ks", "n1", "n2"))


def test_drift_report_reads_its_bars_once(spark):
    assert "l_shipdate" not in eq.d6_drift_report(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_are_found_by_short_code(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [float(v) for v in range(-1, 9)]})).withColumn("bounds", F.array(*(F.lit(float(v)) for v in (1, 3, 3, 5, 5, 5, 7))))
    out = order.with_piece(df, "x", "bounds", pieces=8)
    assert [r["_piece"] for r in out.orderBy("x").collect()] == [2 * sum(b < x for b in (1, 3, 3, 5, 5, 5, 7)) + (x in (1, 3, 5, 7)) for x in range(-1, 9)]
    # a step for each half of the boundaries would read its place twice, and so the ones before again and again
    plan = order.with_piece(spark.range(9).select(F.col("id").cast("double").alias("x"), F.array(F.col("id").cast("double")).alias("bounds")), "x", "bounds")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") <= 2
