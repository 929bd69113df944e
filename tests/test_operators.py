"""Ties, nulls, flat groups, short histories, and properties that hold for any panel."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import clean, tests
from factorloom.operators import cross_section as xs
from factorloom.operators import evaluation as ev
from factorloom.operators import filters, joins, splits
from factorloom.operators import labels as lab
from factorloom.operators import portfolio as pf
from factorloom.operators import regimes as rg
from factorloom.sources import tables
from factorloom.sources.panel import bars, quotes
from factorloom.streaming import quotes as st
from tests.conftest import SF

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def long(spark, values, day=D[0]):
    return frame(spark, [(day, k, "f", v) for k, v in enumerate(values)], "date date, ticker long, factor string, value double")


def test_parse_units(spark):
    cases = {"1.2亿": 1.2e8, "3万": 3e4, "5k": 5e3, "2m": 2e6, "1,234": 1234.0, "--": None, "N/A": None, "False": None, "x": None, "": None, None: None, "-7": -7.0}
    df = frame(spark, [(k,) for k in cases], "s string").select("s", clean.parse_unit_value("s").alias("v"), clean.parse_percentage("s").alias("p"))
    got = {r["s"]: r["v"] for r in df.collect()}
    for k, v in cases.items():
        assert got[k] == (pytest.approx(v) if v is not None else None), k
    assert frame(spark, [("12.5%",)], "s string").select(clean.parse_percentage("s")).first()[0] == pytest.approx(0.125)


def test_finite_and_magnitude(spark):
    df = frame(spark, [(1.0,), (float("nan"),), (float("inf"),), (None,), (2e9,)], "x double")
    assert [r[0] for r in df.select(clean.finite("x")).collect()] == [1.0, None, None, None, 2e9]
    assert [r[0] for r in df.select(clean.within_magnitude(clean.finite("x"))).collect()] == [1.0, None, None, None, None]


def test_suspended_modes(spark):
    df = frame(spark, [(0.0, 0.0), (0.0, 5.0), (None, 5.0), (3.0, 5.0)], "v double, a double")
    got = {m: [r[0] for r in df.select(clean.suspended("v", "a", m)).collect()] for m in ("history", "realtime", "loader")}
    assert got == {"history": [1, 0, 0, 0], "realtime": [1, 1, 0, 0], "loader": [1, 1, 1, 0]}


def test_standardize_flat_and_thin_groups(spark):
    flat = [r["value"] for r in xs.standardize(long(spark, [2.0, 2.0, 2.0])).collect()]
    assert flat == [0.0, 0.0, 0.0]
    assert {r["value"] for r in xs.standardize(long(spark, [2.0, 2.0, 2.0]), "minmax").collect()} == {0.5}
    assert sorted(r["value"] for r in xs.standardize(long(spark, [2.0, 9.0])).collect()) == [2.0, 9.0]
    ranks = sorted(r["value"] for r in xs.standardize(long(spark, [1.0, 2.0, 2.0, 5.0]), "rank").collect())
    assert ranks == pytest.approx([0.0, 0.5, 0.5, 1.0])


def test_neutralized_residuals_are_orthogonal(spark):
    rows = [(D[0], k, "f", float((k * 7) % 11), 10.0 + k * k, ["a", "b", None][k % 3]) for k in range(30)]
    df = frame(spark, rows, "date date, ticker long, factor string, value double, market_cap double, industry string")
    for constant in (True,):
        out = xs.neutralize(df, constant=constant).collect()
        groups: dict = {}
        for r in out:
            groups.setdefault(r["industry"], []).append(r["value"])
        assert all(abs(sum(g)) < 1e-9 for g in groups.values())
        assert abs(sum(r["value"] * math.log(r["market_cap"]) for r in out)) < 1e-8


def test_neutralize_without_cap_stays(spark):
    rows = [(D[0], k, "f", float(k), c, "a") for k, c in enumerate([1.0, 2.0, 3.0, -1.0, None])]
    out = xs.neutralize(frame(spark, rows, "date date, ticker long, factor string, value double, market_cap double, industry string"))
    got = {r["ticker"]: r["value"] for r in out.collect()}
    assert got[3] == 3.0 and got[4] == 4.0


def test_ic_with_ties_and_missing_side(spark):
    x = long(spark, [1.0, 1.0, 2.0, 3.0, None])
    y = frame(spark, [(D[0], k, "r", v) for k, v in enumerate([1.0, 2.0, None, 4.0, 5.0])], "date date, ticker long, ret string, value double")
    row = ev.daily_ic(ev.paired(x, y)).first()
    assert row["n"] == 3 and row["ic"] == pytest.approx(0.8660254037844387)


def test_constant_side_has_no_ic(spark):
    y = frame(spark, [(D[0], k, "r", float(k)) for k in range(4)], "date date, ticker long, ret string, value double")
    assert ev.daily_ic(ev.paired(long(spark, [1.0] * 4), y)).count() == 0


def test_bucket_edges(spark):
    df = frame(spark, [(v,) for v in (1.0, 2.0, 3.0, 4.0)], "x double").withColumn("e", F.array(F.lit(2.0), F.lit(2.0), F.lit(3.0)))
    assert [r[0] for r in df.select(ev.bucket_of("x", F.col("e"))).collect()] == [1, 3, 4, 4]
    assert [r[0] for r in df.select(ev.bucket_of("x", F.col("e"), "right")).collect()] == [1, 1, 2, 3]


def test_p_values():
    assert tests.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tests.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert tests.ks_two_sided(1.3580986 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-5)
    assert tests.kendall_two_sided(1.0, 5) == pytest.approx(2 / 120)
    assert tests.kendall_two_sided(0.0, 4) == 1.0


def test_asof_sees_only_effective_reports_within_limit(spark):
    panel = frame(spark, [(d, 1) for d in D[:20]] + [(D[3], 2)], "date date, ticker long")
    reports = frame(spark, [(1, D[5], "a", D[0]), (1, D[8], "b", D[1])], "ticker long, effective_date date, name string, report_date date")
    got = {r["date"]: r["name"] for r in joins.asof(panel, reports, ["name"], limit=4).where("ticker = 1").collect()}
    expected = {d: None for d in D[:5]} | {d: "a" for d in D[5:8]} | {d: "b" for d in D[8:13]} | {d: None for d in D[13:20]}
    assert got == expected
    off_day = frame(spark, [(d, 1) for d in D[:20] if d != D[5]], "date date, ticker long")
    got = {r["date"]: r["name"] for r in joins.asof(off_day, reports.where("name = 'a'"), ["name"], limit=2).collect()}
    assert [d for d, v in sorted(got.items()) if v] == D[6:8]


def test_effective_date_rolls_over_gaps(spark):
    panel = frame(spark, [(D[0],), (D[7],), (D[14],)], "date date")
    cal = panel.withColumn("idx", F.lit(1))
    reports = frame(spark, [(1, D[3], D[2]), (2, D[0], D[6]), (3, D[2], D[30])], "ticker long, report_date date, announce_date date")
    got = {r["ticker"]: (r["effective_date"], r["early"]) for r in joins.effective_dates(reports, cal, 1).collect()}
    assert got == {1: (D[7], True), 2: (D[7], False), 3: (None, False)}


def test_splits_are_disjoint(spark):
    panel = frame(spark, [(d, t) for d in D for t in (1, 2)], "date date, ticker long")
    row = splits.leakage(splits.single_split(panel, 0.6, 0.2, purge=3, embargo=1), 3).first()
    assert row["shared_dates"] == 0 and row["gap_ok"]
    folds = splits.walk_forward(panel, 3, 10, purge=2)
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {0, 1, 2}


def test_filter_order_and_log(spark):
    rows = [(D[k], 1, 10.0, 5.0, 50.0, D[0], 100.0, st) for k, st in enumerate([1, 0, 0])]
    panel = frame(spark, rows, "date date, ticker long, close double, volume double, amount double, list_date date, shares_outstanding double, st_flag int")
    got = [r["reject_rule"] for r in filters.tradability(panel, min_listing_days=2).orderBy("date").collect()]
    assert got == ["st", "listing_age", None]
    log = {r["stage"]: (r["removed"], r["remaining"]) for r in filters.filter_log(filters.tradability(panel, min_listing_days=2)).collect()}
    assert log["st"] == (1, 2) and log["listing_age"] == (1, 1) and log["turnover"] == (0, 1)


def test_portfolio_weights_and_equity(spark):
    rows = [(D[k], t, float((k * t) % 7), 1) for k in range(12) for t in range(1, 9)]
    scores = frame(spark, rows, "date date, ticker long, score double, tradable_flag int")
    held = pf.holdings(scores, 3, "weekly", "score")
    assert all(r["w"] == pytest.approx(1.0) for r in held.groupBy("date").agg(F.sum("weight").alias("w")).collect())
    forward = scores.select("date", "ticker", (F.col("score") / 1000).alias("fwd"))
    daily = pf.daily_performance(held, forward).orderBy("date").collect()
    assert daily[0]["turnover"] == pytest.approx(0.5)
    equity = 1.0
    for r in daily:
        equity *= 1 + r["net"]
        assert r["equity"] == pytest.approx(equity)


def test_untradable_names_come_last(spark):
    scores = frame(spark, [(D[0], 1, 9.0, 0), (D[0], 2, 1.0, 1), (D[0], 3, None, 1)], "date date, ticker long, score double, tradable_flag int")
    assert [r["ticker"] for r in pf.top_scores(scores, 2).orderBy("rank").collect()] == [2, 3]


def test_held_signal_does_not_overlap(spark):
    raw = [1, 1, 0, 0, 1, 0, 0, 0]
    df = frame(spark, [(D[k], 1, v) for k, v in enumerate(raw)], "date date, ticker long, raw int")
    assert [r["signal"] for r in rg.held_signal(df, "raw", 3).orderBy("date").collect()] == [1, 1, 1, 0, 1, 1, 1, 0]


def test_snapshot_round_trip(spark, tmp_path):
    df = frame(spark, [(1, "a"), (2, None)], "x int, s string")
    root = f"file://{tmp_path}/snaps"
    made = tables.create_snapshot(df, root, tables.next_snapshot_id([], 2025, 4), note="first").first()
    assert made["snapshot_id"] == "ds_2025Q4_v1" and made["n_rows"] == 2
    assert tables.load_snapshot(spark, root, "ds_2025Q4_v1").count() == 2
    assert tables.next_snapshot_id(["ds_2025Q4_v1", "ds_2025Q4_v9"], 2025, 4) == "ds_2025Q4_v10"
    assert tables.list_snapshots(spark, root).count() == 1
    assert tables.content_hash(df.orderBy(F.desc("x"))).first() == tables.content_hash(df).first()


def test_export_writes_csv(spark, tmp_path):
    tables.write_export(bars(spark, SF), f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == bars(spark, SF).count()


def test_stream_equals_batch(spark, tmp_path):
    q = quotes(spark, SF)
    source = tmp_path / "events"
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"file://{source}")
    stream = st.bars(st.normalize(_quotes(spark, source)), "1 day")
    got = st.run_to_memory(stream, "bars_test", "complete", str(tmp_path / "cp")).orderBy("ticker", "start").collect()
    assert got == st.bars(st.normalize(q), "1 day").orderBy("ticker", "start").collect()


def _quotes(spark, source):
    from factorloom.sources.panel import quotes_of

    return quotes_of(st.read_events(spark, f"file://{source}", "part-*"))


def test_late_ticks_are_dropped(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, 10)
    first = [(k, base + dt.timedelta(minutes=k), 1, "x", float(k), '{"k": 1}') for k in range(70)]
    tick = lambda k, hours, price: [(k, base + dt.timedelta(hours=hours), 1, "x", price, '{"k": 1}')]
    for k, rows in enumerate((first, tick(100, 3, 1.0), tick(101, 0, 99.0), tick(102, 6, 1.0), tick(103, 9, 1.0))):
        spark.createDataFrame(rows, st.EVENTS).coalesce(1).write.parquet(f"file://{tmp_path}/events/{k}")
    from factorloom.sources.panel import quotes_of

    stream = st.bars(quotes_of(st.read_events(spark, f"file://{tmp_path}/events/*")), "1 hour", watermark="5 minutes")
    got = st.run_to_memory(stream, "late_test", "append", str(tmp_path / "cp")).collect()
    assert got and all(r["high"] < 99 for r in got)


def test_live_positions_equal_a_fold(spark):
    from factorloom.plans.registry import QUERIES

    rows = QUERIES["z5_live_positions"](spark, SF).orderBy("ticker", "start").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["ticker"], []).append(r)
    for history in by.values():
        closes, position, above = [], 0, -1
        for r in history:
            closes = [*closes, r["close"]][-6:]
            if len(closes) == 6:
                now = int(sum(closes[-3:]) / 3 > sum(closes) / 6)
                if above in (0, 1) and now != above:
                    position = now
                above = now
            assert r["position"] == position


def test_streamed_queries_stay_out_of_the_driver(spark, monkeypatch):
    from factorloom.plans import portfolio_queries as pq

    def refuse(*args):
        raise AssertionError("the memory sink collects the result to the driver")

    monkeypatch.setattr(st, "run_to_memory", refuse)
    got = pq.z3_streamed_daily_closes(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, st.bars(quotes(spark, SF), "1 day").select("ticker", "start", "close").collect()))
    held = pq.z5_live_positions(spark, SF)
    assert held.count() == got.count() and all("parquet" in f for df in (got, held) for f in df.inputFiles())


def test_half_lives_up_to_twenty_periods(spark, monkeypatch):
    from factorloom.plans import evaluation_queries as eq

    def slow(wide, factors, horizons=20):
        return spark.createDataFrame([("f", h, 1.0 if h < 20 else 0.4) for h in range(1, horizons + 1)], "factor string, horizon int, ic double")

    monkeypatch.setattr(eq.ev, "ic_decay", slow)
    assert [tuple(r) for r in eq.e12_half_life(spark, SF).collect()] == [("f", 20)]


def test_limit_moves_beyond_the_limit_only(spark):
    rows = [(1, 1, 100.0), (1, 2, 600.0), (2, 1, 100.0), (2, 2, 600.1), (3, 1, 100.0), (3, 2, 599.0)]
    from factorloom.operators.filters import limit_move

    df = spark.createDataFrame([(t, d, c, 0) for t, d, c in rows], "ticker int, date int, close double, st_flag int")
    hits = {(r["ticker"], r["date"]): r["hit"] for r in df.withColumn("hit", limit_move(5.0)).collect()}
    assert not hits[1, 2] and hits[2, 2] and not hits[3, 2] and hits[1, 1] is None


def test_factor_library(spark):

    history = spark.createDataFrame([], "factor string, version int, status string, ic_mean double, icir double")
    cand = spark.createDataFrame([("a", 0.1, 1.0, True), ("b", -0.3, 0.5, True), ("c", 0.9, 2.0, False)], "factor string, ic_mean double, icir double, passed boolean")
    one = ev.library_add(history, cand, 1)
    assert ev.library_add(one, cand, 2).count() == 2  # neither is new
    two = ev.library_update(one, cand.where("factor in ('a', 'c')").withColumn("ic_mean", F.lit(-0.5)), 2)
    assert [(r["factor"], r["ic_mean"], r["versions"]) for r in ev.library_report(two).collect()] == [("a", -0.5, 2), ("b", -0.3, 1)]
    gone = ev.library_remove(two, cand.select("factor"), 3)
    assert ev.library_report(gone).count() == 0 and gone.count() == 5
    assert ev.library_report(ev.library_add(gone, cand, 4)).count() == 2  # removed ones may come back


def test_qualified_factors(spark):

    rows = spark.createDataFrame([("a", "r", 0.6, 0.01), ("b", "r", 0.9, 0.2), ("c", "r", 0.7, 0.04), ("d", "r", None, None)], "factor string, ret string, icir double, p_value double")
    assert [(r["factor"], r["qualified"]) for r in ev.qualified(rows).collect()] == [("b", False), ("c", True), ("a", True), ("d", False)]
    assert [r["factor"] for r in ev.qualified(rows, top=1).collect()] == ["c"]


def test_regime_signal(spark):

    rows = [(1, 1, 4, 0, 2.0), (1, 1, 5, 3, 2.0), (2, 1, 4, 1, 2.0), (2, 1, 5, 1, 2.0), (3, 1, 4, 0, 0.5), (3, 1, 5, 3, 0.5)]
    labelled = spark.createDataFrame(rows, "date int, ticker int, k int, cluster int, PC1 double")
    selected = spark.createDataFrame([(5, 3)], "k int, cluster int")
    best = spark.createDataFrame([("PC1", 0.1, 1, 1.0)], "component string, ic double, direction int, threshold double")
    assert {r["date"]: r["raw"] for r in rg.regime_signal(labelled, selected, best, ["PC1"]).collect()} == {1: 1, 2: 0, 3: 0}


def test_principal_components_against_numpy(spark):

    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6))
    names = [f"f{k}" for k in range(6)]
    df = spark.createDataFrame([(k, 1, "train" if k < 200 else "test", *map(float, r)) for k, r in enumerate(x)], "date int, ticker int, phase string, " + ", ".join(f"{n} double" for n in names))
    states, shares = rg.pca_states(df, names)
    z = (x - x[:200].mean(axis=0)) / x[:200].std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z[:200].T))
    assert np.allclose(shares, (values[::-1] / values.sum())[: len(shares)], atol=1e-8)
    got = np.array([[r[f"PC{i + 1}"] for i in range(len(shares))] for r in states.orderBy("date").collect()])
    assert np.allclose(np.abs(got), np.abs(z @ vectors[:, ::-1][:, : len(shares)]), atol=1e-6)


def test_written_tables(spark, tmp_path):

    df = spark.createDataFrame([("2020-01-01", 1, 2.0, 0), ("2021-01-01", 1, None, 1), ("2021-01-02", 2, 3.0, 1)], "date string, ticker int, x double, y int").withColumn("date", F.to_date("date"))
    for form in ("parquet", "csv"):
        tables.write_panel(df, f"{tmp_path}/{form}", form)
        back = spark.read.option("header", True).csv(f"{tmp_path}/csv") if form == "csv" else spark.read.parquet(f"{tmp_path}/parquet")
        assert back.count() == 3 and back.where("year = 2021").count() == 2
    tables.write_evaluation({"summary": df.groupBy("y").count(), "buckets": df}, f"{tmp_path}/ev")
    assert spark.read.json(f"{tmp_path}/ev/summary_json").count() == 2 and spark.read.option("header", True).csv(f"{tmp_path}/ev/buckets").count() == 3
    meta = tables.create_snapshot(df, f"{tmp_path}/s", "ds_2021Q1_v1", filters={"min_price": "1"}, label="y").first()
    assert '"min_price":"1"' in meta["filters"] and '"1":2' in meta["labels"] and '"x":0.33' in meta["missing"]
    assert tables.load_snapshot(spark, f"{tmp_path}/s", "ds_2021Q1_v1").count() == 3


def test_snapshots_are_claimed_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "a int, x double")
    root = str(tmp_path / "snaps")
    assert tables.list_snapshots(spark, root).count() == 0
    assert tables.claim_snapshot(spark, root, "ds_2024Q1_v1")  # a writer that dies here
    assert not tables.claim_snapshot(spark, root, "ds_2024Q1_v1")
    assert tables.create_next_snapshot(df, root, 2024, 1).first()["snapshot_id"] == "ds_2024Q1_v2"
    assert [r["snapshot_id"] for r in tables.list_snapshots(spark, root).collect()] == ["ds_2024Q1_v2"]
    with pytest.raises(FileExistsError):
        tables.create_snapshot(df, root, "ds_2024Q1_v2")
    with pytest.raises(FileNotFoundError):
        tables.load_snapshot(spark, root, "ds_2024Q1_v1")
    df.withColumn("x", F.lit(9.0)).write.mode("overwrite").parquet(f"{root}/data/ds_2024Q1_v2")
    with pytest.raises(ValueError, match="hash"):
        tables.load_snapshot(spark, root, "ds_2024Q1_v2")


def test_concurrent_snapshots_get_numbers_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    df, root = spark.range(5), str(tmp_path / "snaps")
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda _: tables.create_next_snapshot(df, root, 2024, 2).first()["snapshot_id"], range(4)))
    assert sorted(ids) == [f"ds_2024Q2_v{k}" for k in range(1, 5)]
    assert all(tables.load_snapshot(spark, root, i).count() == 5 for i in ids)


def test_keyed_table_keeps_the_last_row_and_survives_a_repeated_batch(spark, tmp_path):
    path, schema = str(tmp_path / "keyed"), "ticker long, ts long, event_id long, price double"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert st.read_keyed(spark, path, batch((0, 0, 0, 0.0)).schema).count() == 0
    merge = lambda rows, k: st.merge_keyed(rows, k, path, ["ticker"], ["ts", "event_id"])
    merge(batch((1, 10, 1, 1.0), (2, 10, 2, 2.0)), 0)
    second = batch((1, 9, 3, 3.0), (2, 11, 4, 4.0), (3, 1, 5, 5.0))
    for _ in range(2):  # the second time as after a failure
        merge(second, 1)
    merge(batch((1, 10, 9, 9.0)), 2)
    got = st.read_keyed(spark, path, second.schema).orderBy("ticker").collect()
    assert [tuple(r) for r in got] == [(1, 10, 9, 9.0), (2, 11, 4, 4.0), (3, 1, 5, 5.0)]
    assert sorted(p.name for p in (tmp_path / "keyed").iterdir()) == ["v1", "v2"]


def test_correlations_against_numpy(spark):
    from factorloom.operators.screening import correlation_matrix, correlations

    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 6)) + 1e3
    x[:, 1] += 3 * x[:, 0]
    x[:, 5] = 7.0
    x[rng.random(x.shape) < 0.2] = np.nan
    names = [f"f{k}" for k in range(6)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r["a"], r["b"]): r for r in correlations(df, names).collect()}
    for i in range(6):
        for j in range(i + 1, 6):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[names[i], names[j]]
            assert r["n"] == both.sum()
            assert r["corr"] is None if j == 5 else r["corr"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-10)
    assert list(correlation_matrix(df, names)) == [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    assert correlation_matrix(df, names[:1]) == {}


def test_screening_takes_factors_in_order(spark):
    from factorloom.operators.screening import screen

    schema = "factor string, ic_mean double, icir_annual double, p_value double, spread_mean double, tau double, tau_p double, psi double, ks_p double"
    rows = [
        ("a", 0.03, 0.6, 0.01, 0.1, 1.0, 0.01, 0.1, 0.5),  # strict
        ("b", -0.03, -0.6, 0.01, -0.1, -1.0, 0.01, 0.3, 0.01),  # strict by size, but too near to a
        ("c", 0.01, 0.2, 0.09, None, None, None, None, None),  # exploratory
        ("d", 0.03, 0.6, 0.10, 0.1, 1.0, 0.20, 0.1, 0.5),  # p is not below either bound
        ("e", 0.02, 0.5, 0.05, 0.0, 0.5, 0.01, 0.25, 0.05),  # p is not below the strict bound: exploratory
        ("f", 0.0, None, None, 0.1, 1.0, 0.01, 0.1, 0.5),  # nothing known
    ]
    corr = {("a", "b"): -0.9, ("b", "c"): 0.99, ("a", "c"): 0.79, ("c", "e"): 0.5, ("d", "e"): 0.95}
    quality = spark.createDataFrame(rows, schema)
    got = {r["factor"]: r for r in screen(quality, corr, list("abcdef")).collect()}
    assert {k: r["tier"] for k, r in got.items()} == {"a": "strict", "b": None, "c": "exploratory", "d": None, "e": "exploratory", "f": None}
    assert {k: r["fail_reasons"] for k, r in got.items()} == {"a": "", "b": "correlation", "c": "", "d": "ic", "e": "", "f": "ic,icir"}
    assert got["b"]["max_correlation"] == 0.9 and got["c"]["max_correlation"] == 0.79 and got["e"]["max_correlation"] == 0.5  # b and d were not accepted
    assert [got[k]["direction"] for k in "abf"] == ["positive", "negative", "positive"]
    assert [got[k]["pass_spread"] for k in "abce"] == [True, False, True, False] and [got[k]["pass_psi"] for k in "ace"] == [True, False, False]
    assert [got[k]["pass_monotonic"] for k in "abcd"] == [True, False, True, False] and [got[k]["pass_ks"] for k in "ace"] == [True, False, False]
    assert [k for k, r in sorted(got.items()) if r["selected"]] == ["a", "c", "e"]
    strict_only = screen(quality, corr, list("abcdef"), fallback=False)
    assert [r["factor"] for r in strict_only.where("selected").collect()] == ["a"]
    last_first = {r["factor"]: r["tier"] for r in screen(quality, corr, list("fedcba")).collect()}
    assert last_first["b"] is None and last_first["a"] == "strict"  # c came before b


@pytest.mark.parametrize("q", [2, 3, 5])
def test_quantile_labels_are_right_closed(spark, q):
    rng = np.random.default_rng(q)
    rows = [(d, t, float(v)) for d in range(6) for t, v in enumerate(rng.integers(0, 4, 12) if d % 2 else rng.standard_normal(12))]
    rows += [(7, t, 1.0) for t in range(9)] + [(8, 0, 1.0), (9, 0, None), (9, 1, 2.0), (9, 2, 3.0)]
    df = frame(spark, rows, "date int, ticker int, r double")
    got = lab.quantile_labels(df, "r", q).toPandas()
    whole = lab.quantile_labels(df, "r", q, per_date=False).toPandas()

    def cut(x):
        return pd.qcut(x, q, labels=False, duplicates="drop") if x.notna().sum() >= q and x.nunique() > 1 else pd.Series(np.nan, x.index)

    for _, g in got.groupby("date"):
        assert np.array_equal(g.label.astype(float), cut(g.r).astype(float), equal_nan=True)
    assert np.array_equal(whole.label.astype(float), cut(whole.r).astype(float), equal_nan=True)


def test_library_of_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "library")
    cand = lambda *rows: spark.createDataFrame(list(rows), "factor string, ic_mean double, icir double, passed boolean")
    assert ev.library_at(spark, root).count() == 0
    assert ev.add_to_library(cand(("a", 0.1, 1.0, True), ("b", 0.2, 1.0, False)), root) == 1
    assert ev.add_to_library(cand(("a", 0.3, 1.0, True)), root) == 0  # not new
    with ThreadPoolExecutor(4) as pool:  # one name by four writers at once, and names of their own
        numbers = list(pool.map(lambda k: ev.add_to_library(cand(("same", 0.5, 1.0, True), (f"own{k}", 0.4, 1.0, True)), root), range(4)))
    assert sorted(numbers) == [2, 3, 4, 5]
    state = {r["factor"]: r for r in ev.library_state(ev.library_at(spark, root)).collect()}
    assert set(state) == {"a", "same", "own0", "own1", "own2", "own3"}
    assert ev.library_at(spark, root).where("factor = 'same'").count() == 1
    assert ev.remove_from_library(cand(("a", 0.0, 0.0, True)).select("factor"), root) == 6
    assert "a" not in [r["factor"] for r in ev.library_report(ev.library_at(spark, root)).collect()]
    assert [r["factor"] for r in ev.library_report(ev.library_at(spark, root, 1)).collect()] == ["a"]


@pytest.mark.parametrize("share", [2, 7])
def test_random_baseline_is_its_loop(spark, share):
    rows = [(t, D[0] + __import__("datetime").timedelta(k), float((k * 37 + t) % 19 - 9) / 100, int(k % share == 0)) for t in range(3) for k in range(60 + 40 * t)]
    rows += [(9, D[0], 0.5, 0)]  # without a signal
    df = frame(spark, rows, "ticker long, date date, ret double, signal int")
    got = {r["ticker"]: r for r in rg.random_baseline(df, sims=30).collect()}
    hashes = df.select("ticker", "date", "ret", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("sim")).withColumn("h", F.xxhash64(F.lit(42), "sim", "date")).toPandas()
    for t, g in df.toPandas().groupby("ticker"):
        n = int(g.signal.sum())
        assert got[t]["n_signals"] == n
        if not n:
            assert got[t]["mean_ret"] is None and got[t]["percentile"] is None
            continue
        mean = g.ret[g.signal == 1].mean()
        sims = [x.nsmallest(n, "h").ret.mean() for _, x in hashes[hashes.ticker == t].groupby("sim")]
        assert got[t]["mean_ret"] == pytest.approx(mean) and got[t]["percentile"] == pytest.approx(np.mean([m < mean - 1e-15 for m in sims]), abs=0.04)


def test_ridge_is_the_closed_form(spark):
    from factorloom.operators import models

    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 3)) * [1, 5, 0.2]
    y = x @ [1.0, -2.0, 3.0] + 4 + rng.standard_normal(300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    model = models.ridge(models.vectors(df, ["a", "b", "c"], "y"), alphas=(30.0,))
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 30 * np.eye(3), xc.T @ yc)
    assert model.coefficients.toArray() == pytest.approx(w, abs=1e-6)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ w, abs=1e-6)


def test_trees_learn_a_step(spark):
    from factorloom.operators import models

    rows = [(float(k % 10), float((k * 7) % 13), 5.0 if k % 10 >= 5 else -5.0) for k in range(600)]
    data = models.vectors(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")
    train, valid = data.where("b < 9"), data.where("b >= 9")
    for model in (models.forest(train, 10, 3), models.boosted(train, valid, 10, 2)):
        error = {r["split"]: r["mae"] for r in models.errors(model, {"train": train, "valid": valid}).collect()}
        assert error["valid"] < 2.0
        assert models.importance_table(spark, model, ["a", "b"]).first()["feature"] == "a"
