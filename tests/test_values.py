"""Values of operators that SQL does not check: hand-made frames against numpy and plain loops."""

import datetime
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import cross_section as xs
from factorloom.operators import labels, regimes, selection

DAY = datetime.date(2020, 1, 1)


def day(k):
    return DAY + datetime.timedelta(k)


def test_gaussian_labels(spark):
    rng = np.random.default_rng(1)
    rows = [(day(d), t, float(v)) for d in range(3) for t, v in enumerate(rng.integers(0, 20, 40))]
    got = labels.rank_labels(spark.createDataFrame(rows, "date date, ticker int, r double"), "r", "gaussian").toPandas()
    for _, g in got.groupby("date"):
        p = ((g.r.rank() - 1) / (len(g) - 1)).clip(0.001, 0.999)
        assert g.rank_label.tolist() == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-9)


def test_neutralized_without_constant(spark):
    rng = np.random.default_rng(2)
    rows = [(day(d), t, "f", float(rng.standard_normal()), "abc"[t % 3], float(np.exp(rng.standard_normal()))) for d in range(2) for t in range(15)]
    rows += [(day(0), 99, "f", None, "a", 1.0), (day(0), 98, "f", 5.0, "a", -1.0), (day(7), 0, "f", 1.0, "a", 2.0)]
    schema = "date date, ticker int, factor string, value double, industry string, market_cap double"
    got = {(r.date, r.ticker): r.value for r in xs.neutralize(spark.createDataFrame(rows, schema), constant=False).collect()}
    for d in range(2):
        part = [r for r in rows[:30] if r[0] == day(d)]
        a = np.array([[math.log(r[5]), r[4] == "b", r[4] == "c"] for r in part], float)
        y = np.array([r[3] for r in part])
        left = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        assert [got[r[0], r[1]] for r in part] == pytest.approx(left.tolist(), abs=1e-9)
    assert got[day(0), 99] is None and got[day(0), 98] == 5.0 and got[day(7), 0] == 1.0


def test_correlation_filter(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 4))
    x[:, 1] = x[:, 0] * 2 + 0.01 * x[:, 1]  # nearly the first, with more variance
    x[:, 3] = x[:, 2] * 0.5 + 0.001 * x[:, 3]  # nearly the third, with less
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    assert selection.uncorrelated(df, list("abcd"), 0.95) == ["b", "c"]
    assert selection.uncorrelated(df, list("abcd"), 0.999999) == list("abcd")


def test_importances_find_the_feature(spark):
    rows = [(day(k), k % 3, float(k % 7), float(k % 11), float(k % 7 > 3), float(k % 7 > 4)) for k in range(400)]
    df = spark.createDataFrame(rows, "date date, ticker int, a double, b double, r1 double, r5 double")
    found = selection.importances(df, ["a", "b"], ["r1", "r5"], 2, trees=5)
    assert [c for c, _ in found] == ["a", "b"] and sum(v for _, v in found) == pytest.approx(2.0)


@pytest.fixture(scope="module")
def labelled(spark):
    """Two numbers of clusters with returns told by hand."""
    means = {(4, 0): (0.5, 0.4), (4, 1): (0.1, -0.2), (4, 2): (0.0, 0.1), (4, 3): (-0.5, 0.3), (5, 0): (0.01, 0.9), (5, 1): (0.02, 0.0), (5, 2): (0.0, 0.5), (5, 3): (0.0, 0.4), (5, 4): (0.01, 0.3)}
    rows = []
    for (k, c), (train, test) in means.items():
        for phase, m, n in (("train", train, 6), ("test", test, 2 + c)):
            rows += [(k, c, phase, m + (0.01 if i % 2 else -0.01)) for i in range(n - n % 2)]
    return spark.createDataFrame([*rows, (4, 0, "test", None)], "k int, cluster int, phase string, r double"), means


def test_cluster_returns_and_selection(labelled):
    df, means = labelled
    stats = regimes.cluster_returns(df, "r")
    got = {(r.k, r.cluster, r.phase): r for r in stats.collect()}
    for (k, c), (train, test) in means.items():
        assert got[k, c, "train"].mean_ret == pytest.approx(train) and got[k, c, "test"].mean_ret == pytest.approx(test)
        assert got[k, c, "train"].n == 6 and got[k, c, "train"].std_ret == pytest.approx(0.01 * math.sqrt(6 / 5))
        assert got[k, c, "train"].share == pytest.approx(1 / (4 if k == 4 else 5))
    assert [got[4, c, "test"]["rank"] for c in range(4)] == [1, 4, 3, 2]
    assert [got[4, c, "train"]["rank"] for c in range(4)] == [1, 2, 3, 4]
    checked = {r.k: r for r in regimes.validate_clusters(stats, 1.0).collect()}
    assert checked[4].best_cluster == 0 and checked[4].spread == pytest.approx(1.0) and checked[4].validated
    assert checked[5].best_cluster == 1 and checked[5].test_rank == 5 and not checked[5].validated
    assert not any(r.validated for r in regimes.validate_clusters(stats, 3.0).collect())  # the spread is below 0.4 deviations
    ranked = regimes.rank_clusters(stats, regimes.validate_clusters(stats, 1.0))
    order = [(r.k, r.cluster) for r in ranked.orderBy("global_rank").collect()]
    assert order[:4] == [(4, 0), (4, 3), (4, 2), (4, 1)] and order[4] == (5, 0)
    assert [(r.k, r.cluster) for r in regimes.select_clusters(ranked, 2).collect()] == [(4, 0), (4, 3)]
    none = regimes.rank_clusters(stats, regimes.validate_clusters(stats, 3.0))
    assert [(r.k, r.cluster) for r in regimes.select_clusters(none, 1).collect()] == [(5, 0)]  # nothing is validated: the best ranks


def test_state_filter(labelled):
    df, _ = labelled
    got = {r.k: r for r in regimes.state_filter(regimes.cluster_returns(df, "r")).collect()}
    assert (got[4].cluster, got[4].consistent) == (0, True) and got[4].test_ret == pytest.approx(0.4)
    assert got[5].cluster == 1 and got[5].train_ret == pytest.approx(0.02)


def test_cluster_quality_is_that_of_its_labels(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [9, 0], [0, 9], [9, 9]])
    x = np.concatenate([c + rng.standard_normal((30, 2)) for c in centres])
    df = spark.createDataFrame([(k, 1, "test" if k % 5 == 0 else "train", *map(float, r)) for k, r in enumerate(x)], "date int, ticker int, phase string, PC1 double, PC2 double")
    rows, quality = regimes.clusters(df, ["PC1", "PC2"], (4,))
    pdf = rows.toPandas()
    assert pdf.groupby("cluster").date.apply(lambda d: (d // 30).nunique()).tolist() == [1] * 4  # the four heaps
    own = pdf[pdf.phase == "train"]
    p, c = own[["PC1", "PC2"]].to_numpy(), own.cluster.to_numpy()
    within = sum(((p[c == k] - p[c == k].mean(axis=0)) ** 2).sum() for k in range(4))
    total = ((p - p.mean(axis=0)) ** 2).sum()
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    a = np.array([d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1) for i in range(len(p))])
    b = np.array([min(d[i, c == k].mean() for k in range(4) if k != c[i]) for i in range(len(p))])
    q = quality.first()
    assert q.calinski_harabasz == pytest.approx(((total - within) / 3) / (within / (len(p) - 4)), rel=1e-6)
    assert q.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-6)


def test_component_power(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 2))
    r = -x[:, 1] + 0.3 * rng.standard_normal(200)
    df = spark.createDataFrame([(*map(float, v), float(y)) for v, y in zip(x, r, strict=True)] + [(None, 1.0, 1.0), (1.0, 1.0, None)], "PC1 double, PC2 double, r double")
    got = regimes.component_power(df, ["PC1", "PC2"], "r").orderBy("bucket").collect()
    rank = lambda v: np.argsort(np.argsort(v))
    both = np.append(x[:, 1], 1.0), np.append(r, 1.0)  # PC2 has a value in the row without PC1
    assert {g.component for g in got} == {"PC2"} and got[0].ic == pytest.approx(np.corrcoef(rank(both[0]), rank(both[1]))[0, 1])
    edges = np.quantile(both[0], [0.2, 0.4, 0.6, 0.8])
    bucket = (edges[None] <= both[0][:, None]).sum(axis=1) + 1
    assert [(g.bucket, g.n) for g in got] == [(k, int((bucket == k).sum())) for k in range(1, 6)]
    assert [g.mean_ret for g in got] == pytest.approx([both[1][bucket == k].mean() for k in range(1, 6)])


def test_placebo_labels(spark):
    rng = np.random.default_rng(6)
    rows = [(day(d), t, float(rng.standard_normal()), 0.0, 0.0) for d in range(40) for t in range(30)]
    df = spark.createDataFrame(rows, "date date, ticker int, state double, ret double, fwd double")
    df = df.withColumns({"fwd": F.col("state") * 2, "ret": -F.col("state")})
    got = {r.label: r.ic for r in regimes.placebo_labels(df, "state").collect()}
    assert got["future"] == pytest.approx(1.0) and got["current"] == pytest.approx(-1.0)
    assert abs(got["past"]) < 0.15 and abs(got["random"]) < 0.15


def test_held_signal_is_its_loop(spark):
    rng = np.random.default_rng(7)
    rows = [(day(d), t, int(rng.random() < 0.2)) for t in range(3) for d in range(50)]
    got = {(r.ticker, r.date): r.signal for r in regimes.held_signal(spark.createDataFrame(rows, "date date, ticker int, raw int"), "raw").collect()}
    for t in range(3):
        until = 0
        for k, on in enumerate(r[2] for r in rows if r[1] == t):
            if k >= until and on:
                until = k + 3
            assert got[t, day(k)] == int(k < until)


def test_threshold_grid_is_its_loop(spark):
    rng = np.random.default_rng(8)
    rows = [(day(d), t, "train" if d < 30 else "test", float(v) if v > -1.5 else None, float(rng.standard_normal())) for t in range(2) for d, v in enumerate(rng.standard_normal(50))]
    got = {(r["quantile"], r.hold): r for r in regimes.threshold_grid(spark.createDataFrame(rows, "date date, ticker int, phase string, x double, ret double"), "x").collect()}
    assert len(got) == 12
    strength = [r[3] or 0.0 for r in rows if r[2] == "train"]
    for (q, hold), r in got.items():
        cut = np.quantile(strength, q)
        for phase in ("train", "test"):
            total, on_rows, n = 0.0, 0, 0
            for t in range(2):
                part = [x for x in rows if x[1] == t and x[2] == phase]
                signal = [int((x[3] or 0.0) >= cut) for x in part]
                kept = list(signal)
                for i, on in enumerate(signal):
                    for j in range(2, hold + 1):
                        if on and i + j < len(kept):
                            kept[i + j] = 1
                left = 0
                for on, x in zip(kept, part, strict=True):
                    if not left and on:
                        left = hold
                    if left:
                        total, left = total + x[4], left - 1
                on_rows, n = on_rows + sum(kept), n + len(kept)
            assert r[f"{phase}_return"] == pytest.approx(total) and r[f"{phase}_ratio"] == pytest.approx(on_rows / n)
