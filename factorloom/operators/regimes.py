"""Regimes by PCA and k-means, regime signals, and checks of a signal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.windows import average_rank, corr_of, wt, wt_last
from factorloom.operators import rules
from factorloom.operators.evaluation import bucket_of
from factorloom.operators.order import exact_quantiles, with_ranks
from factorloom.operators.splits import numbered_dates
from factorloom.sources.scratch import written


def phases(df: DataFrame, train: float = 0.8, purge: int = 5) -> DataFrame:
    """Adds ``phase``: ``train`` up to a purged share of the dates, ``test`` behind it; purged dates go."""
    i, cut = F.col("i"), F.floor(F.col("n") * train)
    phase = F.when(i <= cut - purge, "train").when(i > cut, "test")
    return df.join(F.broadcast(numbered_dates(df).select("date", phase.alias("phase"))), "date").where("phase is not null")


def pca_states(df: DataFrame, columns: list[str], share: float = 0.9) -> tuple[DataFrame, list[float]]:
    """Rows with ``PC1..``, fitted on centred and scaled training rows; the explained shares of the kept components.

    As many components as explain ``share``, but at least max(2, f/6) and at most f/3 (and 2).
    """
    rows = written(df.dropna(subset=columns), "states").withColumn("_v", array_to_vector(F.array(*columns)))
    train = rows.where("phase = 'train'")
    scaler = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(train)
    f = len(columns)
    most = max(2, f // 3)
    model = PCA(k=min(f, most), inputCol="_z", outputCol="_p").fit(scaler.transform(train))
    shares = [float(x) for x in model.explainedVariance.toArray()]
    k = next((i + 1 for i in range(len(shares)) if sum(shares[: i + 1]) >= share), len(shares))
    k = min(len(shares), max(k, 2, f // 6))
    states = model.transform(scaler.transform(rows)).withColumn("_a", vector_to_array("_p"))
    out = states.select(*df.columns, *(F.col("_a")[i].alias(f"PC{i + 1}") for i in range(k)))
    return out, shares[:k]


def clusters(states: DataFrame, components: list[str], ks=(4, 5, 6), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows by ``k`` with ``cluster``, and ``k, silhouette, calinski_harabasz`` on the training rows."""
    rows = written(states, "clustered").withColumn("features", array_to_vector(F.array(*components)))  # read once a model and step
    train, parts, quality = rows.where("phase = 'train'"), [], []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=30).fit(train)
        labelled = model.transform(rows).withColumnRenamed("prediction", "cluster").withColumn("k", F.lit(k))
        parts.append(labelled.drop("features"))
        own = labelled.where("phase = 'train'")
        sil = ClusteringEvaluator(predictionCol="cluster").evaluate(own)
        n, total = own.agg(F.count("*"), sum(F.var_pop(c) * F.count("*") for c in components)).first()
        within = float(model.summary.trainingCost)
        ch = ((total - within) / (k - 1)) / (within / (n - k)) if within > 0 and n > k else float("nan")
        quality.append((k, float(sil), float(ch)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, states.sparkSession.createDataFrame(quality, "k int, silhouette double, calinski_harabasz double")


def cluster_returns(labelled: DataFrame, r: str) -> DataFrame:
    """``k, cluster, phase, n, mean_ret, std_ret, share, rank`` (rank 1 is the best of its k and phase)."""
    rows = labelled.where(F.col(r).isNotNull()).groupBy("k", "cluster", "phase").agg(F.count("*").alias("n"), F.avg(r).alias("mean_ret"), F.stddev_samp(r).alias("std_ret"))
    w = Window.partitionBy("k", "phase")
    return rows.withColumns({"share": F.col("n") / F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("mean_ret"), "cluster"))})


def validate_clusters(stats: DataFrame, global_std: float, least_spread: float = 0.4) -> DataFrame:
    """``k, spread, best_cluster, test_rank, validated``: wide training spread, and its best is in the test's top half."""
    train, test = stats.where("phase = 'train'"), stats.where("phase = 'test'")
    a = train.groupBy("k").agg((F.max("mean_ret") - F.min("mean_ret")).alias("spread"), F.min_by("cluster", "rank").alias("best_cluster"), F.count("*").alias("c"))
    b = test.select("k", F.col("cluster").alias("best_cluster"), F.col("rank").alias("test_rank"))
    ok = (F.col("spread") > least_spread * global_std) & (F.col("test_rank") <= F.ceil(F.col("c") / 2))
    return a.join(b, ["k", "best_cluster"], "left").withColumn("validated", F.coalesce(ok, F.lit(False))).drop("c")


def rank_clusters(stats: DataFrame, validated: DataFrame) -> DataFrame:
    """All test clusters over all k: those of validated k first, then by return."""
    rows = stats.where("phase = 'test'").join(validated.select("k", "validated"), "k")
    w = Window.orderBy(F.desc("validated"), F.desc("mean_ret"), "k", "cluster")  # a row a cluster
    return rows.withColumn("global_rank", F.row_number().over(w))


def select_clusters(ranked: DataFrame, top: int = 3, low: float = 0.1, high: float = 0.6) -> DataFrame:
    """Validated clusters with a share in range and a positive return, best rank first; without any, the best ranks."""
    good = F.col("validated") & F.col("share").between(low, high) & (F.col("mean_ret") > 0)
    rows = ranked.withColumn("_good", good).withColumn("_any", F.bool_or("_good").over(Window.partitionBy()))
    return rows.where(F.col("_good") | ~F.col("_any")).orderBy("global_rank").limit(top).drop("_good", "_any")


def best_component(states: DataFrame, components: list[str], r: str) -> DataFrame:
    """One row ``component, ic, direction``: the largest absolute rank correlation of the lagged state with the return."""
    lagged = states.where("phase = 'train'").select(F.col(r).alias("y"), *(F.lag(c).over(wt()).alias(c) for c in components))
    long = lagged.unpivot(["y"], components, "component", "x").where("x is not null and y is not null")
    rows = with_ranks(with_ranks(long, "x", ["component"], "rx"), "y", ["component"], "ry").groupBy("component").agg(corr_of("rx", "ry").alias("ic"))
    return rows.orderBy(F.desc(F.abs("ic")), "component").limit(1).withColumn("direction", F.signum("ic").cast("int"))


def strength_threshold(states: DataFrame, components: list[str], r: str, share: float = 0.6) -> DataFrame:
    """``best_component`` with ``threshold``: that quantile of the component times its direction on the training rows."""
    long = states.where("phase = 'train'").unpivot(["date", "ticker"], components, "component", "x")
    cuts = exact_quantiles(long, "x", ["component"], [share, 1 - share], "q")
    cuts = cuts.select("component", F.col("q")[0].alias("up"), (-F.col("q")[1]).alias("down"))
    threshold = F.when(F.col("direction") < 0, F.col("down")).otherwise(F.col("up")).alias("threshold")
    return best_component(states, components, r).join(cuts, "component").select("component", "ic", "direction", threshold)


def regime_signal(labelled: DataFrame, selected: DataFrame, best: DataFrame, components: list[str]) -> DataFrame:
    """``date, ticker, raw``: the row is in a selected cluster of any k, and its strength exceeds the threshold.

    ``labelled`` has a row for each k, ``selected`` has ``k, cluster``, ``best`` is ``strength_threshold``'s row.
    """
    marked = labelled.join(F.broadcast(selected.select("k", "cluster", F.lit(1).alias("_in"))), ["k", "cluster"], "left").join(F.broadcast(best), F.lit(True))
    value = F.coalesce(*(F.when(F.col("component") == c, F.col(c)) for c in components))
    on = F.col("_in").isNotNull() & (value * F.col("direction") > F.col("threshold"))
    return marked.groupBy("date", "ticker").agg(F.max(F.coalesce(on, F.lit(False)).cast("int")).alias("raw"))


def component_power(states: DataFrame, components: list[str], r: str, q: int = 5) -> DataFrame:
    """``component, ic, bucket, n, mean_ret``: rank correlation of the first five components, quantile returns of the best."""
    long = states.unpivot([r], components[:5], "component", "x").withColumnRenamed(r, "y").where("x is not null and y is not null")
    ranks = with_ranks(with_ranks(long, "x", ["component"], "rx"), "y", ["component"], "ry")
    best = ranks.groupBy("component").agg(corr_of("rx", "ry").alias("ic")).orderBy(F.desc(F.abs("ic")), "component").limit(1)
    best = best.join(exact_quantiles(long, "x", ["component"], [k / q for k in range(1, q)], "_e"), "component")
    rows = long.join(F.broadcast(best), "component").withColumn("bucket", bucket_of("x", F.col("_e")))
    return rows.groupBy("component", "ic", "bucket").agg(F.count("*").alias("n"), F.avg("y").alias("mean_ret"))


def held_signal(df: DataFrame, raw: str, hold: int = 3) -> DataFrame:
    """Adds ``signal``: a raw signal is held ``hold`` rows, and a new one counts only after that (greedy, per ticker)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        out, until = np.zeros(len(pdf), np.int32), 0
        for k, on in enumerate(pdf[raw].fillna(0).to_numpy()):
            if k >= until and on:
                until = k + hold
            out[k] = k < until
        return pdf.assign(signal=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", signal int"
    return df.groupBy("ticker").applyInPandas(run, schema)


def signal_performance(df: DataFrame, r: str = "ret", cost: float = 0.001, slippage: float = 0.0005, days: int = 250, rf: float = 0.03) -> DataFrame:
    """Per ticker: final equity, flips, round trips, Sharpe, drawdown and win rate of a signal held with a row's delay."""
    held = F.coalesce(F.lag("signal").over(wt()), F.lit(0))
    rows = df.withColumn("_h", held).withColumn("_flip", F.abs(F.col("_h") - F.coalesce(F.lag("_h").over(wt()), F.lit(0))))
    rows = rows.withColumn("net", F.col("_h") * F.coalesce(r, F.lit(0.0)) - F.col("_flip") * (cost + slippage))
    past = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("equity", F.product(1 + F.col("net")).over(past))
    rows = rows.withColumn("drawdown", F.try_divide("equity", F.max("equity").over(past)) - 1)
    return rows.groupBy("ticker").agg(
        F.max_by("equity", "date").alias("final_equity"), F.sum("_flip").alias("flips"), F.floor(F.sum("_flip") / 2).alias("roundtrips"),
        (F.try_divide(F.avg("net") - rf / days, F.stddev_pop("net")) * days**0.5).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col("_h") == 1, (F.col("net") > 0).cast("double"))).alias("win_rate"),
    )


SPARE_DEVIATIONS = 8  # of the number of hashes below a threshold


def random_baseline(df: DataFrame, r: str = "ret", sims: int = 100, seed: int = 42) -> DataFrame:
    """``ticker, n_signals, mean_ret, percentile`` of a signal against as many random dates in each simulation.

    A simulation takes the dates with the smallest hashes of its number and the
    date.  Hashes are spread evenly, so of a ticker's n dates the k smallest lie
    below k / n and a few deviations more: only those dates enter the simulation's
    sort.  Where fewer than k do after all, which has a chance below 1e-14, that
    simulation is left out of the ticker's percentile.
    """
    rows = df.where(F.col(r).isNotNull())
    own = rows.groupBy("ticker").agg(F.sum("signal").alias("n_signals"), F.avg(F.when(F.col("signal") == 1, F.col(r))).alias("mean_ret"), F.count("*").alias("_n"))
    share = F.col("n_signals") / F.col("_n")
    below = F.least(F.lit(1.0), share + SPARE_DEVIATIONS * F.sqrt(share * (1 - share) / F.col("_n")) + F.lit(SPARE_DEVIATIONS) / F.col("_n"))
    known = rows.select("ticker", "date", F.col(r).alias("r")).join(own.select("ticker", "n_signals", below.alias("below")), "ticker")
    near = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(sims)), lambda sim: F.struct(sim.alias("sim"), F.xxhash64(F.lit(seed), sim, F.col("date")).alias("h"))),
        lambda s: s["h"] < (F.col("below") - 0.5) * 2.0**64,
    )
    many = known.where("n_signals > 0").select("ticker", "date", "r", "n_signals", F.inline(near))
    w = Window.partitionBy("ticker", "sim").orderBy("h")
    picked = many.withColumn("_k", F.row_number().over(w)).where("_k <= n_signals")
    means = picked.groupBy("ticker", "sim").agg(F.avg("r").alias("m"), F.count("*").alias("k"), F.max("n_signals").alias("_s")).where("k = _s").drop("k", "_s")
    out = own.join(means, "ticker", "left").groupBy("ticker", "n_signals", "mean_ret")
    return out.agg(F.avg((F.col("m") < F.col("mean_ret")).cast("double")).alias("percentile"))


# ---- checks of a signal


def leak_check(df: DataFrame, r: str = "fwd") -> DataFrame:
    """One row: correlation of the lagged signal with the future return, follow ratio, and both halves' correlation."""
    i = F.row_number().over(wt())
    rows = df.withColumns({"x": F.lag("signal").over(wt()).cast("double"), "_i": i, "_n": F.count("*").over(Window.partitionBy("ticker"))})
    rows = rows.where(F.col("x").isNotNull() & F.col(r).isNotNull()).withColumn("y", F.col(r))
    for h, test in (("first", F.col("_i") * 2 <= F.col("_n")), ("second", F.col("_i") * 2 > F.col("_n"))):
        rows = rows.withColumns({f"x_{h}": F.when(test, F.col("x")), f"y_{h}": F.when(test, F.col("y"))})
    return rows.agg(
        corr_of("x", "y").alias("corr"), F.avg(F.when(F.col("x") > 0, (F.col("y") > 0).cast("double"))).alias("follow_ratio"),
        corr_of("x_first", "y_first").alias("corr_first"), corr_of("x_second", "y_second").alias("corr_second"),
    )


def placebo_labels(df: DataFrame, x: str, r: str = "fwd", seed: int = 7) -> DataFrame:
    """``label, ic`` of a state against future, past, current and random returns (rank correlation by date, averaged)."""
    rows = df.select(
        "date", F.col(x).alias("x"), F.col(r).alias("future"), F.lag("ret", 5).over(wt()).alias("past"), F.col("ret").alias("current"),
        (F.pmod(F.xxhash64(F.lit(seed), "date", "ticker"), F.lit(1_000_003)) / 1_000_003.0).alias("random"),
    )
    long = rows.unpivot(["date", "x"], ["future", "past", "current", "random"], "label", "y").where("x is not null and y is not null")
    long = long.withColumns({"rx": average_rank("x", ["label", "date"]), "ry": average_rank("y", ["label", "date"])})
    return long.groupBy("label", "date").agg(corr_of("rx", "ry").alias("ic")).groupBy("label").agg(F.avg("ic").alias("ic"))


def cost_scenarios(df: DataFrame, r: str = "ret", scenarios=((0.0, 0.0), (0.001, 0.0005), (0.002, 0.001), (0.003, 0.002))) -> DataFrame:
    """``cost, slippage, gross, trades, net``: the sums over all tickers under each scenario."""
    held = F.coalesce(F.lag("signal").over(wt()), F.lit(0))
    rows = df.withColumn("_h", held).withColumn("_flip", F.abs(F.col("_h") - F.coalesce(F.lag("_h").over(wt()), F.lit(0))))
    total = rows.agg(F.sum(F.col("_h") * F.coalesce(r, F.lit(0.0))).alias("gross"), F.sum("_flip").alias("trades"))
    table = F.explode(F.array(*(F.struct(F.lit(c).alias("cost"), F.lit(s).alias("slippage")) for c, s in scenarios))).alias("p")
    return total.select("gross", "trades", table).select("p.cost", "p.slippage", "gross", "trades", (F.col("gross") - F.col("trades") * (F.col("p.cost") + F.col("p.slippage"))).alias("net"))


def ranking_power(df: DataFrame, x: str, r: str = "fwd", q: int = 5) -> DataFrame:
    """``bucket, n, mean_ret`` of the state's quantiles over all rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(r).isNotNull())
    edges = exact_quantiles(rows, x, [], [k / q for k in range(1, q)], "_e")
    return rows.join(F.broadcast(edges), F.lit(True)).withColumn("bucket", bucket_of(x, F.col("_e"))).groupBy("bucket").agg(F.count("*").alias("n"), F.avg(r).alias("mean_ret"))


def state_filter(stats: DataFrame, least: float = 0.05) -> DataFrame:
    """``k, cluster, train_ret, test_ret, consistent`` of each k's best training cluster with enough rows."""
    best = stats.where((F.col("phase") == "train") & (F.col("share") >= least)).groupBy("k").agg(F.max_by("cluster", "mean_ret").alias("cluster"), F.max("mean_ret").alias("train_ret"))
    test = stats.where("phase = 'test'").select("k", "cluster", F.col("mean_ret").alias("test_ret"))
    return best.join(test, ["k", "cluster"], "left").withColumn("consistent", F.signum("train_ret") == F.signum("test_ret"))


def threshold_grid(df: DataFrame, x: str, r: str = "ret", quantiles=(0.6, 0.7, 0.8, 0.9), holds=(1, 3, 5)) -> DataFrame:
    """``quantile, hold, train_return, test_return, train_ratio, test_ratio``: sums of returns while held, shares of rows with a signal.

    A signal is a state (missing: 0) at or above the training rows' quantile, and
    reaches on to the rows 2 to ``hold`` after it.  A position opens on a signal,
    earns ``hold`` rows and is closed; then the next signal may open one.  All cells
    of the grid are one array: a row's signals, and the rows that each cell's
    position still has to run, in one fold per ticker and part.
    """
    cells = [(i, h) for i in range(len(quantiles)) for h in holds]
    state = F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    rows = df.where("phase in ('train', 'test')").select("date", F.struct("ticker", "phase").alias("ticker"), state.alias("x"), F.coalesce(F.col(r).cast("double"), F.lit(0.0)).alias("r"))
    cuts = exact_quantiles(rows.where("ticker.phase = 'train'"), "x", [], list(quantiles), "_c")
    rows = rows.join(F.broadcast(cuts), F.lit(True))
    rows = rows.withColumn("_on", F.transform("_c", lambda c: (F.col("x") >= c).cast("int"))).drop("_c")
    ahead = {h: F.collect_list("_on").over(wt().rowsBetween(-h, -2)) for h in holds if h > 1}
    rows = rows.withColumns({f"_p{h}": c for h, c in ahead.items()})

    def signal(i: int, h: int) -> Column:
        own = F.get("_on", F.lit(i))
        return own if h == 1 else F.greatest(own, F.exists(f"_p{h}", lambda before: F.get(before, F.lit(i)) == 1).cast("int"))

    rows = rows.withColumn("on", F.array(*(signal(i, h) for i, h in cells)))
    hold = F.array(*(F.lit(h) for _, h in cells))

    def step(state: Column, row: Column) -> Column:
        left = F.transform(F.arrays_zip(state["left"], row["on"].alias("on"), hold.alias("hold")), lambda c: F.when(c["left"] > 1, c["left"] - 1).when(c["on"] == 1, c["hold"]).otherwise(0))
        return F.struct(left.alias("left"))

    none = F.struct(F.array(*(F.lit(0) for _ in cells)).alias("left"))
    run = rules.fold(rows, ["r", "on"], none, step)  # a cell's number counts the rows it has left, this one included
    each = F.posexplode(F.arrays_zip(F.col("state.left").alias("left"), F.col("on").alias("on"))).alias("cell", "c")
    sums = run.select(F.col("ticker.phase").alias("phase"), "r", each).groupBy("cell").agg(
        *(F.sum(F.when((F.col("phase") == p) & (F.col("c.left") > 0), F.col("r")).otherwise(0.0)).alias(f"{p}_return") for p in ("train", "test")),
        *(F.avg(F.when(F.col("phase") == p, F.col("c.on").cast("double"))).alias(f"{p}_ratio") for p in ("train", "test")),
    )
    at = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("cell") + 1)
    return sums.select(at([quantiles[i] for i, _ in cells]).alias("quantile"), at([h for _, h in cells]).alias("hold"), "train_return", "test_return", "train_ratio", "test_ratio")


def yearly(df: DataFrame, r: str = "ret") -> DataFrame:
    """``year, n, mean_ret, signal_ret, better``: does the signal beat the year's mean?"""
    s = F.avg(F.when(F.col("_h") > 0, F.col(r)))
    rows = df.withColumn("_h", F.coalesce(F.lag("signal").over(wt()), F.lit(0)))
    out = rows.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.avg(r).alias("mean_ret"), s.alias("signal_ret"))
    return out.withColumn("better", F.col("signal_ret") > F.col("mean_ret"))


def volatility_state(panel: DataFrame, n: int = 20) -> DataFrame:
    """``state``: the ticker's volatility against its own mean, a simple regime input."""
    v = F.stddev_samp("ret").over(wt_last(n))
    return panel.withColumn("_v", v).withColumn("state", F.try_divide("_v", F.avg("_v").over(wt().rowsBetween(Window.unboundedPreceding, 0)))).drop("_v")
