"""Drift of features, information coefficients and spreads between the parts of a time split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.tests import p_of_ks, p_of_normal, p_of_t
from factorloom.functions.windows import near
from factorloom.operators.evaluation import psi
from factorloom.operators.order import two_sample
from factorloom.operators.splits import numbered_dates

SPLITS = ("train", "valid", "test")


def with_split(df: DataFrame, train: float = 0.6, valid: float = 0.2) -> DataFrame:
    i, n = F.col("i"), F.col("n")
    split = F.when(i <= F.floor(n * train), "train").when(i <= F.floor(n * round(train + valid, 12)), "valid").otherwise("test")
    return df.join(F.broadcast(numbered_dates(df).select("date", split.alias("split"))), "date")


def feature_drift(long: DataFrame, threshold: float = 0.2) -> DataFrame:
    """``factor, psi_valid, psi_test, drifted``; ``long`` has ``factor, value, split``."""
    parts = []
    for other in ("valid", "test"):
        rows = long.where(F.col("split").isin("train", other)).select("factor", F.col("value").alias("x"), (F.col("split") == other).alias("later"))
        parts.append(psi(rows, ["factor"], smooth="add_one").withColumnRenamed("psi", f"psi_{other}"))
    out = parts[0].join(parts[1], "factor", "outer")
    return out.withColumn("drifted", F.greatest("psi_valid", "psi_test") > threshold)


def _compared(rows: DataFrame, keys: list[str], metrics: dict[str, Column], threshold: float) -> DataFrame:
    """``keys, metric, train, valid, test``, the three changes relative to the training part, and ``drifted``: null where
    the training value is 0 or missing."""
    by_split = rows.groupBy(*keys, "split").agg(*(c.alias(m) for m, c in metrics.items())).unpivot([*keys, "split"], list(metrics), "metric", "v")
    wide = by_split.groupBy(*keys, "metric").pivot("split", list(SPLITS)).agg(F.first("v"))
    base = F.when(F.col("train") != 0, F.abs("train"))
    change = lambda a, b: F.abs(F.col(a) - F.col(b)) / base
    wide = wide.withColumns({"valid_vs_train": change("valid", "train"), "test_vs_train": change("test", "train"), "valid_vs_test": change("valid", "test")})
    return wide.withColumn("drifted", F.col("valid_vs_test") > threshold)


def compare_ic(ic: DataFrame, keys: list[str], threshold: float = 0.5, per_year: int = 252) -> DataFrame:
    """Mean, deviation, ICIR, annual ICIR and positive share of ``ic`` between the splits."""
    x, ratio = F.col("ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic"))
    metrics = {"mean": F.avg(x), "std": F.stddev_samp(x), "icir": ratio, "icir_annual": ratio * math.sqrt(per_year), "positive_ratio": F.avg((x > 1e-12).cast("double"))}
    return _compared(ic, keys, metrics, threshold)


def compare_spreads(spreads: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Mean, Sharpe ratio and positive share of ``spread`` between the splits."""
    x = F.col("spread")
    metrics = {"mean": F.avg(x), "sharpe": F.try_divide(F.avg(x), F.stddev_samp(x)), "positive_ratio": F.avg((x > 0).cast("double"))}
    return _compared(spreads.where("spread is not null"), keys, metrics, threshold)


def compare_series(rows: DataFrame, keys: list[str], least: int = 5, p: bool = True) -> DataFrame:
    """Two-sample t, Mann-Whitney (with ties) and Kolmogorov-Smirnov tests of ``x`` by ``later``; each side needs ``least`` values.

    All three come from sums that merge: moments, and counts by value in pieces of its range.
    """
    side = lambda flag, fn: fn(F.when(F.col("later") == flag, F.col("x")))
    moments = rows.groupBy(*keys).agg(side(False, F.avg).alias("m1"), side(True, F.avg).alias("m2"), side(False, F.var_samp).alias("v1"), side(True, F.var_samp).alias("v2"))
    s = two_sample(rows, keys).join(moments, keys).where((F.col("n1") >= least) & (F.col("n2") >= least))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    pooled = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n - 2)
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / n1 + 1 / n2)))
    u = F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = F.when(var > 0, F.greatest((F.abs(u - n1 * n2 / 2) - 0.5) / F.sqrt(var), F.lit(0.0)))
    out = s.withColumns({"t_stat": t, "z_stat": z, "df": n - 2}).select(*keys, "n1", "n2", "t_stat", "df", u.alias("u_stat"), "z_stat", "ks")
    if not p:
        return out.drop("df")
    out = out.withColumns({"p_t": p_of_t("t_stat", "df"), "p_mann_whitney": p_of_normal("z_stat"), "p_ks": p_of_ks("ks", "n1", "n2")})
    return out.drop("df")


def drift_report(
    ic: DataFrame, spreads: DataFrame, threshold: float = 0.5, significance: float = 0.05, train: float = 0.6, valid: float = 0.2, keys=("factor", "ret")
) -> DataFrame:
    """A row for each factor and return: changes of the IC's mean and ICIR and of the mean spread from the validation to the
    test part, the Kolmogorov-Smirnov test of the ICs of the two, and ``passed``: none of the three changed beyond ``threshold``."""
    keys = list(keys)
    ic, spreads = with_split(ic, train, valid), with_split(spreads.where("spread is not null"), train, valid)
    ics = compare_ic(ic, keys, threshold).where("metric in ('mean', 'icir')")
    parts = ics.groupBy(*keys).pivot("metric", ["mean", "icir"]).agg(F.first("valid_vs_test").alias("change"), F.first("drifted").alias("drifted"))
    parts = parts.select(*keys, F.col("mean_change").alias("ic_change"), "icir_change", F.col("mean_drifted").alias("ic_drifted"), "icir_drifted")
    sp = compare_spreads(spreads, keys, threshold).where("metric = 'mean'").select(*keys, F.col("valid_vs_test").alias("spread_change"), F.col("drifted").alias("spread_drifted"))
    later = ic.where("split <> 'train'").select(*keys, near("ic", 9).alias("x"), (F.col("split") == "test").alias("later"))  # ties are told to nine digits
    tests = compare_series(later, keys).select(*keys, F.col("ks").alias("ic_ks"), F.col("p_ks").alias("ic_ks_p"), (F.col("p_ks") < significance).alias("significant"))
    out = parts.join(sp, keys, "full").join(tests, keys, "left")
    drifted = [F.coalesce(c, F.lit(False)) for c in ("ic_drifted", "icir_drifted", "spread_drifted")]
    return out.withColumn("passed", ~(drifted[0] | drifted[1] | drifted[2]))
