"""Correlations of many factors, and screening of factors in two tiers with correlation to those accepted before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = "a int, b int, n double, sx double, sy double, qx double, qy double, p double"


def correlations(wide: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, n, corr`` of all pairs in column order (``a`` before ``b``), over the rows that have both; null if either is constant there.

    Every task sums up products of whole blocks of rows (values, squares and marks
    of presence, about the columns' means), so a row is read once whatever the
    number of columns; the sums of a pair meet in one small shuffle.
    """
    own = wide.select(*(F.col(c).cast("double").alias(c) for c in columns))
    centre = np.array([m or 0.0 for m in own.agg(*(F.avg(c) for c in columns)).first()])
    i, j = np.triu_indices(len(columns), 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch.to_numpy(float) - centre
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype(float)
            s, q = x.T @ m, (x * x).T @ m
            part = np.array([(m.T @ m)[i, j], s[i, j], s[j, i], q[i, j], q[j, i], (x.T @ x)[i, j]])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"a": i.astype("int32"), "b": j.astype("int32"), **dict(zip(("n", "sx", "sy", "qx", "qy", "p"), total, strict=True))})

    met = own.mapInPandas(sums, SUMS).groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "qx", "qy", "p")))
    vx, vy = F.col("qx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("qy") - F.col("sy") * F.col("sy") / F.col("n")
    least = 1e-14  # of the squares: below that a column varies by rounding alone
    corr = F.when((vx > least * F.col("qx")) & (vy > least * F.col("qy")), (F.col("p") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    name = lambda k: F.element_at(F.array(*map(F.lit, columns)), F.col(k) + 1)
    out = met.where("n > 0").select(name("a").alias("a"), name("b").alias("b"), F.col("n").cast("long").alias("n"), corr.alias("corr"))
    return out


def correlation_matrix(wide: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """``correlations`` as a table of pairs on the driver; its size is that of the list of columns, squared."""
    if len(columns) < 2:
        return {}
    found = {(r.a, r.b): r["corr"] for r in correlations(wide, columns).collect()}
    return {(a, b): found.get((a, b)) for i, a in enumerate(columns) for b in columns[i + 1 :]}


def decorrelate(corr: dict[tuple[str, str], float | None], columns: list[str], candidates: set[str], most: float = 0.8) -> dict[str, float]:
    """The largest absolute correlation of each column with those accepted before it, in the given order.

    A candidate is accepted if that is below ``most``; others are measured, but never accepted.
    """
    accepted: list[str] = []
    found = {}
    for c in columns:
        found[c] = max((abs(corr.get((k, c), corr.get((c, k))) or 0.0) for k in accepted), default=0.0)
        if c in candidates and found[c] < most:
            accepted.append(c)
    return found


STRICT, EXPLORATORY = (0.02, 0.5, 0.05), (0.005, 0.15, 0.10)  # least |IC|, least |annual ICIR|, p below


def screening_flags(quality: DataFrame, strict=STRICT, exploratory=EXPLORATORY, spread: float = 0.0, psi: float = 0.25, use_abs: bool = True) -> DataFrame:
    """``quality`` (``factor, ic_mean, icir_annual, p_value, spread_mean, tau, tau_p, psi, ks_p``) with the checks that need no other factor.

    Missing ICs, p values, PSI and KS fail; a missing spread or tau passes.
    """
    size = (lambda c: F.abs(F.col(c))) if use_abs else F.col

    def sure(check: Column, otherwise: bool = False) -> Column:
        return F.coalesce(check, F.lit(otherwise))

    made = {"direction": F.when(F.col("ic_mean") >= 0, "positive").when(F.col("ic_mean") < 0, "negative")}
    for name, (ic, icir, p) in (("strict", strict), ("explore", exploratory)):
        made[f"pass_ic_{name}"] = sure((size("ic_mean") >= ic) & (F.col("p_value") < p))
        made[f"pass_icir_{name}"] = sure(size("icir_annual") >= icir)
    made["pass_spread"] = sure(F.col("spread_mean") > spread, True)
    made["pass_monotonic"] = F.when(F.col("tau").isNull(), True).otherwise(sure((F.col("tau") > 0) & (F.col("tau_p") < 0.05)))
    made["pass_psi"], made["pass_ks"] = sure(F.col("psi") < psi), sure(F.col("ks_p") > 0.05)
    return quality.withColumns(made)


def screen(quality: DataFrame, corr: dict[tuple[str, str], float | None], order: list[str], most: float = 0.8, fallback: bool = True, **bounds) -> DataFrame:
    """``screening_flags`` with ``max_correlation``, both tiers' verdicts, ``tier``, ``fail_reasons`` and ``selected``.

    Factors are taken in ``order`` (that of their making): each is compared with
    those accepted before, in either tier.  ``selected`` are the strict ones, with
    ``fallback`` the exploratory ones as well.  There is a row a factor, so the
    acceptance runs on the driver.
    """
    flags = screening_flags(quality, **bounds)
    base = flags.select("factor", ((F.col("pass_ic_strict") & F.col("pass_icir_strict")) | (F.col("pass_ic_explore") & F.col("pass_icir_explore"))).alias("ok"))
    found = decorrelate(corr, order, {r.factor for r in base.where("ok").collect()}, most)
    spark = quality.sparkSession
    measured = spark.createDataFrame([(c, k, float(v)) for k, (c, v) in enumerate(found.items())], "factor string, made int, max_correlation double")
    out = flags.join(F.broadcast(measured), "factor").withColumn("pass_correlation", F.col("max_correlation") < most)
    out = out.withColumns({f"{tier}_pass": F.col(f"pass_ic_{tier}") & F.col(f"pass_icir_{tier}") & F.col("pass_correlation") for tier in ("strict", "explore")})
    reasons = (("ic", "pass_ic_explore"), ("icir", "pass_icir_explore"), ("correlation", "pass_correlation"))
    why = F.when(F.col("explore_pass"), "").otherwise(F.concat_ws(",", *(F.when(~F.col(c), name) for name, c in reasons)))
    return out.withColumns(
        {
            "tier": F.when(F.col("strict_pass"), "strict").when(F.col("explore_pass"), "exploratory"), "fail_reasons": why,
            "selected": F.col("strict_pass") | (F.lit(fallback) & F.col("explore_pass")),
        }
    )
