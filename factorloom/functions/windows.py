"""Window frames and rolling expressions with pandas' null rule: a window of n needs n non-null values."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def wt():
    """All rows of a ticker in date order."""
    return Window.partitionBy("ticker").orderBy("date")


def wt_last(n: int):
    """The last ``n`` rows of a ticker."""
    return wt().rowsBetween(-(n - 1), 0)


def wt_past():
    """All rows of a ticker up to this one."""
    return wt().rowsBetween(Window.unboundedPreceding, 0)


def wd(*more: str):
    """All rows of a date (and of further keys)."""
    return Window.partitionBy("date", *more)


def rolling(fn, x: str | Column, n: int, least: int | None = None) -> Column:
    """``fn(x)`` over the last ``n`` rows; null unless ``least`` (default ``n``) of them have a value."""
    w = wt_last(n)
    return F.when(F.count(x).over(w) >= (least or n), fn(x).over(w))


def skew_of(x: Column | str, over) -> Column:
    """Bias-corrected skewness over a window (n >= 3)."""
    n = F.count(x).over(over)
    return F.when(n >= 3, F.sqrt(n * (n - 1.0)) / (n - 2) * F.skewness(x).over(over))


def kurt_of(x: Column | str, over) -> Column:
    """Bias-corrected excess kurtosis over a window (n >= 4)."""
    n = F.count(x).over(over)
    return F.when(n >= 4, (n - 1.0) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(over) + 6))


def corr_of(x: str, y: str, over=None) -> Column:
    """Pearson correlation of rows that have both values; null where either is constant (``corr`` would fail)."""
    x, y = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    parts = F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)
    c, a, b = (p.over(over) for p in parts) if over is not None else parts
    return F.when((a > 0) & (b > 0), F.try_divide(c, a * b))


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank of ``x`` within ``keys`` with ties averaged; the null rows of ``x`` should be filtered before."""
    w = Window.partitionBy(*keys).orderBy(x)
    return (F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2.0  # the count runs to the last equal value: one window for both


def forward_filled(x: str) -> Column:
    """The last non-null value of the ticker."""
    return F.last(x, ignorenulls=True).over(wt_past())


def near(x: Column | str, digits: int = 6) -> Column:
    """Cut to ``digits`` for comparison between engines.

    Engines round exact halves differently, and prices here have many; so about a third
    of a unit is added before rounding, and the boundaries lie where no exact
    values are.  Adding zero removes a negative zero.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + F.lit(0.31415926 * 10.0**-digits), digits) + F.lit(0.0)
