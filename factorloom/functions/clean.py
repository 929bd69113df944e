"""Scalar cleaning of strings, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: markers of a missing value, and multipliers of unit suffixes
NULL_MARKERS = ["", "--", "-", "n/a", "na", "nan", "none", "null", "false"]
UNITS = {"亿": 1e8, "万": 1e4, "k": 1e3, "m": 1e6, "g": 1e9, "b": 1e9}


def _text(x: str | Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.col(x) if isinstance(x, str) else x, ",", "")))


def parse_unit_value(x: str | Column) -> Column:
    """``1.2亿``, ``3万``, ``5k`` to a double; null markers and anything else that is no number to null."""
    text = _text(x)
    number = F.regexp_extract(text, r"^([-+]?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?)(亿|万|k|m|g|b)?$", 1)
    unit = F.regexp_extract(text, r"(亿|万|k|m|g|b)$", 1)
    scale = F.lit(1.0)
    for name, factor in UNITS.items():
        scale = F.when(unit == name, F.lit(factor)).otherwise(scale)
    return F.when(~text.isin(NULL_MARKERS) & (number != ""), number.try_cast("double") * scale)


def parse_percentage(x: str | Column) -> Column:
    """``12.5%`` to 0.125; text without a per cent sign, or with no number before it, to null."""
    text = _text(x)
    return F.when(text.endswith("%"), F.regexp_replace(text, "%", "").try_cast("double") / 100)


def finite(x: str | Column) -> Column:
    """Values that are no number or infinite become null."""
    x = (F.col(x) if isinstance(x, str) else x).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def within_magnitude(x: Column, most: float = 1e9) -> Column:
    """Null where the magnitude exceeds ``most``."""
    return F.when(F.abs(x) <= most, x)


def market_of(ticker: str | Column) -> Column:
    """Market by the first digit: 6, 9 are ``sh``; 0, 3 are ``sz``; others ``bj``."""
    first = F.substring(F.col(ticker).cast("string") if isinstance(ticker, str) else ticker, 1, 1)
    return F.when(first.isin("6", "9"), "sh").when(first.isin("0", "3"), "sz").otherwise("bj")


def suspended(volume: str, amount: str, mode: str = "history") -> Column:
    """``history``: volume and amount are 0; ``realtime``: either is; ``loader``: volume is 0 or missing."""
    v, a = F.col(volume) == 0, F.col(amount) == 0
    found = {"history": v & a, "realtime": v | a, "loader": v | F.col(volume).isNull()}[mode]
    return F.coalesce(found, F.lit(False)).cast("int")


def is_special_treatment(name: str) -> Column:
    return F.coalesce(F.upper(name).contains("ST"), F.lit(False)).cast("int")


def to_local_time(ts: str, zone: str = "Asia/Shanghai") -> Column:
    return F.from_utc_timestamp(ts, zone)


def adjust_prices(df: DataFrame, factor: str, columns: list[str]) -> DataFrame:
    """Adds ``{column}_adj``, each price times the adjustment factor."""
    return df.withColumns({f"{c}_adj": F.col(c) * F.col(factor) for c in columns})


def clean_factors(df: DataFrame, factors: list[str], twins: dict[str, str]) -> DataFrame:
    """Non-finite factor values become null; a factor of ``twins`` goes when its core twin is there."""
    gone = [f for f, core in twins.items() if core in df.columns]
    return df.withColumns({f: finite(f) for f in factors if f not in gone}).drop(*gone)


def announce_dates(reports: DataFrame, indicators: DataFrame, candidates: list[str]) -> DataFrame:
    """First announce date among the candidate columns, the indicators' and the period's; rows without one go.

    ``indicators`` has ``ticker, report_date, indicator_date``.  The period's date is
    the earliest known for the same ``report_date``.
    """
    own = reports.join(indicators.select("ticker", "report_date", "indicator_date"), ["ticker", "report_date"], "left")
    own = own.withColumn("announce_date", F.coalesce(*candidates, "indicator_date"))
    period = F.min("announce_date").over(Window.partitionBy("report_date"))
    return own.withColumn("announce_date", F.coalesce("announce_date", period)).where("announce_date is not null").drop("indicator_date")
