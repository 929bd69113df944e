"""Rules whose state lives on from row to row: exponential means and positions that depend on their entry.

Both stay in column expressions.  A linear recurrence is an associative scan; a
position rule is a fold over a ticker's rows, cut into pieces of dates whose end
state is carried to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.windows import wt

PIECE = 128  # rows of a piece: appending a result copies the piece's results so far


def linear_recurrence(df: DataFrame, columns: dict[str, tuple[str, float]], order: Callable = wt) -> DataFrame:
    """``df`` with a column ``y`` for each ``{y: (x, b)}``: y(t) = x(t) + b y(t - 1) along ``order``, null ``x`` as 0.

    The steps x -> x + b y compose, so y follows by doubling: after k rounds each
    row holds the sum over the ``2 ** k`` rows up to it.  A round is a lag in the
    one partitioning and sort of ``order``; rounds end where ``b ** (2 ** k)``
    is below the precision of a double.
    """
    df = df.withColumns({y: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for y, (x, _) in columns.items()})
    step = 1
    while alive := {y: b**step for y, (_, b) in columns.items() if abs(b) ** step > 1e-20}:
        df = df.withColumns({y: F.col(y) + F.lit(a) * F.coalesce(F.lag(y, step).over(order()), F.lit(0.0)) for y, a in alive.items()})
        step *= 2
    return df


def exponential_means(df: DataFrame, spans: dict[str, tuple[str, float]], order: Callable = wt) -> DataFrame:
    """``df`` with a column for each ``{name: (column, span)}``: means with weights falling by 1 - 2 / (span + 1) a row,
    divided by the weights so far; the column has no nulls."""
    decay = {name: 1 - 2 / (span + 1) for name, (_, span) in spans.items()}
    df = linear_recurrence(df.withColumn("_i", F.row_number().over(order())), {name: (x, decay[name]) for name, (x, _) in spans.items()}, order)
    weights = {name: (1 - F.pow(F.lit(b), F.col("_i"))) / (1 - b) for name, b in decay.items()}
    return df.withColumns({name: F.col(name) / w for name, w in weights.items()}).drop("_i")


def fold(panel: DataFrame, columns: list[str], zero: Column, step: Callable[[Column, Column], Column], piece: int = PIECE) -> DataFrame:
    """``date, ticker``, ``columns`` and ``state``: ``step(state, row)`` applied along each ticker's dates, from ``zero``.

    A ticker's rows are shuffled once.  Pieces of ``piece`` rows are sorted arrays;
    an outer fold goes over the pieces and carries the state, an inner one over a
    piece's rows.  ``state`` is a struct with the fields of ``zero``.
    """
    row = F.struct("date", *columns)
    rows = panel.select("ticker", row.alias("row"), F.floor((F.row_number().over(wt()) - 1) / piece).alias("piece"))
    pieces = rows.groupBy("ticker", "piece").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    history = pieces.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("piece", "rows"))).alias("pieces"))
    kind = panel.select(zero.alias("z")).schema["z"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")

    def along_rows(done: Column, part: Column) -> Column:
        begin = F.struct(done["state"].alias("state"), done["done"].alias("done"), none.alias("states"))

        def next_row(acc: Column, r: Column) -> Column:
            made = F.transform(F.array(step(acc["state"], r).cast(kind)), lambda s: F.struct(s.alias("state"), acc["done"].alias("done"), F.array_append(acc["states"], s).alias("states")))
            return made[0]  # the array of one makes the new state once for both of its uses

        return F.aggregate(part["rows"], begin, next_row, lambda acc: F.struct(acc["state"].alias("state"), F.array_append(acc["done"], acc["states"]).alias("done")))

    begin = F.struct(zero.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    states = F.aggregate("pieces", begin, along_rows, lambda acc: F.flatten(acc["done"]))
    rows = F.flatten(F.transform("pieces", lambda p: p["rows"]))
    both = history.select("ticker", rows.alias("row"), states.alias("state")).select("ticker", F.inline(F.arrays_zip("row", "state")))
    return both.select("row.date", "ticker", *(F.col("row")[c].alias(c) for c in columns), "state")


def with_returns(positions: DataFrame) -> DataFrame:
    """``date, ticker, position, ret``: what the position of the row before earns."""
    held = F.coalesce(F.lag("position").over(wt()), F.lit(0))
    ret = F.coalesce(F.col("close") / F.lag("close").over(wt()) - 1, F.lit(0.0))
    return positions.select("date", "ticker", "position", (held * ret).alias("ret"))
