"""Ranks, quantiles and two-sample distances of many keys over very many rows.

Rows of a key are cut into pieces of its value range, at sampled boundaries, so a
key's rows sort in as many tasks as it has pieces; what lies before a piece is
a prefix of the pieces' counts, of which there are few.  A boundary value is a
piece of its own: nothing in it needs sorting, so a value that a third of the rows
share is spread over tasks by a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 64  # a power of two; about n / PIECES rows sort in one task
SALTS = 32


def bounds_of(x: str | Column, pieces: int = PIECES) -> Column:
    """Aggregate: ``pieces - 1`` rising boundaries of about equal shares, from a mergeable sketch of bounded size."""
    return F.percentile_approx(x, [k / pieces for k in range(1, pieces)], F.lit(20 * pieces))


def with_piece(df: DataFrame, x: str, bounds: str, into: str = "_piece", pieces: int = PIECES) -> DataFrame:
    """Adds the piece of ``x``: twice the boundaries below it, plus one if it is a boundary (then odd)."""
    steps = F.array(*(F.lit(pieces >> k) for k in range(1, pieces.bit_length())))
    below = lambda at, step: at + F.when(F.get(F.col(bounds), at + step - 1) < F.col(x), step).otherwise(0)
    df = df.withColumn(into, F.aggregate(steps, F.lit(0), below))  # binary search: boundaries below x; unrolled, its code is too long to be compiled
    return df.withColumn(into, 2 * F.col(into) + F.coalesce((F.get(F.col(bounds), F.col(into)) == F.col(x)).cast("int"), F.lit(0)))


def prefix_counts(pieced: DataFrame, keys: list[str], piece: str = "_piece", counts: dict[str, Column] | None = None) -> DataFrame:
    """``keys``, piece, and for each of ``counts`` (default: all rows as ``n``) its number in the piece and, as ``<name>_before``, before it."""
    counts = counts or {"n": F.count(F.lit(1))}
    totals = pieced.groupBy(*keys, piece).agg(*(c.alias(k) for k, c in counts.items()))
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    return totals.withColumns({f"{k}_before": F.coalesce(F.sum(k).over(before), F.lit(0)) for k in counts})


def _bounded(df: DataFrame, x: str, keys: list[str], pieces: int) -> DataFrame:
    """Rows with a value of ``x``, with their key's ``_bounds`` and their ``_piece``."""
    own = df.where(F.col(x).isNotNull())
    bounds = own.groupBy(*keys).agg(bounds_of(x, pieces).alias("_bounds"))
    own = own.join(F.broadcast(bounds), keys) if keys else own.join(F.broadcast(bounds), F.lit(True))
    return with_piece(own, x, "_bounds", pieces=pieces).drop("_bounds")


def rank_within(pieced: DataFrame, x: str, keys: list[str], totals: DataFrame, into: str, piece: str = "_piece") -> DataFrame:
    """``pieced`` with the average rank of ``x`` over all rows of its key, from the ``prefix_counts`` of the pieces."""
    own = totals.select(*keys, piece, F.col("n").alias("_n"), F.col("n_before").alias("_before"))
    rows = pieced.join(F.broadcast(own), [*keys, piece])
    point = F.col(piece) % 2 == 1
    rows = rows.withColumn("_salt", F.when(point, F.pmod(F.xxhash64(*pieced.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    w = Window.partitionBy(*keys, piece, "_salt").orderBy(x)
    inside = (F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2.0  # the count runs to the last equal value
    return rows.withColumn(into, F.col("_before") + F.when(point, (F.col("_n") + 1) / 2.0).otherwise(inside)).drop("_n", "_before", "_salt")


def with_ranks(df: DataFrame, x: str, keys: list[str], into: str = "rank", pieces: int = PIECES) -> DataFrame:
    """Rows of ``df`` with a value of ``x``, and its average rank among all rows of their key."""
    pieced = _bounded(df, x, keys, pieces)
    return rank_within(pieced, x, keys, prefix_counts(pieced, keys), into).drop("_piece")


def exact_quantiles(df: DataFrame, x: str, keys: list[str], shares: list[float], into: str = "q", pieces: int = PIECES) -> DataFrame:
    """``keys`` and the array ``into`` of linearly interpolated quantiles, exact, for all keys and shares together.

    The pieces' counts tell in which piece each wanted order statistic lies; only
    those pieces are read again and sorted.  Nulls do not count.
    """
    pieced = _bounded(df.select(*keys, x), x, keys, pieces)
    totals = prefix_counts(pieced, keys, counts={"n": F.count(F.lit(1)), "least": F.min(x)}).drop("least_before")
    totals = totals.withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("at")) for i, p in enumerate(shares)))).alias("w")
    spots = totals.select(*keys, "_piece", "n", "n_before", "least", wanted).select("*", "w.i", "w.at")
    spots = spots.select("*", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("k"))
    spots = spots.where((F.col("k") >= F.col("n_before")) & (F.col("k") < F.col("n_before") + F.col("n"))).distinct()
    point = F.col("_piece") % 2 == 1
    known = spots.where(point).select(*keys, "i", "at", "k", F.col("least").alias("v"))
    open_ = spots.where(~point)
    pieces_in = F.broadcast(open_.select(*keys, "_piece").distinct())
    order = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(x)) - 1
    sorted_ = pieced.join(pieces_in, [*keys, "_piece"]).select(*keys, "_piece", F.col(x).alias("v"), order.alias("_at"))
    found = sorted_.join(F.broadcast(open_.withColumn("_at", F.col("k") - F.col("n_before"))), [*keys, "_piece", "_at"]).select(*keys, "i", "at", "k", "v")
    both = known.unionByName(found).groupBy(*keys, "i").agg(F.min_by("v", "k").alias("a"), F.max_by("v", "k").alias("b"), F.first("at").alias("at"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return both.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias(into))


def two_sample(rows: DataFrame, keys: list[str], pieces: int = PIECES) -> DataFrame:
    """``keys, n1, n2, ks, r1, ties``: sizes of the sides (``later`` false and true), the largest distance of their distributions
    in ``x``, and the sum of the first side's average ranks among both, and the sum of t ** 3 - t over values that occur t times."""
    counts = _bounded(rows.select(*keys, "x", "later"), "x", keys, pieces).groupBy(*keys, "_piece", "x").agg(
        F.count(F.when(~F.col("later"), 1)).alias("a"), F.count(F.when(F.col("later"), 1)).alias("b")
    )
    totals = prefix_counts(counts, keys, counts={"a": F.sum("a"), "b": F.sum("b")})
    all_ = Window.partitionBy(*keys)
    totals = totals.withColumns({"n1": F.sum("a").over(all_), "n2": F.sum("b").over(all_)}).drop("a", "b")
    past = Window.partitionBy(*keys, "_piece").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.join(F.broadcast(totals), [*keys, "_piece"]).withColumns({"_a": F.col("a_before") + F.sum("a").over(past), "_b": F.col("b_before") + F.sum("b").over(past)})
    gap = F.abs(F.try_divide("_a", "n1") - F.try_divide("_b", "n2"))
    less = F.col("_a") + F.col("_b") - F.col("a") - F.col("b")
    rank = less + (F.col("a") + F.col("b") + 1) / 2.0
    tied = (F.col("a") + F.col("b")).cast("double")
    return run.groupBy(*keys).agg(
        F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(gap).alias("ks"), F.sum(F.col("a") * rank).alias("r1"), F.sum(tied * tied * tied - tied).alias("ties")
    )
