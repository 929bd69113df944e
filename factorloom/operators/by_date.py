"""Cross-sections scored a date at a time: cleaning, rank correlations and bucket means of all factors and returns in one shuffle.

A date's rows meet in one task, as they do in windows by date, and stay columns:
each column is sorted once, whatever the number of pairs it is in.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators import decay
from factorloom.operators.decay import NULL, piece_of, sortable

PAIRS = "factor string, ret string, n long, ic double, buckets array<struct<bucket: int, mean_ret: double, n: long>>, cleaned binary"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.struct([("bucket", pa.int32()), ("mean_ret", pa.float64()), ("n", pa.int64())])), pa.binary()]


def _percentiles(rising: np.ndarray, shares: list[float]) -> np.ndarray:
    """Linearly interpolated, by the formula of Spark's ``percentile``."""
    at = (len(rising) - 1) * np.array(shares)
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    a, b = rising[low], rising[high]
    with np.errstate(invalid="ignore"):
        return np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b)


def _winsorized_scores(x: np.ndarray, order: np.ndarray, low: float, high: float) -> np.ndarray:
    """``standardize(winsorize())`` of a date's values; ``order`` sorts those that are there."""
    if len(order) < 3:
        return x
    a, b = _percentiles(x[order], [low, high])
    x = np.where(np.isnan(x), b, np.minimum(np.maximum(x, a), b))  # one that is no number is above all others
    own = x[order]
    s = 0.0 if own[0] == own[-1] else own.std(ddof=1)
    return (x - own.mean()) / s if s > 0 else x * 0


def _centred_ranks(keys: np.ndarray) -> np.ndarray:
    """Average ranks of rising ``keys`` less their mean."""
    first = np.append(True, keys[1:] != keys[:-1])
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(keys))
    return ((starts + ends - len(keys)) / 2.0)[np.cumsum(first) - 1]


def scored(wide: DataFrame, factors: list[str], returns: list[str], q: int = 5, clean: tuple[float, float] | None = None) -> DataFrame:
    """``date`` and ``PAIRS``: a row a date, factor and return, over the rows that have both; ``wide`` has a row a date and ticker.

    ``buckets`` are those of ``quantile_returns``, null where there are fewer rows
    than buckets.  ``clean`` are the shares for ``winsorize``, before ``standardize``
    on all values of a date; ``cleaned`` are then those values, as doubles.
    """
    cells = [F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate([*factors, *returns])]
    shares = [k / q for k in range(1, q)]

    def score(key, table):
        values, keys, orders = [], [], []
        for k in range(len(factors) + len(returns)):
            column = table.column(f"c{k}").combine_chunks()
            v = column.to_numpy(zero_copy_only=False).astype(float, copy=False)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            for step in range(1 + (clean is not None and k < len(factors))):
                s = np.where(there, sortable(v), NULL)
                order = np.argsort(s)[: there.sum()]  # those that are null come last
                if not step and clean is not None and k < len(factors):
                    v = _winsorized_scores(v, order, *clean)
            values.append(v), keys.append(s), orders.append(order)
        out = []
        place = np.empty(table.num_rows)
        for f, factor in enumerate(factors):
            kept = values[f][orders[f]].tobytes() if clean is not None else None
            for r, ret in enumerate(returns, len(factors)):
                xo, yo = orders[f][keys[r][orders[f]] != NULL], orders[r][keys[f][orders[r]] != NULL]
                n, ic, buckets = len(xo), None, None
                if n:
                    rx, ry = _centred_ranks(keys[f][xo]), _centred_ranks(keys[r][yo])
                    place[yo] = ry
                    xx, yy = float(rx @ rx), float(ry @ ry)
                    ic = float(rx @ place[xo]) / (xx * yy) ** 0.5 if xx > 0 and yy > 0 else None
                if n >= q:
                    edges = sortable(_percentiles(values[f][xo], shares))
                    at = np.searchsorted(edges, keys[f][xo], "right")
                    counts = np.bincount(at, minlength=q)
                    sums = np.bincount(at, values[r][xo], minlength=q)
                    buckets = [{"bucket": k + 1, "mean_ret": sums[k] / counts[k], "n": counts[k]} for k in range(q) if counts[k]]
                out.append((factor, ret, n, ic, buckets, kept))
                kept = None  # with the first return alone
        dates = pa.array([key[0].as_py()] * len(out), key[0].type)
        columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), _KINDS, strict=True)]
        return pa.table([dates, *columns], ["date", "factor", "ret", "n", "ic", "buckets", "cleaned"])

    schema = f"date {wide.schema['date'].dataType.simpleString()}, {PAIRS}"
    return wide.select("date", *cells).groupBy("date").applyInArrow(score, schema)


def daily_ic_of(scores: DataFrame, least: int = 3) -> DataFrame:
    """``daily_ic`` from ``scored``."""
    return scores.where((F.col("n") >= least) & F.col("ic").isNotNull()).select("date", "factor", "ret", "ic", "n")


def quantile_returns_of(scores: DataFrame) -> DataFrame:
    """``quantile_returns`` from ``scored``."""
    return scores.where("buckets is not null").select("date", "factor", "ret", F.inline("buckets"))


def cleaned_of(scores: DataFrame, *more: str) -> DataFrame:
    """``factor, x`` and ``more`` (of one return): all cleaned values of ``scored``, a row each."""
    kinds = {c: scores.schema[c].dataType.simpleString() for c in more}

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(0)[k].as_py(), float)
                for a in range(0, len(x), 65_536):
                    own = pa.array(x[a : a + 65_536])
                    same = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(own), np.int32)), batch.column(c).slice(k, 1)).dictionary_decode() for c in range(1, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([same[0], own, *same[1:]], ["factor", "x", *more])

    schema = ", ".join(["factor string", "x double", *(f"{c} {kind}" for c, kind in kinds.items())])
    return scores.where("cleaned is not null").select("cleaned", "factor", *more).mapInArrow(values, schema)


def cleaned_drift(scores: DataFrame, n_bins: int = 10) -> DataFrame:
    """``factor, psi, ks, n1, n2``: ``psi`` and ``ks`` of all cleaned values of ``scored`` with ``later``.

    Values stay in the bytes of their date and go to the pieces of their range, of
    which each is sorted in one task; what lies before a piece is counted first.  A
    boundary's value is a piece that needs no sorting, and so stays where it is.
    """
    own = scores.where("cleaned is not null and octet_length(cleaned) > 0").select("factor", "later", "cleaned")
    total = {r[0]: r[1] for r in own.groupBy("factor").agg(F.sum(F.octet_length("cleaned") / 8).cast("long")).collect()}

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                factor, later, x = (batch.column(c)[k].as_py() for c in range(3))
                yield factor, later, np.frombuffer(x, float)

    def table(kinds: dict, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    blobs = {"factor": pa.string(), "data": pa.binary()}

    def sample(batches):
        found = defaultdict(list)
        for factor, _, x in each(batches):
            found[factor].append(x[np.random.default_rng(len(x)).random(len(x)) < decay.SAMPLED / total[factor]].tobytes())
        yield table(blobs, [(f, b"".join(v)) for f, v in found.items()])

    values = defaultdict(list)
    for r in own.mapInArrow(sample, "factor string, data binary").collect():
        values[r["factor"]].append(bytes(r["data"]))
    bounds = {}
    for f, n in total.items():
        x = np.frombuffer(b"".join(values[f]), float)
        x = x[np.argsort(sortable(x))]
        pieces = -(-n // decay.PIECE_ROWS)
        at = x[np.arange(1, pieces) * len(x) // pieces] if len(x) else x
        keys, first = np.unique(sortable(at), return_index=True)
        bounds[f] = keys, at[first]

    def count(batches):
        found = {f: np.zeros((2 * len(keys) + 1, 2), np.int64) for f, (keys, _) in bounds.items()}
        for factor, later, x in each(batches):
            found[factor][:, int(later)] += np.bincount(piece_of(sortable(x), bounds[factor][0]), minlength=len(found[factor]))
        yield table(blobs, [(f, v.tobytes()) for f, v in found.items()])

    counts = {f: np.zeros((2 * len(keys) + 1, 2), np.int64) for f, (keys, _) in bounds.items()}
    for r in own.mapInArrow(count, "factor string, data binary").collect():
        counts[r["factor"]] += np.frombuffer(bytes(r["data"]), np.int64).reshape(-1, 2)
    sides = {f: c.sum(0) for f, c in counts.items()}
    before = {f: np.cumsum(c, 0) - c for f, c in counts.items()}
    spots = {f: [(n[0] - 1) * (k / n_bins) for k in range(1, n_bins)] if n[0] else [] for f, n in sides.items()}
    wanted = {f: sorted({r for at in v for r in (math.floor(at), math.ceil(at))}) for f, v in spots.items()}

    def gap(f, a, b):
        n = sides[f]
        return np.abs(a / n[0] - b / n[1]) if n.all() else np.zeros(np.shape(a))

    sent = {"factor": pa.string(), "piece": pa.int32(), "later": pa.bool_(), "data": pa.binary()}

    def send(batches):
        for factor, later, x in each(batches):
            piece = piece_of(sortable(x), bounds[factor][0])
            order = np.argsort(piece, kind="stable")
            piece, x = piece[order], x[order]
            ends = np.append(np.flatnonzero(np.diff(piece)) + 1, len(x))
            rows = [(factor, int(piece[b - 1]), later, x[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends, strict=True) if piece[b - 1] % 2 == 0]
            if rows:
                yield table(sent, rows)

    def within(key, piece):
        """The largest distance inside (as rank -1), and the order statistics of earlier values that lie there."""
        f, at = key[0].as_py(), key[1].as_py()
        data = piece.column("data").to_pylist()
        x = np.frombuffer(b"".join(data), float)
        later = np.repeat(piece.column("later").to_numpy(zero_copy_only=False).astype(bool), [len(d) // 8 for d in data])
        keys = sortable(x)
        order = np.argsort(keys)
        keys, x, later = keys[order], x[order], later[order]
        last = np.append(keys[1:] != keys[:-1], True)
        a0, b0 = before[f][at]
        out = [(f, -1, float(gap(f, a0 + np.cumsum(~later)[last], b0 + np.cumsum(later)[last]).max()))]
        early = x[~later]
        out += [(f, r, float(early[r - a0])) for r in wanted[f] if a0 <= r < a0 + len(early)]
        return pa.Table.from_batches([table({"factor": pa.string(), "rank": pa.int64(), "value": pa.float64()}, out)])

    most, at_rank = defaultdict(float), defaultdict(dict)
    found = own.mapInArrow(send, "factor string, piece int, later boolean, data binary").groupBy("factor", "piece").applyInArrow(within, "factor string, rank long, value double")
    for r in found.groupBy("factor", "rank").agg(F.max("value").alias("value")).collect():  # a rank lies in one piece
        if r["rank"] < 0:
            most[r["factor"]] = max(most[r["factor"]], r["value"])
        else:
            at_rank[r["factor"]][r["rank"]] = r["value"]
    edges = {}
    for f, c in counts.items():
        for k in range(1, len(c), 2):
            if c[k].any():
                most[f] = max(most[f], float(gap(f, *(before[f][k] + c[k]))))
                at_rank[f] |= {r: float(bounds[f][1][k // 2]) for r in wanted[f] if before[f][k][0] <= r < before[f][k][0] + c[k][0]}
        low_high = [(at_rank[f][math.floor(at)], at_rank[f][math.ceil(at)], at - math.floor(at)) for at in spots[f]]
        edges[f] = np.unique(sortable(np.array([a + (b - a) * share for a, b, share in low_high])))

    def bins(batches):
        made = {f: np.zeros((n_bins, 2), np.int64) for f in edges}
        for factor, later, x in each(batches):
            made[factor][:, int(later)] += np.bincount(np.searchsorted(edges[factor], sortable(x)), minlength=n_bins)
        yield table(blobs, [(f, v.tobytes()) for f, v in made.items()])

    binned = {f: np.zeros((n_bins, 2), np.int64) for f in edges}
    for r in own.mapInArrow(bins, "factor string, data binary").collect():
        binned[r["factor"]] += np.frombuffer(bytes(r["data"]), np.int64).reshape(-1, 2)
    out = []
    for f, n in sides.items():
        psi = None
        if n[0]:
            there = binned[f][binned[f].any(1)]
            p, s = np.maximum(there[:, 0] / n[0], 1e-4), np.maximum(there[:, 1] / n[1], 1e-4) if n[1] else None
            psi = float(((s - p) * np.log(s / p)).sum()) if s is not None else None
        out.append((f, psi, most[f] if n.all() else None, int(n[0]), int(n[1])))
    return scores.sparkSession.createDataFrame(out, "factor string, psi double, ks double, n1 long, n2 long")
