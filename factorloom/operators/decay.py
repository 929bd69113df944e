"""Pooled rank correlations of a few columns with returns over many horizons, exact, in little disk.

Every pair of a factor and a horizon ranks its own complete rows, so a row has as
many ranks as there are pairs, twice.  Rows stand in blocks of whole tickers, a
block in a row of bytes.  For few horizons at a time, blocks cut their columns by
pieces of the value's range; a piece is sorted once and counts for each other
column the rows that have it; ranks go back to their blocks, where products are
summed up.  What lies before a piece is counted first.  Disk holds the blocks, and
values and ranks of the horizons at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.sources.scratch import removed, shuffles_removed, written

BLOCK_ROWS = 65_536  # at which a block ends; a ticker is never cut
PIECE_ROWS = 400_000  # of a column that sort in one task
SAMPLED = 32_768  # values of a column from which pieces get their boundaries
ROUND_ROWS = 4_000_000  # rows times horizons that meet at once; one horizon at least
SALTS = 32
NULL = np.uint64(2**64 - 1)

BLOCKS = "block long, n int, sizes binary, price binary, xs array<binary>"
SENT = "block long, col int, piece int, salt int, pos binary, keys binary, has binary"
RANKED = "block long, col int, piece int, pos binary, ranks binary"
SUMS = "factor int, horizon int, xx double, yy double, xy double"


def sortable(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; zeros are equal, and so are all that are no number, which come last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) | np.int64(-(2**63)))).view(np.uint64)


def _bytes_of(arrays: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(arrays), dtype)


def _cut(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary for each stretch of the rows of ``data``, which end at ``ends``."""
    width = data.dtype.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    offsets = np.concatenate([[0], ends]).astype(np.int64) * width
    if offsets[-1] >= 2**31:
        raise ValueError("a block of over 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _positions(n: int):
    return np.uint16 if n <= 65_536 else np.uint32


def to_blocks(rows: DataFrame, factors: list[str], price: str) -> DataFrame:
    """``BLOCKS`` of ``rows`` (``ticker, date``, the price and the factors): tickers one after another, each by date; ``sizes`` has their numbers of rows."""
    cells = F.struct("date", F.col(price).cast("double").alias("p"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(factors)))
    by_ticker = rows.groupBy("ticker").agg(F.sort_array(F.collect_list(cells)).alias("r")).select("r.p", *(f"r.x{i}" for i in range(len(factors))))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0

        def block(sizes, columns):
            nonlocal made
            made += 1
            arrays = [[first + made], [len(columns[0])], [sizes.astype(np.int32).tobytes()], [columns[0].tobytes()], [[c.tobytes() for c in columns[1:]]]]
            kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], ["block", "n", "sizes", "price", "xs"])

        sizes, columns = np.zeros(0, np.int64), [np.zeros(0, np.uint64)] * (1 + len(factors))
        for batch in batches:
            own = []
            for k, c in enumerate(batch.columns):
                values = c.flatten()
                x = values.to_numpy(zero_copy_only=False).astype(float, copy=False)
                x = np.ascontiguousarray(x).view(np.uint64) if k == 0 else sortable(x)
                own.append(np.where(values.is_valid().to_numpy(zero_copy_only=False), x, NULL))
            sizes = np.concatenate([sizes, batch.column(0).value_lengths().to_numpy(zero_copy_only=False)])
            columns = [np.concatenate(c) for c in zip(columns, own, strict=True)]
            ends = np.cumsum(sizes)
            at = row = 0
            while len(ends) and ends[-1] - row > BLOCK_ROWS:
                to = max(at + 1, int(np.searchsorted(ends, row + BLOCK_ROWS, "right")))
                yield block(sizes[at:to], [c[row : ends[to - 1]] for c in columns])
                at, row = to, ends[to - 1]
            sizes, columns = sizes[at:], [c[row:] for c in columns]
        if len(sizes):
            yield block(sizes, columns)

    return by_ticker.mapInArrow(blocks, BLOCKS)


class Block:
    """Factors and returns of a block as ``sortable`` numbers, ``NULL`` where there is none."""

    def __init__(self, n: int, sizes: bytes, price: bytes, xs: list[bytes]):
        self.n, bits = n, np.frombuffer(price, np.uint64)
        self.price, self.has = bits.view(float), bits != NULL
        self.ends = np.repeat(np.cumsum(np.frombuffer(sizes, np.int32)), np.frombuffer(sizes, np.int32))
        self.xs = [np.frombuffer(x, np.uint64) for x in xs]

    def forward(self, h: int) -> np.ndarray:
        y = np.full(self.n, NULL)
        if h < self.n:
            ok = (np.arange(h, self.n) < self.ends[:-h]) & self.has[:-h] & self.has[h:]
            with np.errstate(all="ignore"):
                y[:-h] = np.where(ok, sortable(self.price[h:] / self.price[:-h] - 1), NULL)
        return y


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            block, *rest = (batch.column(c)[k].as_py() for c in range(5))
            yield block, Block(*rest)


def piece_of(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Twice the boundaries below a value, plus one if it is a boundary: then all rows of the piece are equal."""
    below = np.searchsorted(bounds, keys)
    return (2 * below + (np.append(bounds, NULL)[below] == keys)).astype(np.int32)


def _bounds(blocks: DataFrame, n: int, n_factors: int, horizons: int) -> list[np.ndarray]:
    """Rising boundaries of each column's pieces, from a sample of the rows; any would do for the result."""
    share = min(1.0, SAMPLED / n)

    def sample(batches):
        found = [[] for _ in range(n_factors + horizons)]
        for block, b in _blocks_in(batches):
            take = np.random.default_rng(block).random(b.n) < share
            for c, values in enumerate([*b.xs, *map(b.forward, range(1, horizons + 1))]):
                own = values[take]
                found[c].append(own[own != NULL].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([b"".join(f) for f in found], pa.binary())], ["col", "keys"])

    values: list[list[bytes]] = [[] for _ in range(n_factors + horizons)]
    for r in blocks.mapInArrow(sample, "col int, keys binary").collect():
        values[r["col"]].append(bytes(r["keys"]))
    pieces = -(-n // PIECE_ROWS)
    own = [np.sort(_bytes_of(v, np.uint64)) for v in values]
    return [np.unique(v[np.arange(1, pieces) * len(v) // pieces]) if len(v) else v for v in own]


def _counts(blocks: DataFrame, bounds: list[np.ndarray], n_factors: int, horizons: int) -> list[np.ndarray]:
    """For each column the rows of each piece that have each column of the other side."""
    sides = [horizons] * n_factors + [n_factors] * horizons

    def count(batches):
        total = [np.zeros((2 * len(b) + 1, s), np.int64) for b, s in zip(bounds, sides, strict=True)]
        for _, b in _blocks_in(batches):
            columns = [*b.xs, *map(b.forward, range(1, horizons + 1))]
            has = [c != NULL for c in columns]
            for c, keys in enumerate(columns):
                piece = piece_of(keys, bounds[c])
                for k, other in enumerate(has[n_factors:] if c < n_factors else has[:n_factors]):
                    total[c][:, k] += np.bincount(piece[has[c] & other], minlength=len(total[c]))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["col", "counts"])

    def summed(key, table):
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"col": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "col int, counts binary"
    found = {r["col"]: bytes(r["counts"]) for r in blocks.mapInArrow(count, schema).groupBy("col").applyInArrow(summed, schema).collect()}
    return [np.frombuffer(found[c], np.int64).reshape(-1, s) for c, s in enumerate(sides)]


def _met(blocks: DataFrame, bounds: list[np.ndarray], counts: list[np.ndarray], n_factors: int, hs: list[int]) -> DataFrame:
    """``SUMS`` of squares and products of centred double ranks, for the horizons ``hs`` and all factors."""
    n_cols = n_factors + len(hs)
    of = [*range(n_factors), *(n_factors + h - 1 for h in hs)]  # the column's place among all
    bounds = [bounds[c] for c in of]
    counts = [counts[c][:, [h - 1 for h in hs]] if k < n_factors else counts[c] for k, c in enumerate(of)]
    before = [np.cumsum(c, 0) - c for c in counts]
    n = [c.sum(0) for c in counts]

    def send(batches):
        for block, b in _blocks_in(batches):
            columns = [*b.xs, *map(b.forward, hs)]
            has = np.array([c != NULL for c in columns])
            for c, keys in enumerate(columns):
                others = has[n_factors:] if c < n_factors else has[:n_factors]
                rows = np.flatnonzero(has[c] & others.any(0))
                if not len(rows):
                    continue
                piece = piece_of(keys[rows], bounds[c])
                order = np.argsort(piece.astype(np.uint16) if piece.max() < 65_536 else piece, kind="stable")  # numpy sorts 16 bits by radix
                rows, piece = rows[order], piece[order]
                ends = np.append(np.flatnonzero(np.diff(piece)) + 1, len(rows))
                pieces = piece[ends - 1]
                like = lambda v, kind, m=len(ends): pa.array(np.full(m, v), kind)
                salts = np.where(pieces % 2 == 1, block % SALTS, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        like(block, pa.int64()), like(c, pa.int32()), pa.array(pieces, pa.int32()), pa.array(salts, pa.int32()), _cut(rows.astype(_positions(b.n)), ends),
                        _cut(keys[rows], ends), _cut(np.packbits(others[:, rows].T, axis=1), ends),
                    ],
                    ["block", "col", "piece", "salt", "pos", "keys", "has"],
                )

    def rank(key, table):
        c, piece = key[0].as_py(), key[1].as_py()
        sides = counts[c].shape[1]
        keys = _bytes_of(sent := table.column("keys").to_pylist(), np.uint64)
        has = np.unpackbits(_bytes_of(table.column("has").to_pylist(), np.uint8).reshape(len(keys), -1), axis=1, count=sides)
        ranks = np.empty((len(keys), sides), np.uint32)
        if piece % 2:  # all are equal, and others of them are elsewhere
            ranks[:] = counts[c][piece] + 1
        else:
            order = np.argsort(keys)
            own = keys[order]
            first = np.append(True, own[1:] != own[:-1])
            same = np.cumsum(first) - 1
            last = np.append(np.flatnonzero(first)[1:], len(own)) - 1
            for k in range(sides):
                upto = np.cumsum(has[order, k], dtype=np.uint32)[last]  # up to the last equal value
                ranks[order, k] = (upto + np.append(np.uint32(0), upto[:-1]) + 1)[same]
        ranks[has == 0] = 0
        ends = np.cumsum([len(k) // 8 for k in sent])
        return pa.table([*(table.column(x) for x in ("block", "col", "piece", "pos")), _cut(ranks, ends)], ["block", "col", "piece", "pos", "ranks"])

    def meet(table):
        cols, pieces = table.column("col").to_numpy(), table.column("piece").to_numpy()
        ranks, pos = table.column("ranks").to_pylist(), table.column("pos").to_pylist()
        found = []
        for c in range(n_cols):
            own = np.flatnonzero(cols == c)
            sides = counts[c].shape[1]
            rows = [len(ranks[k]) // (4 * sides) for k in own]
            r = _bytes_of([ranks[k] for k in own], np.uint32).reshape(-1, sides)
            base = np.repeat(before[c][pieces[own]], rows, axis=0)
            width = len(pos[own[0]]) // rows[0] if len(own) else 2
            found.append((_bytes_of([pos[k] for k in own], f"u{width}"), np.where(r > 0, 2.0 * base + r - (n[c] + 1.0), 0.0)))
        size = 1 + max(int(p.max()) for p, _ in found if len(p))
        full = []
        for p, r in found:
            full.append(np.zeros((r.shape[1], size)))
            full[-1][:, p] = r.T
        out = []
        for f in range(n_factors):
            for k, h in enumerate(hs):
                x, y = full[f][k], full[n_factors + k][f]
                out.append((f, h, float(x @ x), float(y @ y), float(x @ y)))
        kinds = pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()
        return pa.table([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["factor", "horizon", "xx", "yy", "xy"])

    ranked = blocks.mapInArrow(send, SENT).groupBy("col", "piece", "salt").applyInArrow(rank, RANKED)
    met = ranked.groupBy("block").applyInArrow(meet, SUMS)
    return met.groupBy("factor", "horizon").agg(*(F.sum(c).alias(c) for c in ("xx", "yy", "xy")))


def pooled_rank_ic(rows: DataFrame, factors: list[str], horizons: int, price: str) -> list[tuple[str, int, float | None]]:
    """Factor, horizon, correlation of the average ranks of the factor and the return over the horizon among all rows that have both;
    none where a side is constant.  ``rows`` has ``ticker, date``, the price and the factors; pairs without a row are not in the list."""
    with shuffles_removed(rows.sparkSession):
        blocks = written(to_blocks(rows, factors, price), "decay")
        try:
            n = blocks.agg(F.sum("n")).first()[0] or 0
            if not n or not factors:
                return []
            bounds = _bounds(blocks, n, len(factors), horizons)
            counts = _counts(blocks, bounds, len(factors), horizons)
            at_once, out = max(1, min(horizons, ROUND_ROWS // n)), []
            for begin in range(1, horizons + 1, at_once):
                hs = list(range(begin, min(begin + at_once, horizons + 1)))
                for r in _met(blocks, bounds, counts, len(factors), hs).collect():
                    if counts[r["factor"]][:, r["horizon"] - 1].sum():
                        ic = r["xy"] / (r["xx"] * r["yy"]) ** 0.5 if r["xx"] > 0 and r["yy"] > 0 else None
                        out.append((factors[r["factor"]], r["horizon"], ic))
            return out
        finally:
            removed(blocks)
