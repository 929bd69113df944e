"""Shards of near equal size: the minimax contiguous partition of ordered atomic groups.

Rows with equal texts are a group and stay together.  Groups are ordered by their
first row; a shard is a stretch of that order.  The smallest capacity for which a
greedy walk needs no more than the given number of shards is found by binary
search.  Within that capacity the cuts lie between those of the walk from the front
and of that from the back, so each is put next to an even share of what is left.
A group that is larger than the capacity stands alone in its shard, so one huge
group of copies does not leave the other shards empty.

The walk needs prefix sums over all groups, which no single task or driver may
hold.  The driver sees sums of blocks of the order, a bounded number of them:
they bracket every cut, and only blocks in the brackets are read again in finer
blocks, until each bracket holds known group borders alone.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import MembershipFilter, join_skewed, materialize, result, scratch_scope

BLOCKS = 65_536  # blocks of the first look at the order, at most twice that
FINER = 10  # bits by which blocks are cut finer each time
ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition
OVERHEAD = 8  # bytes of a row beside its text


class Walk:
    """Greedy walks over blocks of weights, some of which hide group borders inside.

    Arrays by block: ``at`` (place of its first group), ``end`` (running sum behind it),
    ``exact`` (one group, so no border is hidden).  ``low`` and ``high`` bound where
    the walk over the groups themselves stands after a step.
    """

    def __init__(self, weights: np.ndarray, exact: np.ndarray):
        self.weights, self.exact = weights, exact
        self.borders = np.concatenate([[0], np.cumsum(weights)])
        self.total = int(self.borders[-1])

    def low(self, x: int, capacity: int) -> int:
        """The furthest known border within ``capacity`` of the border ``x``; past a single group in any case."""
        i = int(np.searchsorted(self.borders, x, "left"))
        if i < len(self.exact) and self.exact[i] and self.weights[i] > capacity:
            return int(self.borders[i + 1])
        return int(self.borders[np.searchsorted(self.borders, x + capacity, "right") - 1])

    def high(self, x: int, capacity: int) -> int:
        """No walk that stands at ``x`` or before gets further than this."""
        i = int(np.searchsorted(self.borders, x, "right")) - 1
        if i < len(self.exact) and self.weights[i] > capacity:
            return int(self.borders[i + 1])
        to = min(x + capacity, self.total)
        j = int(np.searchsorted(self.borders, to, "right")) - 1
        return int(self.borders[j]) if j < len(self.exact) and self.exact[j] else to

    def steps(self, bound, capacity: int, n: int) -> list[int]:
        out = [0]
        for _ in range(n):
            out.append(bound(out[-1], capacity))
        return out

    def least(self, bound, n: int) -> int:
        """The smallest capacity for which ``n`` steps of ``bound`` reach the end."""
        lo, hi = 0, max(1, self.total)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.steps(bound, mid, n)[-1] >= self.total else (mid, hi)
        return hi


def _even_cuts(walk: Walk, back: Walk, capacity: int, n: int) -> tuple[list[int], np.ndarray]:
    """Cuts with no shard above ``capacity``, each as near as may be to an even share of what is left; and blocks to be known better."""
    last = [walk.total - x for x in back.steps(back.low, capacity, n)]  # last[k]: from here on, k shards are enough
    cuts, unclear = [0], np.zeros(len(walk.exact), bool)
    for left in range(n, 1, -1):
        begin = int(np.searchsorted(walk.borders, last[left - 1], "left"))
        end = int(np.searchsorted(walk.borders, walk.low(cuts[-1], capacity), "right"))
        aim = cuts[-1] + (walk.total - cuts[-1]) // left
        near = walk.borders[begin:end]
        cuts.append(int(near[np.argmin(np.abs(near - aim))]) if len(near) else walk.low(cuts[-1], capacity))
        within = int(np.searchsorted(walk.borders, aim, "right")) - 1
        if begin <= within < min(end, len(unclear)) and not walk.exact[within]:
            unclear[within] = True
            break
    return cuts[1:], unclear


def _blocks(order: DataFrame, shift: int) -> list:
    """``(first head, end, weight, heads)`` of the blocks of ``2 ** shift`` rows that have a head, in order."""
    head = F.when(F.col("weight") > 0, F.col("at"))
    found = order.groupBy(F.shiftright("at", shift).alias("block")).agg(F.min(head).alias("head"), F.sum("weight").alias("weight"), F.count(head).alias("heads"))
    return sorted((r.head, (r.block + 1) << shift, r.weight, r.heads) for r in found.where("heads > 0").collect())


def cut_places(order: DataFrame, n_rows: int, n_shards: int, blocks: int = BLOCKS, finer: int = FINER) -> tuple[int, list[int]]:
    """The smallest capacity and the places ``at`` where shards after the first begin.

    ``order`` has ``at`` (rising along the order) and ``weight``: of a group's
    first row its group's size, of its other rows 0.  The driver gets a bounded
    number of sums: ``blocks`` for the first look, then ``2 ** finer`` for each block
    that a cut may lie in.
    """
    shift = max(0, (max(1, n_rows) // blocks).bit_length())
    known = [(*b, shift) for b in _blocks(order, shift)]
    while known:
        exact = np.array([b[3] == 1 for b in known])
        walk = Walk(np.array([b[2] for b in known], np.int64), exact)
        unclear = ~exact & (walk.weights > walk.total // (8 * n_shards))  # may hide a group that stands alone
        if not unclear.any():
            most, least = walk.least(walk.low, n_shards), walk.least(walk.high, n_shards)
            back = Walk(walk.weights[::-1], exact[::-1])
            for w, mark in ((walk, unclear), (back, unclear[::-1])):
                for a, b in zip(w.steps(w.low, least, n_shards), w.steps(w.high, most, n_shards), strict=True):
                    mark[max(0, np.searchsorted(w.borders, a, "right") - 1) : np.searchsorted(w.borders, b, "right")] = True
            unclear &= ~exact
        if not unclear.any():  # every border that a walk may use is known, so both bounds are the walk
            cuts, unclear = _even_cuts(walk, back, most, n_shards)
            if not unclear.any():
                return most, [known[i][0] for i in np.searchsorted(walk.borders, cuts, "left") if i < len(known)]
        chosen = [known[i] for i in np.flatnonzero(unclear)]
        shifts = {b[4] for b in chosen}
        found = []
        for old in shifts:
            ranges: list[list[int]] = []
            for first, end, _, _, s in chosen:
                if s == old and ranges and ranges[-1][1] == first >> s << s:
                    ranges[-1][1] = end
                elif s == old:
                    ranges.append([first >> s << s, end])
            new = max(0, old - finer)
            for k in range(0, len(ranges), 200):
                inside = reduce(lambda a, b: a | b, [F.col("at").between(a, b - 1) for a, b in ranges[k : k + 200]])
                found += [(*b, new) for b in _blocks(order.where(inside), new)]
        known = sorted([b for b, u in zip(known, unclear, strict=True) if not u] + found)
    return 0, []


def ordered_rows(docs: DataFrame, *more: str) -> DataFrame:
    """Rows as ``doc_id, size, text_crc32, weight, at`` and ``more``: ``at`` rises along groups by their first row, then ``doc_id``."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"), *more)
    rows = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "shard-rows")
    n_rows = rows.count()
    groups = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "tie")).alias("first"), F.sum("size").alias("weight"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1"), "shard-groups")
    # rows whose digest no other row can have are groups of their own and need no join
    flagged = MembershipFilter(groups, "digest", groups.count()).flag(rows, "digest")
    alone = flagged.where("not __maybe").select(*rows.columns, F.lit(None).cast(groups.schema["first"].dataType).alias("first"), F.lit(None).cast("long").alias("weight"))
    maybe = join_skewed(flagged.where("__maybe").drop("__maybe"), groups, "digest", "n", n_rows).drop("n")
    rows = maybe.unionByName(alone).withColumn("first", F.coalesce("first", F.struct("doc_id", "tie")))
    rows = rows.withColumn("weight", F.when(F.col("first.tie") != F.col("tie"), F.lit(0)).otherwise(F.coalesce("weight", "size")))
    order = [F.col("first.doc_id"), F.col("first.tie"), F.col("doc_id"), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("doc_id", "size", "text_crc32", *more, "weight", F.monotonically_increasing_id().alias("at"))


def shard_documents(docs: DataFrame, n_shards: int = 24, *more: str) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` (and ``more`` columns of ``docs``), one row per row of ``docs``.

    The law that holds is ``bytes``: the largest shard is as small as whole
    groups in their order allow, apart from groups larger than that, which stand
    alone.  ``size`` is the UTF-8 length of the text (null: none) plus 8, ``slot``
    the row's place in its shard, gapless from 0, by group and ``doc_id``.
    ``grown_shard`` is null, as another number of shards moves all cuts.
    Rows that repeat a ``doc_id`` each have a place; null ``doc_id`` values come
    first in the order.  With fewer groups than shards the last shards are
    empty; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with scratch_scope(spark):
        order = result(ordered_rows(docs, *more), "shard-order")
    pieces = order.groupBy(F.shiftright("at", ROW_BITS).alias("piece")).count().collect()  # one row for each task that wrote
    before, n_rows = {}, 0
    for r in sorted(pieces):
        before[r.piece] = n_rows
        n_rows += r["count"]
    _, cuts = cut_places(order, n_rows, n_shards)
    rank = [before[c >> ROW_BITS] + (c & ((1 << ROW_BITS) - 1)) for c in cuts]
    offsets = spark.createDataFrame(list(before.items()), "piece long, before long")
    placed = order.withColumn("piece", F.shiftright("at", ROW_BITS)).join(F.broadcast(offsets), "piece")
    shard = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("at"))) if cuts else F.lit(0)
    begins = F.array(*(F.lit(x).cast("long") for x in [0, *rank]))
    here = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = placed.withColumn("shard", shard.cast("int")).withColumn("slot", here - F.get(begins, F.col("shard")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *more)


def write_shards(docs: DataFrame, path: str, n_shards: int = 24) -> None:
    """Writes ``docs`` with its ``shard`` and ``slot`` as a Parquet folder for each shard; a large shard has several files."""
    keep = [c for c in docs.columns if c != "doc_id"]
    out = shard_documents(docs.select("doc_id", *keep), n_shards, *keep)
    out.select("doc_id", *keep, "shard", "slot").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shard_documents`` of the whole of ``documents`` into 24 shards."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
