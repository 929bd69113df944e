"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits space recursively by random directions at a median, and a vector
near a split spills to both sides.  Vectors are compared, in double precision,
with those that share one of their leaves in any tree.

The splits are fitted on a bounded sample; each level of a tree has one direction,
and each node its own threshold.  Below the nodes that the sample can still split,
thresholds are the projection of the node's sample mean, so trees go as deep as
the number of vectors needs while the broadcast stays bounded.  Every vector is
routed map-side and sent to its leaves with the list of all its leaves: a pair that
shares several is counted in the least of them only, so links are counted without
listing pairs, and each leaf gives back a spanning forest.

The number of trees follows from the depth: ``trees_for`` takes as many as bring
links at the bound to ``RECALL``.  Copies of a vector grow with the number of
vectors to a small power; that is the price of a fixed recall.

Where a dense group lies in the spill band, a node is split beside it.  In a node
most of whose vectors lie in the band wherever it is, splitting would only copy
them.  Such a node is closed: its vectors stay together, as they
are linked with one another for the most part, and are dealt into blocks that are
compared with each other in as many tasks.

Vectors that are equal count as one with a weight before that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import connected_components, join_skewed, materialize
from factorloom.llm.rolling import mix

COSINE = 0.95
LEAF = 512  # vectors a leaf aims at, without what spills
RECALL = 0.999
KEPT_TOGETHER = 0.979  # share of links at the bound that a split keeps in one node, at ``SPILL``
CROWDED = 0.25  # a node with a larger share of its vectors in the band is split elsewhere than at the median
CLOSED = 0.5  # a node with a larger share of its vectors in the band is not split
BLOCK = 2048  # vectors of a block of a closed node
SAMPLE = 32_768  # vectors that the splits are fitted on, the ones with the smallest hash
NODE_SAMPLE = 16  # a node with fewer of them is split at its ancestor's mean
SPILL = 0.16  # half-width of the band that goes to both sides, in standard deviations of a projection
DEEP = 40


def depth_for(n_vectors: int, leaf: int = LEAF) -> int:
    return min(DEEP, max(0, math.ceil(math.log2(max(1, n_vectors / leaf)))))


def trees_for(depth: int, recall: float = RECALL) -> int:
    """Trees of which at least one keeps a pair at the bound in one leaf, with probability ``recall``."""
    lost = 1 - KEPT_TOGETHER**depth
    return 1 if lost <= 0 else max(2, math.ceil(math.log(1 - recall) / math.log(lost)))


class Forest:
    """Directions and thresholds of all trees, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, n_vectors: int, trees: int | None = None, leaf: int = LEAF, block: int = BLOCK, seed: int = 11):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.depth = depth_for(n_vectors, leaf)
        trees = trees_for(self.depth) if trees is None else trees
        self.fitted = min(self.depth, max(0, int(math.log2(max(1, len(sample) / NODE_SAMPLE)))))
        self.directions = rng.standard_normal((trees, dim, self.depth)) / math.sqrt(dim)
        self.thresholds, self.means, self.closed, blocks = [], [], [], {}
        self.width = np.zeros((trees, self.depth))
        for t in range(trees):
            projected = sample @ self.directions[t]
            self.width[t] = SPILL * projected.std(axis=0) if len(sample) else 0.0
            # the sample is routed as all vectors will be, with what spills, so nodes are seen as crowded as they will be
            row, node = np.arange(len(sample)), np.zeros(len(sample), np.int64)
            levels, closed = [], [np.zeros(1, bool)]  # closed: by level, of each node
            for level in range(self.fitted):
                value, width = projected[row, level], self.width[t, level]
                order = np.lexsort((value, node))
                counts = np.bincount(node, minlength=1 << level)
                first = np.cumsum(counts) - counts
                line, at, least = value[order], None, None
                for share in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):  # the median, or where a crowded node has the emptiest band
                    place = np.where(counts > 0, first + (counts * share).astype(np.int64), 0)
                    there = line[np.minimum(place, len(order) - 1)]
                    there[counts == 0] = 0.0
                    inside = np.bincount(node, weights=np.abs(value - there[node]) <= width, minlength=1 << level)
                    if at is None:
                        at, least, crowded = there, inside, inside > CROWDED * counts
                    better = crowded & (inside < least)
                    at, least = np.where(better, there, at), np.where(better, inside, least)
                levels.append(at)
                dense = ~closed[level] & (counts >= NODE_SAMPLE) & (least > CLOSED * counts)
                closed[level] |= dense
                row, node = self._split(row, node, value - at[node], width, closed[level][node])
                closed.append(np.repeat(closed[level], 2))
            counts = np.bincount(node, minlength=1 << self.fitted)
            mean = np.zeros((1 << self.fitted, dim))
            np.add.at(mean, node, sample[row])
            mean = (mean / np.maximum(counts, 1)[:, None]).astype(np.float32)
            closed[-1] = closed[-1].copy()
            for level in range(self.fitted, self.depth):  # below, by the node that the sample still has
                off = projected[row, level] - (mean @ self.directions[t][:, level])[node]
                inside = np.bincount(node, weights=np.abs(off) <= self.width[t, level], minlength=len(counts))
                closed[-1] = closed[-1] | ((counts >= NODE_SAMPLE) & (inside > CLOSED * counts))
                closed.append(closed[-1])
            # leaves of more than a block: all of the fitted level if it is the last, else those closed there
            large = (counts * (n_vectors / max(len(sample), 1)) > block) & (closed[self.fitted] | (self.fitted == self.depth))
            for c in np.flatnonzero(large).tolist():
                blocks[self._code(t, c, self.fitted)] = math.ceil(counts[c] * n_vectors / len(sample) / block)
            self.thresholds.append(levels)
            self.means.append(mean)
            self.closed.append(closed)
        self.blocked = np.array(sorted(c for c, k in blocks.items() if k > 1), np.int64)
        self.blocks = np.array([blocks[c] for c in self.blocked.tolist()], np.int64)

    def _code(self, tree: int, node, level: int):
        return (node << (self.depth - level)) + (tree << (DEEP + 1))

    @staticmethod
    def _split(row, node, off, width, whole):
        """Rows and nodes one level below: what lies in the band goes to both sides, what is in a whole node to the left."""
        both = (np.abs(off) <= width) & ~whole
        right = (off >= 0) & ~whole
        return np.concatenate([row, row[both]]), np.concatenate([2 * node + right, 2 * node[both] + ~right[both]])

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf code of every (unit vector, leaf); codes differ between trees."""
        rows, codes = [], []
        for t in range(len(self.directions)):
            projected = x @ self.directions[t]
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                top = node >> max(0, level - self.fitted)
                if level < self.fitted:
                    at = self.thresholds[t][level][node]
                else:
                    at = self.means[t][top] @ self.directions[t][:, level]
                off = projected[row, level] - at
                row, node = self._split(row, node, off, self.width[t, level], self.closed[t][level][top])
            rows.append(row)
            codes.append(self._code(t, node, self.depth))
        return np.concatenate(rows), np.concatenate(codes)

    def cells(self, code: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index into ``code``, block and cell: in a blocked leaf a row goes to the cells of its block with each block."""
        index, block, cell = [np.arange(len(code))], [np.zeros(len(code), np.int64)], [np.zeros(len(code), np.int64)]
        if len(self.blocked):
            at = np.minimum(np.searchsorted(self.blocked, code), len(self.blocked) - 1)
            k = np.where(self.blocked[at] == code, self.blocks[at], 1)
            own = (mix(ids.view(np.uint64)) % k.astype(np.uint64)).astype(np.int64)
            of = np.repeat(np.arange(len(code)), k)
            other = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
            low, high = np.minimum(own[of], other), np.maximum(own[of], other)
            index, block, cell = [of], [own[of]], [low * k[of] + high]
        return index[0], block[0], cell[0]


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled by their largest component first, so that no square over- or underflows."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _share_lower(lists, a, b, code: int) -> np.ndarray:
    """Do rows ``a`` and ``b`` share a leaf below ``code``? Lists are ascending, padded with -1."""
    found = np.zeros(len(a), bool)
    left = np.arange(len(a))
    for k in range(lists.shape[1]):
        c = lists[a[left], k]
        live = (c >= 0) & (c < code)
        left, c = left[live], c[live]
        if not len(left):
            break
        hit = (lists[b[left]] == c[:, None]).any(axis=1)
        found[left[hit]] = True
        left = left[~hit]
    return found


def _leaf_links(code: int, ids, weights, x, lists, bound: float, blocks):
    """Counts of links of each row that belong to this leaf, and a spanning forest of its links.

    With rows of two blocks, only pairs of rows from different ones are of this cell.
    """
    cross = (blocks != blocks[0]).any()
    n = len(ids)
    links, u, v = np.zeros(n, np.int64), [], []
    parent = np.arange(n)
    for lo in range(0, n, 512):
        block = x[lo : lo + 512] @ x[lo:].T
        i, j = np.nonzero(block >= bound)
        later = (j > i) & (~cross | (blocks[i + lo] != blocks[j + lo]))
        i, j = i[later] + lo, j[later] + lo
        for at in range(0, len(i), 20_000):
            a, b = i[at : at + 20_000], j[at : at + 20_000]
            own = ~_share_lower(lists, a, b, code)
            np.add.at(links, a[own], weights[b[own]])
            np.add.at(links, b[own], weights[a[own]])
            apart = parent[a] != parent[b]
            while apart.any():  # parents are roots here; each round joins some, until no pair is apart
                a, b = a[apart], b[apart]
                k = np.unique(np.maximum(parent[a], parent[b]), return_index=True)[1]
                high, low = np.maximum(parent[a[k]], parent[b[k]]), np.minimum(parent[a[k]], parent[b[k]])
                u += ids[a[k]].tolist()
                v += ids[b[k]].tolist()
                parent[high] = low
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                apart = parent[a] != parent[b]
    return links, u, v


def similar_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int | None = None, leaf: int = LEAF, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``).

    Two vectors are linked when their cosine is at least ``cosine``; none below it
    is, and pairs at it are found with high probability (see the tests for the
    recall).  Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths.  ``vec_id``
    identifies a row; rows with a null one are left out.  Equal vectors are linked.
    """
    # components stay as they are stored; all sums are in double precision
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.where("vec_id is not null").select("vec_id", F.col("embedding").cast(kind).alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = F.col("e").isNotNull() & finite & F.exists("e", lambda c: c != 0)
    rows = materialize(rows.withColumn("e", F.when(usable, F.col("e"))), "vectors")
    n_rows = rows.count()
    usable_rows = rows.where("e is not null")
    points = usable_rows.groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    points = materialize(points.withColumn("dim", F.size("e")), "points")

    sums, edges = [], []
    for dim, n in sorted((r["dim"], r["n"]) for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        own = points.where(F.col("dim") == dim)
        taken = own.orderBy(F.xxhash64("e"), "id").limit(sample).select("e").toPandas()["e"]
        forest = Forest(_unit(np.stack(taken)), n, trees, leaf, block)
        links = _links(own, forest, cosine, kind)
        sums.append(links.select("id", "links"))
        edges.append(links.select(F.explode("edges").alias("edge")).select("edge.u", "edge.v"))
    none = rows.select(F.col("vec_id").alias("node"), F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id")).where("e is null")
    if not sums:
        return none.select(F.col("node").alias("vec_id"), F.col("links").alias("n_links"), "component_id", F.lit(True).alias("kept"))
    all_sums, all_edges = sums[0], edges[0]
    for s, e in zip(sums[1:], edges[1:], strict=True):
        all_sums, all_edges = all_sums.unionByName(s), all_edges.unionByName(e)
    parts = connected_components(all_edges)
    points = points.select("e", "id", "n").join(all_sums.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
    points = points.join(parts, points["id"] == parts["node"], "left").select(
        "e", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    found = join_skewed(usable_rows, points, "e", "n", n_rows).select("vec_id", "n_links", "component_id")
    found = found.unionByName(none.select(F.col("node").alias("vec_id"), F.col("links").alias("n_links"), "component_id"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(points: DataFrame, forest: Forest, cosine: float, kind: str) -> DataFrame:
    """For each leaf and point with links there: ``id, links`` counted there, and ``edges`` of the leaf's forest."""
    shared = points.sparkSession.sparkContext.broadcast(forest)

    def route(batches):
        forest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("e").values).reshape(batch.num_rows, -1)
            row, code = forest.leaves(_unit(x))
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            ends = np.searchsorted(row, np.arange(len(x)), side="right")
            starts = np.searchsorted(row, np.arange(len(x)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(code))
            index, block, cell = forest.cells(code, batch.column("id").to_numpy()[row])
            for at in range(0, len(index), 4096):
                k = index[at : at + 4096]
                r = pa.array(row[k])
                places = [pa.array(v) for v in (code[k], cell[at : at + 4096], block[at : at + 4096])]
                yield pa.RecordBatch.from_arrays(
                    [*places, *(batch.column(c).take(r) for c in ("id", "n", "e")), lists.take(r)],
                    ["leaf", "cell", "block", "id", "n", "e", "leaves"],
                )

    def compare(batches):
        held: list = []

        def flush():
            cols = [np.concatenate([h[k] for h in held]) for k in range(3)]
            x = _unit(np.concatenate([h[3] for h in held]))
            longest = max(h[4].shape[1] for h in held)
            lists = np.concatenate([np.pad(h[4], ((0, 0), (0, longest - h[4].shape[1])), constant_values=-1) for h in held])
            links, u, v = _leaf_links(int(cols[0][0]), cols[1], cols[2], x, lists, cosine, np.concatenate([h[5] for h in held]))
            some = np.flatnonzero(links)
            pairs = [{"u": int(a), "v": int(b)} for a, b in zip(u, v, strict=True)]
            held.clear()
            ids = cols[1][some].tolist()
            if not ids and pairs:  # all links of the leaf are counted elsewhere
                ids, some = [pairs[0]["u"]], np.zeros(1, np.int64)
                counts = [0]
            else:
                counts = links[some].tolist()
            edges = [pairs] + [[]] * (len(ids) - 1) if ids else []
            kind = pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(edges, kind)], ["id", "links", "edges"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, cell, block = (batch.column(c).to_numpy() for c in ("leaf", "cell", "block"))
            ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            x = np.asarray(batch.column("e").flatten()).reshape(batch.num_rows, -1)
            codes = batch.column("leaves")
            sizes = np.diff(np.asarray(codes.offsets))
            lists = np.full((batch.num_rows, int(sizes.max())), -1, np.int64)
            lists[np.arange(lists.shape[1]) < sizes[:, None]] = np.asarray(codes.flatten())
            cuts = np.append(np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (cell[1:] != cell[:-1]))), len(leaf))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and (leaf[a], cell[a]) != last:
                    yield flush()
                last = (leaf[a], cell[a])
                held.append((leaf[a:b], ids[a:b], n[a:b], x[a:b], lists[a:b], block[a:b]))
        if held:
            yield flush()

    sent = points.select("id", "n", "e").mapInArrow(route, f"leaf long, cell long, block long, id long, n long, e {kind}, leaves array<long>")
    sent = sent.repartition("leaf", "cell").sortWithinPartitions("leaf", "cell")
    return materialize(sent.mapInArrow(compare, "id long, links long, edges array<struct<u:long,v:long>>"), "links")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``similar_vectors`` of the whole of ``embeddings``."""
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
