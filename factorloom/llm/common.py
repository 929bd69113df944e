"""Helpers shared by the corpus operators: scratch tables, membership filters, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
import weakref
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.sources.scratch import shared_root


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` where set, else beside the warehouse."""
    return shared_root(spark)


_SCOPES: list[list[str]] = []  # scratch tables of each open scope, innermost last
TABLES_A_REST = 4  # scratch tables after which the driver gives back memory
_written = 0


def rest_driver(spark: SparkSession) -> None:
    """Has the driver's JVM give what plans of earlier tables left back to the system: heap, and what its C allocator keeps freed.

    A job of many small tables plans many queries; each leaves little, but the threads that plan and compile them
    keep hundreds of MB of freed memory.  A JVM without the command (before 17.0.9) only shrinks its heap.
    """
    jvm = spark._jvm
    jvm.java.lang.System.gc()
    with suppress(Py4JError):
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        beans.invoke(jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)


def rest_executors(spark: SparkSession) -> None:
    """Has every executor's JVM give unused heap back to the system: what a stage made it grow by counts beside the Python workers of the next.

    A heap shrinks at a full collection only.  Two tasks a core reach all executors.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch tables that are written inside are removed at the end, but for ``result`` tables."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, level: int = -1) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    global _written
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_SCOPES) >= -level:
        _SCOPES[level].append(path)
    df.write.parquet(path)
    _written += 1
    if _written % TABLES_A_REST == 0:
        rest_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def result(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for what outlives the innermost scope."""
    return materialize(df, name, -2)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) plus ``more``; other columns are pruned."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


CACHE_ENTRIES = 200_000  # of a generation of each worker cache
KEPT_CHARS = 64  # longer keys are not remembered, which bounds a cache in bytes as well
_MEMOS: list = []


class Memo(dict):
    """A bounded cache of ``make`` by short strings in two generations: a full one becomes the old one, from which what is asked for comes back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}
        _MEMOS.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > KEPT_CHARS:
            return value
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self):
        self.clear()
        self.old = {}


def forget_words() -> None:
    """Empties the caches that earlier stages left in this reused Python worker."""
    for memo in _MEMOS:
        if (m := memo()) is not None:
            m.forget()


def give_back() -> None:
    """Hands the memory that this Python worker has freed back to the system, which its allocators else keep for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` after which a reused worker holds no more than it needs.

    What freed batches leave in an idle worker counts against its executor while
    later stages run in the JVM alone.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


FILTER_BITS = 32_768  # bits of one bitmap of Spark's bitmap functions (4 KB)
MAX_FILTER_BITMAPS = 4_096  # so a filter never exceeds 16 MB, whatever the number of keys


class MembershipFilter:
    """A bounded Bloom filter over a long key, built and probed with SQL functions only.

    The keys are spread over 4 KB bitmaps and set two bits each.  The number of
    bitmaps follows the number of keys (about ten bits a key) up to 16 MB, which
    bounds the broadcast; beyond that the filter lets more rows pass, so it may
    save less but never loses a row.  Callers join what passes with the exact keys.
    """

    def __init__(self, keys: DataFrame, key: str, n_keys: int):
        self.n = min(MAX_FILTER_BITMAPS, max(1, -(-n_keys * 10 // FILTER_BITS)))
        h = F.xxhash64(F.col(key))
        bits = keys.where(F.col(key).isNotNull()).select(
            self._bucket(h).alias("__filter_bucket"), F.explode(F.array(*self._bits(h))).alias("__filter_bit")
        )
        bitmaps = bits.groupBy("__filter_bucket").agg(F.bitmap_construct_agg("__filter_bit").alias("__bitmap"))
        # words of 32 bits: a probe then reads one number instead of cutting the bitmap
        at = F.sequence(F.lit(1), F.lit(FILTER_BITS // 8 - 3), F.lit(4))
        words = F.transform(at, lambda k: F.conv(F.hex(F.substring("__bitmap", k, F.lit(4))), 16, 10).cast("long"))
        words = F.transform(words, lambda w: F.when(w >= 1 << 31, w - (1 << 32)).otherwise(w).cast("int"))
        self.table = bitmaps.select("__filter_bucket", words.alias("__filter_map"))

    def _bucket(self, h):
        return F.pmod(h, F.lit(self.n))

    @staticmethod
    def _bits(h):
        return F.pmod(F.shiftright(h, 17), F.lit(FILTER_BITS)), F.pmod(F.shiftright(h, 37), F.lit(FILTER_BITS))

    def flag(self, df: DataFrame, key: str) -> DataFrame:
        """Adds ``__maybe``: false only where the row's key is certainly not in the filter (or null)."""

        def has(pos):
            word = F.get("__filter_map", F.shiftright(pos, 5).cast("int"))
            byte, bit = F.shiftright(pos, 3).bitwiseAND(F.lit(3)), pos.bitwiseAND(F.lit(7))  # the first byte of a word is its highest
            return F.getbit(word, (24 - 8 * byte + bit).cast("int")) == 1

        h = F.xxhash64(F.col(key))
        out = df.withColumn("__filter_bucket", self._bucket(h)).join(F.broadcast(self.table), "__filter_bucket", "left")
        found = [F.coalesce(has(pos), F.lit(False)) for pos in self._bits(h)]
        return out.select(*df.columns, (F.col(key).isNotNull() & found[0] & found[1]).alias("__maybe"))

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        """Rows of ``df`` whose key may be in the filter (a superset of those whose key is)."""
        return self.flag(df, key).where("__maybe").drop("__maybe")


def with_edits(docs: DataFrame, edits: DataFrame, column: str) -> DataFrame:
    """``docs`` with ``column`` of ``edits`` (one row a ``doc_id``), null where there is none.

    Only rows that pass a filter over the edited ids are shuffled; the others never
    leave their task.  The edits grow with the corpus, so at no size are they broadcast.
    """
    flagged = MembershipFilter(edits, "doc_id", edits.count()).flag(docs, "doc_id")
    maybe = flagged.where("__maybe").join(edits.select("doc_id", column).hint("merge"), "doc_id", "left")
    never = flagged.where("not __maybe").withColumn(column, F.lit(None).cast(edits.schema[column].dataType))
    return maybe.select(*docs.columns, column).unionByName(never.select(*docs.columns, column))


#: A key with this share of all rows is hot. At most 1 / HOT_SHARE keys can be, which bounds their broadcast.
HOT_SHARE = 0.001


def join_skewed(rows: DataFrame, table: DataFrame, key: str | list[str], count: str, n_rows: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table`` (unique in the columns of ``key``), whose ``count`` says how many rows have the key.

    Hot keys meet their rows by broadcast: at most ``1 / HOT_SHARE`` keys can have
    that share of the rows, so its size is bounded whatever the data.  Their rows
    are then spread over the tasks of the second join, none of whose keys is hot.
    """
    key = [key] if isinstance(key, str) else key
    values = [c for c in table.columns if c not in key]
    hot = F.col(count) >= max(2, n_rows * HOT_SHARE)
    few = table.where(hot).select(*key, F.struct(*values).alias("__hot"))
    rest = table.where(~hot).select(*key, F.struct(*values).alias("__rest"), F.lit(0).alias("__salt"))
    out = rows.join(F.broadcast(few), key, "left")
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int"))
    out = out.withColumn("__salt", salt).join(rest, [*key, "__salt"], "left")
    found = F.coalesce("__hot", "__rest")
    out = out.select(*rows.columns, *(found[c].alias(c) for c in values), found.isNotNull().alias("__found"))
    return (out if how == "left" else out.where("__found")).drop("__found")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as rows ``(u, v)`` of longs.

    Returns ``(node, component)`` for every node that has an edge to another
    node; ``component`` is the smallest node reachable.  Alternating large-star
    and small-star rounds (Kiveris et al., "Connected Components in MapReduce
    and Beyond", 2014): each round hangs the neighbours of a node below their
    minimum, and the rounds end when the edges are stars.  Edges stay in Spark
    tables; the driver sees one count and one checksum a round.
    """

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(pairs, keep):
        """Each ``v`` next to ``u`` gets an edge to the minimum around ``u``."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))

    with scratch_scope(edges.sparkSession):
        e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = materialize(e, "cc")
        before = state(e)
        while before[0]:  # each round lowers some node until none is left to lower, so this ends
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = star(both, F.col("v") > F.col("u")).where("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v"))
            )
            e = materialize(small.where("u <> v").distinct(), "cc")
            after = state(e)
            if after == before:
                break
            before = after
        e = result(e, "components")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
