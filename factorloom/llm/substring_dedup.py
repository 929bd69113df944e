"""Removal of long repeated byte strings by suffix arrays over shards of text.

A string of ``length`` bytes is removed where it also starts elsewhere.  Shards
come from a rule that every copy of a string obeys alike: each window of
``length`` bytes belongs to its anchor, the leftmost of its 32-byte grams with the
least hash.  Neighbouring windows with one anchor form a context, which holds
every byte of its windows; on average a context owns some 190 windows.

1. One pass over the texts lists contexts (anchor key, 128-bit hash, place), no bytes.
2. Contexts that are equal as a whole, whatever their number, repeat as a whole;
   they are counted with map-side sums, so mass copies never meet in one task.
3. Only where one anchor key has several different contexts are bytes needed.
   These contexts are cut into parts by classes of neighbouring distances to the
   anchor.  All windows of a class share a core of bytes, so equal windows have
   equal cores: the parts with one core are what has to stay together.  Equal parts
   are counted, and one of each is sent to the shard of its core, which sorts its
   suffixes by induced sorting and reads repeats off the permuted common prefixes.
   A shard is sorted whenever it is full.  A core with too many different parts for
   one shard is dealt out by narrower classes, whose cores are longer, and so on.
4. Repeated windows go back to every place of their context, are merged by
   document, and only documents with any are joined with their text again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import MembershipFilter, forget_words, join_skewed, map_batches, materialize, result, scratch_scope, texts_of, with_edits
from factorloom.llm.rolling import RangeHash, mix
from factorloom.llm.suffix_arrays import common_prefixes, suffix_array

LENGTH = 400
GRAM = 32
CLASS = 64  # windows of a part, at most
CORE_PARTS = 256  # different parts with one core that a shard takes; beyond, classes are a quarter as wide
SHARD_BYTES = 150_000
BLOCK_BYTES = 250_000  # of texts that are hashed together

CONTEXT_SCHEMA = "key long, c0 long, c1 long, doc_id long, start long, windows int, place int"
PART_SCHEMA = "g0 long, g1 long, h0 long, h1 long, u0 long, u1 long, lo int, windows int, place int, doc_id long, start long"
RUNS = "array<struct<lo:long,hi:long>>"
RUN_TYPE = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, from running minima of aligned blocks."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def contexts_of(block: np.ndarray, lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Contexts of texts laid end to end: first window, number of windows, key, place of the anchor in the context.

    Windows that would cross from one text into the next belong to no context.
    """
    width = length - GRAM + 1
    ranges = RangeHash(block)
    at = np.arange(len(block) - GRAM + 1)
    grams = mix(ranges.of(at, at + GRAM))
    ranked = (grams & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    anchor = (sliding_least(ranked, width) & np.uint64(0xFFFFFF)).astype(np.int64)
    n = len(anchor)
    inside = np.zeros(n + 1, np.int64)
    begin = np.cumsum(lengths) - lengths
    long_ = lengths >= length
    np.add.at(inside, begin[long_], 1)
    np.add.at(inside, np.minimum(begin[long_] + lengths[long_] - length + 1, n), -1)
    inside = np.cumsum(inside[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    edge = np.zeros(n, bool)
    edge[begin[long_]] = True
    first = np.flatnonzero((new | edge) & inside)
    stop = np.flatnonzero(np.append((new | edge | ~inside)[1:], True) & inside) + 1
    return first, stop - first, grams[anchor[first]].view(np.int64), anchor[first] - first


def _blocks(batch, length: int):
    """Rows of an Arrow batch as blocks of long enough texts: id, offset in the text, bytes.

    A text beyond ``BLOCK_BYTES`` comes in slices that overlap by ``length - 1``
    bytes, so every window is in exactly one slice.
    """
    held, size = [], 0
    for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
        data = value.as_py()
        for lo in range(0, len(data) - length + 1, BLOCK_BYTES):
            part = data[lo : lo + BLOCK_BYTES + length - 1]
            if held and size + len(part) > BLOCK_BYTES:
                yield held
                held, size = [], 0
            held.append((doc_id, lo, part))
            size += len(part)
    if held:
        yield held


def _two_longs(digests: list[bytes]) -> list[pa.Array]:
    codes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(codes[:, k]), pa.int64()) for k in (0, 1)]


def list_contexts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All contexts: ``key``, ``c0, c1`` (hash of its bytes and anchor place), ``doc_id, start, windows, place``."""

    def run(batches):
        forget_words()
        for batch in batches:
            for held in _blocks(batch, length):
                data = b"".join(part for _, _, part in held)
                sizes = np.array([len(part) for _, _, part in held])
                first, windows, key, place = contexts_of(np.frombuffer(data, np.uint8), sizes, length)
                of = np.searchsorted(np.cumsum(sizes), first, side="right")
                begin = np.cumsum(sizes) - sizes
                ids = np.array([d for d, _, _ in held], np.int64)
                offsets = np.array([lo for _, lo, _ in held], np.int64)
                view, h = memoryview(data), xxhash.xxh3_128_digest
                ends = (first + windows + length - 1).tolist()
                codes = _two_longs([h(view[a:b], p) for a, b, p in zip(first.tolist(), ends, place.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key), *codes, pa.array(ids[of]), pa.array(first - begin[of] + offsets[of]),
                        pa.array(windows.astype(np.int32)), pa.array(place.astype(np.int32)),
                    ],
                    ["key", "c0", "c1", "doc_id", "start", "windows", "place"],
                )

    return docs.transform(map_batches, run, CONTEXT_SCHEMA)


def _with_texts(docs: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """``text, wanted`` of the documents that ``wanted`` (``doc_id`` and ``columns``) names, a list for each.

    A document's list is no longer than the document, as its strings differ in start or in class.
    """
    by_doc = materialize(wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("wanted")), "wanted")
    found = MembershipFilter(by_doc, "doc_id", by_doc.count()).apply(docs, "doc_id").join(by_doc, "doc_id")
    return found.select("doc_id", "text", "wanted")


def _strings(batch, length: int):
    """Documents of a batch with their wanted strings: id, and (fields, bytes) of those whose bytes have the wanted hash.

    The hash rules out another text under the same ``doc_id``.
    """
    h = xxhash.xxh3_128_digest
    lists = batch.column("wanted")
    for k in range(batch.num_rows):
        data, wanted = batch.column("text")[k].as_py().encode("utf-8"), lists[k].values
        columns = {f.name: wanted.field(f.name).to_pylist() for f in wanted.type}
        rows = [dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)]
        for row in rows:
            part = data[row["start"] : row["start"] + row["windows"] + length - 1]
            if h(part, row["place"]) == row["h0"].to_bytes(8, "little", signed=True) + row["h1"].to_bytes(8, "little", signed=True):
                yield batch.column("doc_id")[k].as_py(), row, part


def _parts(docs: DataFrame, strings: DataFrame, length: int, width: int) -> DataFrame:
    """Parts of ``strings`` (``h0, h1, doc_id, start, windows, place``) by classes of ``width`` distances to the anchor.

    ``g0, g1`` is the hash of a part's core and class, ``h0, h1`` of its bytes and
    place, ``u0, u1`` the string's, ``lo`` the part's first window in it.
    """
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in PART_SCHEMA.split(", ")]

    def run(batches):
        forget_words()
        h = xxhash.xxh3_128_digest
        for batch in batches:
            cores, parts, strings, rows = [], [], [], []

            def flushed(cores, parts, strings, rows):
                cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                codes = [*_two_longs(cores), *_two_longs(parts), *_two_longs(strings)]
                return pa.RecordBatch.from_arrays([*codes, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

            for doc_id, row, data in _strings(batch, length):
                windows, place = row["windows"], row["place"]
                own = h(data, place)
                lo = 0
                while lo < windows:
                    rank = (place - lo) // width
                    core = place - rank * width
                    hi = min(windows, core + 1)  # windows lo..hi-1 have this rank
                    cores.append(h(data[core : core + length - width + 1], rank))
                    parts.append(h(data[lo : hi + length - 1], place - lo))
                    strings.append(own)
                    rows.append((lo, hi - lo, place - lo, doc_id, row["start"] + lo))
                    lo = hi
                if len(rows) > 20_000:
                    yield flushed(cores, parts, strings, rows)
                    cores, parts, strings, rows = [], [], [], []
            yield flushed(cores, parts, strings, rows)

    return _with_texts(docs, strings, ["h0", "h1", "start", "windows", "place"]).transform(map_batches, run, PART_SCHEMA)


def merged_runs(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end of the unions of runs that touch or overlap; owners are small and ascending."""
    if not len(lo):
        return owner, lo, hi
    order = np.lexsort((lo, owner))
    owner, lo, hi = owner[order], lo[order], hi[order]
    shift = owner * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.append(True, (lo + shift)[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return owner[first], lo[first], reach[last] - shift[last]


def _run_lists(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> pa.Array:
    """Arrow lists of merged runs for owners 0 to n - 1."""
    owner, lo, hi = merged_runs(owner, lo, hi)
    offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["lo", "hi"]))


def repeats_in_shard(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, first window and window behind the last of each run of windows that start twice or more in the shard."""
    sizes = np.array([len(p) for p in parts])
    s = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8).astype(np.int32) + 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    s[begin + sizes] = 1
    s[-1] = 0
    sa = suffix_array(s, 258)
    ordered = common_prefixes(s, sa, length)[sa] >= length
    repeats = np.zeros(len(s) + 1, np.int8)
    repeats[sa[ordered]] = 1
    repeats[sa[:-1][ordered[1:]]] = 1
    edges = np.zeros(len(s) + 1, np.int8)  # windows that would reach over a part's end do not count
    edges[begin] = 1
    edges[begin + sizes - length + 1] = -1
    repeats &= np.cumsum(edges, dtype=np.int8)
    steps = np.diff(repeats, prepend=np.int8(0))
    lo, hi = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    of = np.searchsorted(begin, lo, side="right") - 1
    return of, lo - begin[of], hi - begin[of]


def _sorted_shards(docs: DataFrame, parts: DataFrame, length: int) -> DataFrame:
    """``h0, h1, runs`` of the windows of ``parts`` that repeat among the parts with one core."""

    def cut(batches):
        names = ["g0", "g1", "h0", "h1", "bytes"]
        for batch in batches:
            rows, size = [], 0
            for _, row, data in _strings(batch, length):
                rows.append((row["g0"], row["g1"], row["h0"], row["h1"], data))
                size += len(data)
                if size > 4 * BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    def sort(batches):
        forget_words()
        ids, parts, size, last = [], [], 0, None

        def flushed():
            of, lo, hi = repeats_in_shard(parts, length)
            some = np.unique(of)
            codes = np.array(ids, np.int64).reshape(-1, 2)[some]
            runs = _run_lists(np.searchsorted(some, of), lo, hi, len(some))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(codes[:, 0])), pa.array(np.ascontiguousarray(codes[:, 1])), runs], ["h0", "h1", "runs"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("g0", "g1", "h0", "h1")]
            for g0, g1, h0, h1, data in zip(*cols, batch.column("bytes"), strict=True):
                if (g0, g1) != last:
                    last = (g0, g1)
                    if size > SHARD_BYTES:
                        yield flushed()
                        ids, parts, size = [], [], 0
                value = data.as_py()
                ids.append((h0, h1))
                parts.append(value)
                size += len(value)
        if parts:
            yield flushed()

    cutting = _with_texts(docs, parts, ["g0", "g1", "h0", "h1", "start", "windows", "place"])
    strings = cutting.transform(map_batches, cut, "g0 long, g1 long, h0 long, h1 long, bytes binary")
    return strings.repartition("g0", "g1").sortWithinPartitions("g0", "g1").transform(map_batches, sort, f"h0 long, h1 long, runs {RUNS}")


def _whole(windows: str):
    """The run of all windows."""
    return F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col(windows).cast("long").alias("hi"))).alias("runs")


def _repeats(docs: DataFrame, strings: DataFrame, length: int, width: int, most: int) -> DataFrame:
    """``u0, u1, runs`` of windows of ``strings`` that also occur in another string with the same anchor."""
    parts = materialize(_parts(docs, strings, length, width), "parts")
    first = [F.first(c).alias(c) for c in ("g0", "g1", "windows", "place", "doc_id", "start")]  # of one row, as each takes the group's first
    distinct = materialize(parts.groupBy("h0", "h1").agg(F.count("*").alias("n"), *first), "distinct-parts")
    cores = materialize(distinct.groupBy("g0", "g1").agg(F.count("*").alias("d")).where("d > 1"), "cores")
    shared = MembershipFilter(cores, "g0", cores.count()).apply(distinct.drop("n"), "g0").join(cores, ["g0", "g1"])
    found = distinct.where("n > 1").select("h0", "h1", _whole("windows"))
    found = found.unionByName(_sorted_shards(docs, shared.where(F.col("d") <= most), length))
    if width > 1 and not cores.where(F.col("d") > most).isEmpty():
        crowded = shared.where(F.col("d") > most).drop("g0", "g1", "d")
        deeper = _repeats(docs, crowded, length, max(1, width // 4), most)
        found = found.unionByName(deeper.select(F.col("u0").alias("h0"), F.col("u1").alias("h1"), "runs"))
    found = found.groupBy("h0", "h1").agg(F.flatten(F.collect_list("runs")).alias("runs")).join(distinct.select("h0", "h1", "n"), ["h0", "h1"])
    found = materialize(found, "part-repeats")
    places = MembershipFilter(found, "h0", found.count()).apply(parts.select("h0", "h1", "u0", "u1", "lo"), "h0")
    places = join_skewed(places, found, ["h0", "h1"], "n", parts.count(), "inner")
    places = places.select("u0", "u1", F.expr("transform(runs, r -> struct(lo + r.lo as lo, lo + r.hi as hi))").alias("runs"))
    return places.groupBy("u0", "u1").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, core_parts: int = CORE_PARTS) -> DataFrame:
    """``doc_id, spans``: the maximal byte runs to remove, for documents that have any.

    A byte is in a span when a string of ``length`` bytes that covers it also
    starts anywhere else in ``docs``, in the same document or another.
    """
    docs = texts_of(docs).where("doc_id is not null")
    with scratch_scope(docs.sparkSession):
        contexts = materialize(list_contexts(docs, length), "contexts")
        first = [F.first(c).alias(c) for c in ("key", "doc_id", "start", "windows", "place")]
        distinct = materialize(contexts.groupBy("c0", "c1").agg(F.count("*").alias("n"), *first), "distinct")
        keys = materialize(distinct.groupBy("key").agg(F.count("*").alias("d")).where("d > 1").select("key"), "keys")
        hard = MembershipFilter(keys, "key", keys.count()).apply(distinct, "key").join(keys, "key")
        hard = hard.select(F.col("c0").alias("h0"), F.col("c1").alias("h1"), "doc_id", "start", "windows", "place")
        found = _repeats(docs, hard, length, CLASS, core_parts).select(F.col("u0").alias("c0"), F.col("u1").alias("c1"), "runs")
        found = found.unionByName(distinct.where("n > 1").select("c0", "c1", _whole("windows")))
        found = found.groupBy("c0", "c1").agg(F.flatten(F.collect_list("runs")).alias("runs")).join(distinct.select("c0", "c1", "n"), ["c0", "c1"])
        found = materialize(found, "repeats")

        places = MembershipFilter(found, "c0", found.count()).apply(contexts.select("c0", "c1", "doc_id", "start"), "c0")
        places = join_skewed(places, found, ["c0", "c1"], "n", contexts.count(), "inner")
        runs = places.select("doc_id", F.expr(f"transform(runs, r -> struct(start + r.lo as lo, start + r.hi + {length - 1} as hi))").alias("runs"))

        def merge(batches):
            for batch in batches:
                lists = batch.column("runs")
                owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
                flat = lists.flatten()
                spans = _run_lists(owner, flat.field("lo").to_numpy(), flat.field("hi").to_numpy(), batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], ["doc_id", "spans"])

        by_doc = runs.groupBy("doc_id").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        return result(by_doc.transform(map_batches, merge, f"doc_id long, spans {RUNS}"), "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs`` with a ``doc_id``.

    Null and empty texts have no bytes and lose none.  Rows with a null ``doc_id``
    are left out.  Identical rows under one ``doc_id`` are the same text at one
    place twice: their strings start at two places and go.
    """
    docs = docs.where("doc_id is not null")
    rows = with_edits(texts_of(docs), repeated_spans(docs, length), "spans")
    plain = rows.where("spans is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )

    def cut(batches):
        for batch in batches:
            out = [[], [], [], []]
            for value, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data = value.as_py().encode("utf-8")
                kept = _outside(data, spans)
                for col, x in zip(out, (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.where("spans is not null").transform(map_batches, cut, schema).unionByName(plain)


def _outside(data: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for span in spans:
        out.append(data[at : span["lo"]])
        at = span["hi"]
    return b"".join([*out, data[at:]])


def strip_repeats(docs: DataFrame, length: int = LENGTH, over_words: int | None = None) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (and ``n_chars`` of the rest); all rows stay.

    A character that is only partly covered by a removed run stays whole.  With
    ``over_words``, a run below ``LENGTH`` bytes goes only if it has more words than that.
    """
    rows = with_edits(docs, repeated_spans(docs, length).withColumnRenamed("spans", "__spans"), "__spans")

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for text, runs in zip(texts, spans, strict=True):
            if text is None or runs is None:
                out.append(text)
                continue
            data, whole = text.encode("utf-8"), []
            for run in runs:
                lo, hi = run["lo"], run["hi"]
                while lo < len(data) and data[lo] & 0xC0 == 0x80:
                    lo += 1
                while hi < len(data) and data[hi] & 0xC0 == 0x80:
                    hi -= 1
                if lo < hi and (over_words is None or hi - lo >= LENGTH or len(data[lo:hi].split()) > over_words):
                    whole.append({"lo": lo, "hi": hi})
            out.append(_outside(data, whole).decode("utf-8"))
        return type(texts)(out)

    changed = rows.where("__spans is not null").withColumn("text", cut("text", "__spans"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast("long"))
    return changed.unionByName(rows.where("__spans is null")).select(*docs.columns)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``remove_repeats`` over the whole of ``documents``, and ``changed``: does the document lose bytes?"""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("changed", F.col("n_removed") > 0)
