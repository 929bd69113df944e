"""SimHash near-dedup by anchor-point covering.

Two fingerprints of 64 bits that differ in at most 4 bits differ in at most 2
within one of their halves.  On a half of 32 bits the anchors are the words of a
Hamming code of length 31, with the last bit free: its covering radius is 1.  The
midpoint of two halves that differ in at most 2 bits is within 1 of both, and some
anchor is within the covering radius of the midpoint; so both fingerprints lie
within 1 (their share of the threshold) + 1 (the radius) = 2 of a common anchor.
Each half is sent to all anchors within 2, 16.5 on average of 2**27, and
fingerprints are compared where they meet.

An anchor that very many fingerprints share is dealt out further: two of its
fingerprints within 4 bits differ in at most 2 within one of the quarters of the
other half, and quarters have anchors of their own, of a Hamming code of length 15.

Fingerprints of several words reach farther: ``bits_apart`` of a similarity is the
expected number of differing bits and some deviations more, and texts are candidates
up to it.  Candidates link if the sets of their shingles have the similarity asked for,
exactly.  Fingerprints alone would leave links out: those of pairs that differ in more bits
or meet at no anchor, and those that a forest of candidates spans by pairs that then fail.
So the sets go on where the fingerprints end: two sets of the similarity share one of the
first fifth or so of their shingles in any fixed order (the prefix filter of set similarity
joins), and what meets there across the components found so far is compared as well.

Fingerprints are distinct before that, so copies cost nothing, and every anchor
gives back a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import MembershipFilter, connected_components, forget_words, join_skewed, map_batches, materialize, result, scratch_scope, texts_of, with_edits
from factorloom.llm.line_dedup import bucket_bits, repeated_prefixes
from factorloom.llm.rolling import mix

SHINGLE_WORDS = 4
SEED = 42
THRESHOLD = 4
SCAN = 16  # up to so many fingerprints of an anchor are compared all at once
ANCHORS_A_BLOCK = 17  # of 32 bits, about
CROWD = 4096  # an anchor with more fingerprints is dealt out by quarters
SETS_AT_ONCE = 256  # sets of shingles that a task holds
ODD_WORDS = 8  # words of 64 bits that tell which classes of shingles a set has an odd number of
ORDER_DOCS, ORDER_LEAST, ORDER_MOST = 20_000, 4, 65_536  # documents that the order is fitted on; its frequent shingles


def bits_apart(similarity: float, n_words: int, spare: float = 0.0) -> int:
    """Bits in which fingerprints of ``n_words`` times 64 bits of two equally long texts of that Jaccard similarity differ,
    and ``spare`` standard deviations more.

    Their shingle vectors have the cosine 2 s / (1 + s), and a bit differs with the share of their angle in a half turn.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(64 * n_words * share + spare * math.sqrt(64 * n_words * share * (1 - share)))


def _ones(codes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit codes have each bit."""
    lanes = np.unpackbits(codes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)  # a byte a bit, eight to a lane
    full = len(lanes) // 255 * 255
    sums = lanes[:full].reshape(-1, 255, 8).sum(axis=1)  # 255 ones fit a byte
    rest = lanes[full:].sum(axis=0, keepdims=True)
    return np.concatenate([sums, rest]).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def shingle_hashes(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; of the whole sequence where it has fewer words."""
    tokens = text.encode("utf-8").lower().split()  # ASCII letters and ASCII white space only
    if not tokens:
        return np.zeros(0, "<u8")
    data = b" ".join(tokens)
    h = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([h(data, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([h(data[a:b], seed) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED, n_words: int = 1) -> bytes:
    """SimHash of a text's word shingles (XXH64), little-endian: a bit is set where over half the hashes, repeats
    included, have it.  Words after the first take further hashes mixed from the first."""
    return fingerprint_of(shingle_hashes(text, words, seed), n_words)


def fingerprint_of(codes: np.ndarray, n_words: int = 1) -> bytes:
    """``fingerprint`` of a text with these shingle hashes."""
    if not len(codes):
        return bytes(8 * n_words)
    out = []
    for k in range(n_words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(codes), 1 << 14):
            part = codes[at : at + (1 << 14)]
            ones += _ones(mix(part + np.uint64(k)) if k else part)
        out.append(np.packbits(2 * ones > len(codes), bitorder="little").tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, n_words: int = 1) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bytes) and ``words`` (the same as longs)."""

    def run(batches):
        forget_words()
        for batch in batches:
            fps = [fingerprint(v.as_py(), words, n_words=n_words) for v in batch.column("text")]
            longs = pa.array(np.frombuffer(b"".join(fps), "<i8"), pa.int64())
            offsets = pa.array(np.arange(len(fps) + 1, dtype=np.int32) * np.int32(n_words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary()), pa.ListArray.from_arrays(offsets, longs)], ["doc_id", "fp", "words"])

    return texts_of(docs).transform(map_batches, run, "doc_id long, fp binary, words array<long>")


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Ascending hashes of shingles that several of at most about ``ORDER_DOCS`` documents have.

    They only come last in the order of ``prefix_of``: any order finds all, and this one keeps what very many
    documents share out of most prefixes.
    """
    docs = texts_of(docs.where("doc_id is not null"))
    every = max(1, docs.count() // ORDER_DOCS)

    def sets(batches):
        for batch in batches:
            for value in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(value.as_py(), words)).view(np.int64))], ["code"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).transform(map_batches, sets, "code long")
    some = some.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= ORDER_LEAST).orderBy(F.desc("n"), "code").limit(ORDER_MOST)
    return np.sort(np.array([r["code"] for r in some.select("code").collect()], np.int64).view(np.uint64))


def prefix_of(ascending: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set: sets of that Jaccard similarity share one of them.  Frequent ones come last, else by hash.

    The sets share a part of ``similarity`` of either at least, so no more than the rest of a set can come before its first shared shingle.
    """
    size = len(ascending) - math.ceil(similarity * len(ascending) - 1e-9) + 1
    if not len(ascending) or not len(frequent):
        return ascending[:size]
    at = np.minimum(np.searchsorted(frequent, ascending), len(frequent) - 1)
    often = frequent[at] == ascending
    return np.concatenate([ascending[~often], ascending[often]])[:size]


def set_digests(docs: DataFrame, words: int, n_words: int) -> DataFrame:
    """``fingerprints`` with the ``digest`` of the set of shingles and its ``size``."""

    def run(batches):
        forget_words()
        for batch in batches:
            fps, digests, sizes = [], [], []
            for value in batch.column("text"):
                codes = shingle_hashes(value.as_py(), words)
                own = np.unique(codes)
                fps.append(fingerprint_of(codes, n_words))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
            longs = _lists([np.frombuffer(x, "<i8") for x in fps])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary()), longs, pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())], ["doc_id", "fp", "words", "digest", "size"])

    return texts_of(docs).transform(map_batches, run, "doc_id long, fp binary, words array<long>, digest binary, size int")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()))


def parities(codes: np.ndarray, words: int) -> np.ndarray:
    """By bit, has the class of codes an odd number in the set?  64 classes a word, a power of two.

    Sets differ in one code for each differing bit at least.  Words of twice the number fold to these by an exclusive or of their halves.
    """
    classes = (codes >> np.uint64(20)) & np.uint64(64 * words - 1)
    return np.packbits((np.bincount(classes.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8), bitorder="little").view("<i8")


def shingle_prefixes(docs: DataFrame, points: DataFrame, words: int, similarity: float) -> DataFrame:
    """``id, digest, size, odd, sketch, prefix`` of the sets of documents that ``points`` (``id``) may name.

    ``odd`` are parities in ``ODD_WORDS`` words, ``sketch`` in as many as the set has shingles for bits at least.
    """
    frequent = frequent_shingles(docs, words)
    asked = MembershipFilter(points, "id", points.count()).apply(texts_of(docs).withColumnRenamed("doc_id", "id"), "id")

    def run(batches):
        forget_words()
        for batch in batches:
            for at in range(0, batch.num_rows, SETS_AT_ONCE):
                part = batch.slice(at, SETS_AT_ONCE)
                sets = [np.unique(shingle_hashes(v.as_py(), words)) for v in part.column("text")]
                cols = [part.column("id"), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32())]
                cols.append(_lists([parities(x, ODD_WORDS) for x in sets]))
                cols.append(pa.array([parities(x, max(ODD_WORDS, 1 << max(0, len(x) - 1).bit_length() >> 6)).tobytes() for x in sets], pa.binary()))
                cols.append(_lists([prefix_of(x, frequent, similarity).view(np.int64) for x in sets]))
                yield pa.RecordBatch.from_arrays(cols, ["id", "digest", "size", "odd", "sketch", "prefix"])

    return asked.transform(map_batches, run, "id long, digest binary, size int, odd array<long>, sketch binary, prefix array<long>")


def links_at_prefixes(sets: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """Candidates ``(u, v)``: all pairs of different ``part`` whose sets may have that Jaccard similarity, and few others.

    ``sets`` are ``shingle_prefixes``, ``points`` has ``id, digest, part`` of those that count.
    """
    # shingles of one prefix only are left out first, then those that meet in one component only
    keys = sets.select("id", "digest", F.explode("prefix").alias("key"))
    bits = bucket_bits(4 * points.count())
    repeated = materialize(repeated_prefixes(keys, bits), "repeated-shingles")
    keys = keys.withColumn("prefix", F.shiftrightunsigned("key", 32 - bits))
    keys = MembershipFilter(repeated, "prefix", repeated.count()).apply(keys, "prefix").select("id", "digest", "key")
    keys = materialize(keys.join(points.select("id", "digest", "part").hint("merge"), ["id", "digest"]), "prefix-shingles")
    shared = keys.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    shared = materialize(shared.where("a <> b").select("key"), "shared-shingles")
    sets = sets.join(points.select("id", "digest").hint("merge"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    odd = [F.element_at("odd", k + 1).alias(f"o{k}") for k in range(ODD_WORDS)]
    rows = MembershipFilter(shared, "key", shared.count()).apply(keys, "key")
    rows = rows.join(sets.select("id", "digest", "size", *odd).hint("merge"), ["id", "digest"])
    names = ["key", "part", "id", "size", *(f"o{k}" for k in range(ODD_WORDS))]

    def run(batches):
        held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            cut = np.searchsorted(rows[0], rows[0][-1])  # the last shingle may go on in the next batch
            held = [r[cut:] for r in rows]
            yield from _across([r[:cut] for r in rows], similarity)
        if held is not None:
            yield from _across(held, similarity)

    rows = rows.select(*names).repartition("key").sortWithinPartitions("key")
    pairs = materialize(rows.transform(map_batches, run, "u long, v long").distinct(), "prefix-pairs")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")).hint("merge")

    def sift(batches):
        for batch in batches:
            near = []
            for x, y, m, n in zip(*(batch.column(c) for c in ("sketch_u", "sketch_v", "size_u", "size_v")), strict=True):
                a, b = sorted((np.frombuffer(s.as_py(), "<u8") for s in (x, y)), key=len)
                while len(b) > len(a):
                    b = b[: len(b) // 2] ^ b[len(b) // 2 :]
                near.append(np.bitwise_count(a ^ b).sum() <= (m.as_py() + n.as_py()) * (1 - similarity) / (1 + similarity) + 1e-6)
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("u", "v")], ["u", "v"])

    return pairs.join(side("u"), "u").join(side("v"), "v").transform(map_batches, sift, "u long, v long")


def _across(rows: list[np.ndarray], similarity: float):
    """Pairs of rows of one key and different parts that sizes and parities allow; rows are sorted by key."""
    key, part, ids, size = rows[:4]
    odd = np.stack([x.view(np.uint64) for x in rows[4:]], axis=1)
    apart = (1 - similarity) / (1 + similarity)  # the share of both sets' sizes in which they differ at most

    def may(a, b):
        most, least = np.maximum(size[a], size[b]), np.minimum(size[a], size[b])
        near = (part[a] != part[b]) & (least >= similarity * most - 1e-6)
        return near & (np.bitwise_count(odd[a] ^ odd[b]).sum(axis=-1, dtype=np.int64) <= apart * (most + least) + 1e-6)

    def batch_of(u, v):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(key)))
    small = np.repeat(sizes <= SCAN, sizes)
    for step in range(1, min(SCAN, int(sizes.max(initial=1)))):
        at = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
        at = at[may(at, at + step)]
        yield batch_of(ids[at], ids[at + step])
    for k in np.flatnonzero(sizes > SCAN):
        for at in range(first[k], first[k] + sizes[k] - 1):
            rest = np.arange(at + 1, first[k] + sizes[k])
            rest = rest[may(at, rest)]
            if len(rest):
                yield batch_of(np.full(len(rest), ids[at]), ids[rest])


def anchor_masks(checks: int = 5) -> list[list[int]]:
    """By syndrome, what turns a block of ``2**checks`` bits into each anchor within 2: bit p-1 is position p of the
    code, the last bit the free bit."""
    size = 1 << checks
    free = 1 << (size - 1)
    out = [[0, free]]
    for s in range(1, size):
        one = one_of(s)
        two = [one_of(p) | one_of(p ^ s) for p in range(1, size) if p < p ^ s]
        out.append([one, one | free, *two])
    return out


def one_of(position: int) -> int:
    return 1 << (position - 1)


def anchors(block: Column, checks: int = 5) -> Column:
    """Array of all anchors within 2 of a block (a long below ``2**2**checks``)."""
    syndrome = F.lit(0)
    for k in range(checks):
        checked = sum(one_of(p) for p in range(1, 1 << checks) if p >> k & 1)
        syndrome = syndrome + F.shiftleft(F.bit_count(block.bitwiseAND(F.lit(checked))) % 2, k)
    # one literal, as hundreds of them in every block would cost the driver seconds to plan
    masks = F.from_json(F.lit(json.dumps(anchor_masks(checks))), "array<array<bigint>>")
    return F.transform(F.element_at(masks, syndrome + 1), lambda m: m.bitwiseXOR(block))


def _tagged_anchors(words: Column, n_words: int, checks: int) -> Column:
    """Anchors of all blocks of ``2**checks`` bits, in the higher bits the number of the block."""
    size, out = 1 << checks, []
    for b in range(64 * n_words // size):
        block = F.shiftrightunsigned(F.element_at(words, b * size // 64 + 1), b * size % 64).bitwiseAND(F.lit((1 << size) - 1))
        tag = F.lit(b << 32).cast("long")
        out.append(F.transform(anchors(block, checks), lambda a: a + tag))  # noqa: B023  called at once
    return F.concat(*out)


def crowded_anchors(sent: DataFrame, n_rows: int, crowd: int) -> DataFrame | None:
    """``anchor, n`` of the anchors with more than ``crowd`` rows of ``sent`` (about ``n_rows``); None where there are none.

    Nearly all anchors differ, so a sum for each would fill a task's memory.  They are summed up in buckets of about a quarter
    of ``crowd`` first; an anchor is counted by itself only where its bucket has more than ``crowd``.
    """
    bucketed = sent.select("anchor", F.pmod(F.xxhash64("anchor"), F.lit(max(1, 4 * n_rows // max(1, crowd)))).alias("bucket"))
    full = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("bucket")
    full = materialize(full, "full-buckets")
    if full.isEmpty():
        return None
    some = MembershipFilter(full, "bucket", full.count()).apply(bucketed, "bucket")
    crowds = materialize(some.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "crowds")
    return None if crowds.isEmpty() else crowds


def links_at_anchors(points: DataFrame, threshold: int = THRESHOLD, n_words: int = 1, crowd: int = CROWD) -> DataFrame:
    """Links ``(u, v)`` of ids whose fingerprints differ in at most ``threshold`` bits.

    ``points`` has distinct ``fp`` with ``words`` and an ``id``.  With one word and
    a threshold up to 4 the links span: two ids are connected by them exactly when
    they are by all links.
    """
    sent = points.select("fp", "id", "words", F.explode(_tagged_anchors(F.col("words"), n_words, 5)).alias("anchor"))
    crowds = crowded_anchors(sent, points.count() * 2 * n_words * ANCHORS_A_BLOCK, crowd)
    plain = sent
    if crowds is not None:
        flagged = MembershipFilter(crowds, "anchor", crowds.count()).flag(sent, "anchor")
        # anchors beyond crowd are few: rows of anchors divided by crowd at most; rows meet them in a join that is split where skewed
        maybe = flagged.where("__maybe").join(crowds.hint("merge"), "anchor", "left")
        quarters = F.filter(_tagged_anchors(F.col("words"), n_words, 4), lambda q: F.shiftright(q, 33) != F.shiftright("anchor", 32))
        crowded = maybe.where("n is not null").select("fp", "id", "anchor", F.explode(quarters).alias("quarter"))
        plain = flagged.where("not __maybe").select("fp", "id", "anchor").unionByName(maybe.where("n is null").select("fp", "id", "anchor"))
        plain = plain.unionByName(crowded.select("fp", "id", F.xxhash64("anchor", "quarter").alias("anchor")))

    def run(batches):
        held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("anchor", "id")]
            rows.append(np.frombuffer(b"".join(batch.column("fp").to_pylist()), "<u8").reshape(-1, n_words))
            if held is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            cut = np.searchsorted(rows[0], rows[0][-1])  # the last anchor may go on in the next batch
            held = [r[cut:] for r in rows]
            yield _forest(*(r[:cut] for r in rows), threshold)
        if held is not None:
            yield _forest(*held, threshold)

    return plain.select("anchor", "id", "fp").repartition("anchor").sortWithinPartitions("anchor").transform(map_batches, run, "u long, v long")


def _near(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= threshold


def _forest(anchor, ids, fp, threshold) -> pa.RecordBatch:
    """A spanning forest of the links between rows of equal anchors; rows are sorted by anchor."""
    u, v = [], []
    if len(anchor):
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        sizes = np.diff(np.append(first, len(anchor)))
        small = np.repeat(sizes <= SCAN, sizes)
        for step in range(1, min(SCAN, int(sizes.max()))):
            same = (anchor[step:] == anchor[:-step]) & small[step:]
            at = np.flatnonzero(same)
            at = at[_near(fp[at], fp[at + step], threshold)]
            u.append(ids[at])
            v.append(ids[at + step])
        for k in np.flatnonzero(sizes > SCAN):
            rest = np.arange(first[k], first[k] + sizes[k])
            while len(rest):  # grow one component after the other; what it has reached is not looked at again
                queue, rest = [rest[0]], rest[1:]
                while queue and len(rest):
                    x = queue.pop()
                    near = _near(fp[rest], fp[x], threshold)
                    found = rest[near]
                    rest = rest[~near]
                    u.append(np.full(len(found), ids[x]))
                    v.append(ids[found])
                    queue.extend(found.tolist())
    u = np.concatenate(u).astype(np.int64) if u else np.zeros(0, np.int64)
    v = np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    kept = []
    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    a, b = zip(*kept, strict=True) if kept else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def similar_links(links: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The ``links`` whose documents' shingle sets have that Jaccard similarity; two texts without words are equal.

    Sets are made for the linked documents alone, and travel once for each link.
    Of documents that repeat an id, one such pair is enough.
    """
    links = materialize(links.where("u <> v").distinct(), "candidates")
    ids = links.select(F.col("u").alias("doc_id")).unionByName(links.select(F.col("v").alias("doc_id"))).distinct()
    linked = MembershipFilter(ids, "doc_id", ids.count()).apply(texts_of(docs.where("doc_id is not null")), "doc_id")

    def sets(batches):
        for batch in batches:
            made = [np.unique(shingle_hashes(v.as_py(), words)).tobytes() for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "hashes"])

    own = materialize(linked.join(ids.hint("merge"), "doc_id", "left_semi").transform(map_batches, sets, "doc_id long, hashes binary"), "shingle-sets")
    side = lambda c: own.select(F.col("doc_id").alias(c), F.col("hashes").alias(f"set_{c}")).hint("merge")
    both = links.join(side("u"), "u").join(side("v"), "v")

    def compare(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                a, b = (np.frombuffer(s.as_py(), "<u8") for s in (x, y))
                shared = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= similarity * max(len(a), len(b)) else 0
                near.append(shared >= similarity * (len(a) + len(b) - shared))
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("u", "v")], ["u", "v"])

    return both.transform(map_batches, compare, "u long, v long").distinct()


def simhash_components(
    docs: DataFrame, threshold: int = THRESHOLD, words: int = SHINGLE_WORDS, n_words: int = 1, similarity: float | None = None
) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits a word), ``component_id`` for every row of ``docs`` with a ``doc_id``.

    Null, empty and white-space texts have fingerprint zero, which links like any
    other.  ``component_id`` is the smallest ``doc_id`` that chains of links
    reach.  With ``similarity``, two texts link exactly if their sets of shingles
    have that Jaccard similarity; fingerprints lead to most of these links, and
    prefixes of the sets to the rest.  Rows with a null ``doc_id`` are left out;
    repeated rows come back each; an empty table gives an empty result.
    """
    if n_words == 1 and not 0 <= threshold <= 4:
        raise ValueError("the halves and the code cover thresholds up to 4; take more words for more")
    docs = docs.where("doc_id is not null")
    least = [F.min("doc_id").alias("id"), F.count("*").alias("n")]
    if similarity is None:
        key = "fp"
        rows = materialize(fingerprints(docs, words, n_words), "fingerprints")
        points = materialize(rows.groupBy("fp", "words").agg(*least), "points")
        parts = connected_components(links_at_anchors(points, threshold, n_words))
    else:
        key = "digest"
        rows = materialize(set_digests(docs, words, n_words), "fingerprints")
        own = F.min_by(F.struct("fp", "words", "size"), "doc_id").alias("own")
        points = materialize(rows.groupBy("digest").agg(*least, own).select("digest", "id", "n", "own.*"), "points")
        parts = connected_components(similar_links(links_at_anchors(points.select("fp", "words", "id"), threshold, n_words), docs, similarity, words))
        apart = points.where("size > 0").join(parts, points["id"] == parts["node"], "left")
        apart = materialize(apart.select("id", "digest", F.coalesce("component", "id").alias("part")), "apart")
        with scratch_scope(docs.sparkSession):
            sets = materialize(shingle_prefixes(docs, apart, words, similarity), "shingle-prefixes")
            more = result(links_at_prefixes(sets, apart, similarity), "prefix-links")
        more = similar_links(more, docs, similarity, words)
        parts = connected_components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
        rows = rows.select("doc_id", "words", "digest")
    points = points.join(parts, points["id"] == parts["node"], "left")
    points = points.select(key, "n", F.coalesce("component", "id").alias("component_id"))
    out = join_skewed(rows, points, key, "n", rows.count())
    digits = F.concat(*(F.lower(F.lpad(F.hex(F.element_at("words", k + 1)), 16, "0")) for k in range(n_words)))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, threshold: int = THRESHOLD, words: int = SHINGLE_WORDS, n_words: int = 1, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest ``doc_id``.

    Rows with a null ``doc_id`` stay; rows that repeat a removed ``doc_id`` all go,
    those that repeat a kept one all stay.  Null and empty texts are one group.
    """
    with scratch_scope(docs.sparkSession):
        found = simhash_components(docs, threshold, words, n_words, similarity)
        gone = result(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return with_edits(docs, gone.withColumn("__gone", F.lit(True)), "__gone").where("__gone is null").drop("__gone")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``simhash_components`` of the whole of ``documents``: 4-word shingles, links up to 4 bits."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
