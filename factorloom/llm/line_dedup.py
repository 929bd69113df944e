"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines within one edit of each other meet on a hashed variant: a substitution
leaves the same string when the character at its place is deleted from both, an
insertion when it is deleted from the longer one.  Lines would have as many
variants as characters, so first every line is tested for a possible partner: cut
into four segments, two lines within one edit agree outside of one segment.  Eight
hashes a line (segment left out, for its own length and for one less) find these,
and only lines that share one emit variants, only for the characters of the
segment left out.  What joins is verified by edit distance on the texts.

Long lines may differ by more: an edit for every ``EDIT_CHARS`` characters, up to
``MAX_EDITS``.  k edits leave k + 1 runs of a line intact, and the longest of them has
at least (n - k) / (k + 1) characters.  Every window of that length selects the gram of
least hash within it, so lines within k edits select a common gram.  Gram sizes follow classes of lengths; a line just above a class also selects as
a member of it.  Lines that share a gram are verified by edit distance as well.

Exact repeats are found by digest before that, whatever their length in the query.  A line is dropped when an earlier
line of the corpus, by document and line number, is within the bound; the earliest
stays.  A variant's group is bounded by the alphabet and the length of a line (its
members differ at one place), and mass repeats are one digest with a count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import MembershipFilter, forget_words, join_skewed, map_batches, materialize, result, scratch_scope, texts_of, with_edits
from factorloom.llm.rolling import RangeHash, mix

MIN_CHARS = 20  # shorter lines stay: short lines are within one edit by chance
EXACT_CHARS = 1  # the query drops exact repeats from this length on
EDIT_CHARS = 32  # a pair may differ by an edit for so many characters of the shorter line, at least 1
MAX_EDITS = 5  # but by no more than these
SEGMENTS = 4
BLOCK_CHARS = 125_000  # of lines that are hashed together
SEEN_LINES = 50_000  # digests that a task remembers, so that it lists a repeated line about once
LISTED_GRAMS = 1_000_000  # hashes that a task sorts before it sends them, and that meet in one bucket, about
GRAMS_A_LINE = 20
NEAREST = 3  # earlier lines that a line is compared with first
FEW_LINES = 16  # up to so many lines of a gram are compared all at once
PAIR_CHARS = 4_000_000  # of pairs of lines that are compared by edits at once
LINE_SCHEMA = "doc_id long, line int, digest binary, keys array<long>"


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def _bounds(size: np.ndarray, segment: int) -> np.ndarray:
    return size * segment // SEGMENTS


def segment_keys(lines: list[str]) -> np.ndarray:
    """A row of ``2 * SEGMENTS`` hashes for each line: without segment j, cut by length n (first half) and n - 1."""
    n = np.array([len(x) for x in lines], np.int64)
    end = np.cumsum(n)
    begin = end - n
    h = RangeHash(_code_points(lines))
    out = np.empty((len(lines), 2 * SEGMENTS), np.uint64)
    for less in (0, 1):
        size = n - less
        for j in range(SEGMENTS):
            head = h.of(begin, begin + _bounds(size, j))
            tail = h.of(end - (size - _bounds(size, j + 1)), end)
            out[:, less * SEGMENTS + j] = mix(mix(head + np.uint64(j)) + tail) ^ mix(size.astype(np.uint64))
    return out.view(np.int64)


def list_lines(docs: DataFrame, min_chars: int, exact_chars: int | None = None) -> DataFrame:
    """Lines of at least ``exact_chars`` characters: place, digest and segment keys (none below ``min_chars``); no text."""
    least = min_chars if exact_chars is None else min(exact_chars, min_chars)

    def rows_of(ids, numbers, lines):
        digests = [hashlib.md5(x.encode("utf-8")).digest() for x in lines]
        long = np.array([len(x) >= min_chars for x in lines], bool)
        offsets = np.append(0, np.cumsum(long)).astype(np.int32) * np.int32(2 * SEGMENTS)
        keys = segment_keys([x for x in lines if len(x) >= min_chars]).ravel()
        keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))
        cols = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary()), keys]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "line", "digest", "keys"])

    def run(batches):
        forget_words()
        for batch in batches:
            ids, numbers, lines, size = [], [], [], 0
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for k, line in enumerate(value.as_py().split("\n")):
                    if len(line) < least:
                        continue
                    ids.append(doc_id)
                    numbers.append(k)
                    lines.append(line)
                    size += len(line)
                    if size > BLOCK_CHARS:
                        yield rows_of(ids, numbers, lines)
                        ids, numbers, lines, size = [], [], [], 0
            yield rows_of(ids, numbers, lines)

    return docs.transform(map_batches, run, LINE_SCHEMA)


def deletion_variants(line: str, slots: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a line without one character, for the characters of the segments in ``slots``; and the
    hash of the whole line, at place -1."""
    n = len(line)
    h = RangeHash(_code_points([line]))
    at = [np.zeros(0, np.int64)]
    for slot in sorted(set(slots)):
        size, j = np.int64(n - slot // SEGMENTS), slot % SEGMENTS
        # cut by n - 1, the longer line has its extra character within the segment or right behind it
        at.append(np.arange(_bounds(size, j), min(n, _bounds(size, j + 1) + slot // SEGMENTS)))
    at = np.unique(np.concatenate(at))
    head = h.of(np.zeros_like(at), at)
    tail = h.of(at + 1, np.full_like(at, n))
    return np.concatenate([h.of(np.array([0]), np.array([n])), h.joined(head, at, tail)]), np.concatenate([[-1], at])


def lines_at(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``digest, doc_id, line, text, slots`` of lines given by ``digest``, ``at`` (struct of the first place) and ``slots``."""
    wanted = wanted.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("at.line", "digest", "slots")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    found = MembershipFilter(wanted, "doc_id", wanted.count()).apply(docs, "doc_id").join(wanted, "doc_id")

    def rows_of(rows):
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols, ["digest", "doc_id", "line", "text", "slots"])

    def cut(batches):
        forget_words()
        rows, size = [], 0
        for batch in batches:
            for doc_id, value, items in zip(*(batch.column(c) for c in ("doc_id", "text", "wanted")), strict=True):
                lines = value.as_py().split("\n")
                for w in items.as_py():
                    text = lines[w["line"]] if w["line"] < len(lines) else ""
                    if hashlib.md5(text.encode("utf-8")).digest() == w["digest"]:  # else another text under the same doc_id
                        rows.append((w["digest"], doc_id.as_py(), w["line"], text, w["slots"]))
                        size += len(text)
                        if size > 4 * BLOCK_CHARS:
                            yield rows_of(rows)
                            rows, size = [], 0
        if rows:
            yield rows_of(rows)

    return found.transform(map_batches, cut, "digest binary, doc_id long, line int, text string, slots array<int>")


def _same_ahead(a: str, i: int, b: str, j: int) -> int:
    """How many characters from ``a[i]`` and ``b[j]`` on are equal."""
    n, at, step = min(len(a) - i, len(b) - j), 0, 16
    while at < n and a[i + at : i + at + step] == b[j + at : j + at + step]:
        at += step
        step *= 2
    lo, hi = min(at, n), min(at + step, n)  # equal up to lo, not up to hi unless both are n
    while lo < hi:
        middle = (lo + hi + 1) // 2
        if a[i + lo : i + middle] == b[j + lo : j + middle]:
            lo = middle
        else:
            hi = middle - 1
    return lo


def within_edits(a: str, b: str, most: int) -> bool:
    """Is the edit distance at most ``most``? Furthest places by diagonal (Landau and Vishkin), linear in the lines."""
    if abs(len(a) - len(b)) > most:
        return False
    ends: dict[int, int] = {}
    for e in range(most + 1):
        now = {}
        for d in range(-e, e + 1):
            i = max(ends.get(d, -2) + 1, ends.get(d - 1, -2), ends.get(d + 1, -2) + 1) if e else 0
            i = min(i, len(a), len(b) - d)
            if i < 0 or i + d < 0:
                continue
            i += _same_ahead(a, i, b, i + d)
            if i == len(a) and i + d == len(b):
                return True
            now[d] = i
        ends = now
    return False


def _may_be_within(lines: list[str], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``within_edits`` of all pairs at once, with hashes in place of texts: never false for a pair within its bound."""
    n = np.array([len(x) for x in lines], np.int64)
    begin = np.cumsum(n) - n
    h = RangeHash(_code_points(lines))
    n_a, n_b, at_a, at_b = n[a], n[b], begin[a], begin[b]

    def same_ahead(p, q, size):
        lo, hi = np.zeros(len(p), np.int64), size
        for _ in range(int(size.max(initial=0)).bit_length()):
            middle = (lo + hi + 1) // 2
            same = h.of(p, p + middle) == h.of(q, q + middle)
            lo, hi = np.where(same, middle, lo), np.where(same, hi, middle - 1)
        return lo

    top = int(most.max(initial=0))
    found = np.zeros(len(a), bool)
    ends = np.full((2 * top + 3, len(a)), -2, np.int64)  # by diagonal, from -top - 1 on
    for e in range(top + 1):
        now = np.full_like(ends, -2)
        for d in range(-e, e + 1):
            c = d + top + 1
            i = np.maximum(np.maximum(ends[c] + 1, ends[c - 1]), ends[c + 1] + 1) if e else np.zeros(len(a), np.int64)
            i = np.minimum(np.minimum(i, n_a), n_b - d)
            # a diagonal that is too far from the last one leads to no end within the bound
            go = np.flatnonzero((i >= 0) & (i + d >= 0) & (np.abs(n_b - n_a - d) <= most - e) & ~found)
            i = i[go]
            i = i + same_ahead(at_a[go] + i, at_b[go] + i + d, np.minimum(n_a[go] - i, n_b[go] - i - d))
            found[go[(i == n_a[go]) & (i + d == n_b[go])]] = True
            now[c, go] = i
        ends = now
    return found


def all_within_edits(lines: list[str], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``within_edits(lines[a], lines[b], most)`` for arrays ``a``, ``b`` and ``most``."""
    out = np.zeros(len(a), bool)
    size = np.array([len(x) for x in lines], np.int64)
    block = np.cumsum(size[a] + size[b]) // PAIR_CHARS
    for at in np.split(np.arange(len(a)), np.flatnonzero(np.diff(block)) + 1):
        ids, of = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        out[at] = _may_be_within([lines[k] for k in ids], of[: len(at)], of[len(at) :], most[at])
    for k in np.flatnonzero(out):
        out[k] = within_edits(lines[a[k]], lines[b[k]], int(most[k]))
    return out


def rows_with(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` whose ``key`` may be one of ``keys``, so that a join with far fewer keys does not shuffle all rows."""
    codes = keys.select(F.xxhash64(key).alias("__code"))
    return MembershipFilter(codes, "__code", keys.count()).apply(rows.withColumn("__code", F.xxhash64(key)), "__code").drop("__code")


def _verified(pairs: DataFrame) -> DataFrame:
    """Digests of ``pairs`` (``digest, text, o_text, bound``) within their bound."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(c) for c in ("text", "o_text", "bound")]
            keep = [within_edits(a.as_py(), b.as_py(), k.as_py()) for a, b, k in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest").filter(pa.array(keep, pa.bool_()))], ["digest"])

    return pairs.transform(map_batches, run, "digest binary").distinct()


def near_lines(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """Digests of the lines that have an earlier line within one edit.

    ``distinct`` has ``digest, at`` (struct of the first place) and ``keys`` of every different line.
    """
    keys = distinct.select("digest", F.posexplode("keys").alias("slot", "key"))
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    slots = MembershipFilter(shared, "key", shared.count()).apply(keys, "key").join(shared, "key", "left_semi")
    slots = materialize(slots.groupBy("digest").agg(F.collect_set("slot").alias("slots")), "slots")
    wanted = slots.join(rows_with(distinct.select("digest", "at"), slots, "digest"), "digest")
    lines = materialize(lines_at(wanted, docs), "lines")

    def rows_of(held):
        sizes = [len(at) for _, at, *_ in held]
        codes, at = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        ids, nos = (np.repeat([h[k] for h in held], sizes) for k in (2, 3))
        digests = pa.array([h[4] for h in held], pa.binary()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        cols = [pa.array(codes.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64)), pa.array(nos.astype(np.int32)), digests]
        return pa.RecordBatch.from_arrays(cols, ["code", "at", "doc_id", "line", "digest"])

    def emit(batches):
        for batch in batches:
            held, size = [], 0
            for digest, doc_id, line, text, slots in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                codes, at = deletion_variants(text, slots)
                held.append((codes, at, doc_id, line, digest))
                size += len(at)
                if size > BLOCK_CHARS:
                    yield rows_of(held)
                    held, size = [], 0
            if held:
                yield rows_of(held)

    variants = lines.transform(map_batches, emit, "code long, at int, doc_id long, line int, digest binary")
    place = F.struct("doc_id", "line", "digest")
    by_code, by_place = Window.partitionBy("code"), Window.partitionBy("code", "at")
    least = variants.select(
        "digest", "doc_id", "line",
        F.when(F.col("at") >= 0, F.min(place).over(by_place)).alias("substituted"),
        F.when(F.col("at") >= 0, F.min(F.when(F.col("at") < 0, place)).over(by_code)).alias("shorter"),
        F.when(F.col("at") < 0, F.min(F.when(F.col("at") >= 0, place)).over(by_code)).alias("longer"),
    )
    pairs = least.select("digest", "doc_id", "line", F.explode(F.array("substituted", "shorter", "longer")).alias("first"))
    pairs = pairs.where("first is not null and struct(first.doc_id, first.line) < struct(doc_id, line)")
    pairs = pairs.select("digest", F.col("first.digest").alias("other")).distinct()
    text = lines.select("digest", "text").dropDuplicates(["digest"])
    pairs = pairs.join(text, "digest").join(text.select(F.col("digest").alias("other"), F.col("text").alias("o_text")), "other")
    return _verified(pairs.select("digest", "text", "o_text", F.lit(1).alias("bound")))


def edit_bound(n, edit_chars: int, max_edits: int):
    return np.clip(n // edit_chars, 1, max_edits)


def gram_classes(edit_chars: int, max_edits: int) -> np.ndarray:
    """Least lengths of the classes of lines that may differ by 2 edits or more."""
    lows = [edit_chars * k for k in range(2, max_edits + 1)]
    while lows[-1] < 1 << 31:
        lows.append(lows[-1] * 5 // 4 + 1)
    return np.array(lows, np.int64)


def line_grams(lines: list[str], edit_chars: int = EDIT_CHARS, max_edits: int = MAX_EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line index, hash and place of every selected gram."""
    n = np.array([len(x) for x in lines], np.int64)
    end = np.cumsum(n)
    begin = end - n
    h = RangeHash(_code_points(lines))
    lows = gram_classes(edit_chars, max_edits)
    own = np.searchsorted(lows, n, "right") - 1
    lower = np.searchsorted(lows, n - max_edits, "right") - 1
    out = []
    for c in np.unique(np.concatenate([own, lower])):
        if c < 0:
            continue
        k = int(edit_bound(lows[c], edit_chars, max_edits))
        run = max(1, -(-(int(lows[c]) - k) // (k + 1)))
        q = max(1, run // 2)
        w = run - q + 1
        which = np.flatnonzero((own == c) | (lower == c))
        sizes = n[which] - q + 1  # grams of each line
        first = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(first, sizes)
        lo = np.repeat(begin[which], sizes) + at
        codes = mix(h.of(lo, lo + q) ^ mix(np.array([c + 1], np.uint64)))
        least = (codes >> np.uint64(32) << np.uint64(32)) | np.arange(len(codes), dtype=np.uint64)  # the leftmost of equal ones
        size = 1
        while 2 * size <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < w:
            least = np.minimum(least[: size - w], least[w - size :])
        starts = np.flatnonzero((at <= np.repeat(sizes, sizes) - w)[: len(least)])
        found = np.unique(least[starts] & np.uint64((1 << 32) - 1)).astype(np.int64)
        out.append((np.repeat(which, sizes)[found], codes[found].view(np.int64), at[found]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


LETTERS, PAIRS = 64, 128  # classes of characters and of neighbouring characters


def parities(lines: list[str]) -> np.ndarray:
    """Three longs a line: by bit, is the number of characters (first) or of neighbouring pairs (others) of its class odd?

    An edit changes the parity of 2 classes of characters and of 4 classes of pairs at most.
    """
    c = _code_points(lines).astype(np.uint64)
    of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    spread = np.uint64(0x9E3779B97F4A7C15)  # the leading bits of the product are the class
    ones = of * LETTERS + (c * spread >> np.uint64(65 - LETTERS.bit_length())).astype(np.int64)
    twos = of[1:] * PAIRS + (((c[:-1] << np.uint64(21)) | c[1:]) * spread >> np.uint64(65 - PAIRS.bit_length())).astype(np.int64)
    twos = twos[of[1:] == of[:-1]]
    counts = [np.bincount(x, minlength=len(lines) * k).reshape(-1, k) for x, k in ((ones, LETTERS), (twos, PAIRS))]
    return np.packbits((np.concatenate(counts, axis=1) & 1).astype(np.uint8), axis=1, bitorder="little").view("<i8")


def bucket_bits(n_lines: int) -> int:
    """Leading bits of a hash that name its bucket: buckets of about ``LISTED_GRAMS`` hashes, 1,024 of them at least."""
    return min(32, max(10, (n_lines * GRAMS_A_LINE // LISTED_GRAMS).bit_length()))


def repeated_prefixes(grams: DataFrame, bits: int) -> DataFrame:
    """``prefix`` (the leading ``bits + 32`` bits) of every key that is listed twice or more, and few others.

    Keys are sent as sorted lists of 32 bits by bucket, so a key costs little more
    than 4 bytes of shuffle; a task sends a key twice at most.
    """

    def lists_of(keys):
        keys = np.sort(np.concatenate(keys).view(np.uint64) >> np.uint64(32 - bits))
        keep = np.ones(len(keys), bool)
        keep[2:] = keys[2:] != keys[:-2]
        keys = keys[keep]
        buckets, first = np.unique(keys >> np.uint64(32), return_index=True)
        offsets = pa.array(np.append(first, len(keys)).astype(np.int32))
        low = pa.array((keys & np.uint64((1 << 32) - 1)).astype(np.uint32).view(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), pa.ListArray.from_arrays(offsets, low)], ["bucket", "low"])

    def send(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column("key").to_numpy())
            size += batch.num_rows
            if size > LISTED_GRAMS:
                yield lists_of(held)
                held, size = [], 0
        if size:
            yield lists_of(held)

    def repeated(bucket, lists):
        low = np.sort(np.concatenate(lists).view(np.uint32)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array((np.array([bucket]) << 32) | np.unique(low[1:][low[1:] == low[:-1]]))], ["prefix"])

    def receive(batches):
        last, lists = None, []
        for batch in batches:
            for bucket, low in zip(batch.column("bucket").to_pylist(), batch.column("low"), strict=True):
                if bucket != last:
                    if lists:
                        yield repeated(last, lists)
                    last, lists = bucket, []
                lists.append(low.values.to_numpy().copy())
        if lists:
            yield repeated(last, lists)

    lists = grams.select("key").transform(map_batches, send, "bucket long, low array<int>")
    return lists.repartition("bucket").sortWithinPartitions("bucket").transform(map_batches, receive, "prefix long")


def list_keyed(docs: DataFrame, edit_chars: int, max_edits: int) -> DataFrame:
    """Lines of ``2 * edit_chars`` characters or more without their texts: ``digest, doc_id, line, n`` (characters),
    ``p0, p1, p2`` (parities) and ``keys``, their different selected grams.

    A task leaves out a line that it has lately listed from an earlier place; every line is listed at its first place.
    """

    def rows_of(digests, ids, numbers, lines):
        index, codes, _ = line_grams(lines, edit_chars, max_edits)
        order = np.lexsort((codes, index))
        index, codes = index[order], codes[order]
        new = np.append(True, (index[1:] != index[:-1]) | (codes[1:] != codes[:-1]))[: len(index)]
        offsets = np.append(0, np.cumsum(np.bincount(index[new], minlength=len(lines)))).astype(np.int32)
        odd = parities(lines)
        cols = [pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array([len(x) for x in lines], pa.int32())]
        cols += [pa.array(np.ascontiguousarray(odd[:, k])) for k in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes[new]))], ["digest", "doc_id", "line", "n", "p0", "p1", "p2", "keys"])

    def run(batches):
        forget_words()
        seen: dict[bytes, tuple[int, int]] = {}
        digests, ids, numbers, lines, size = [], [], [], [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for k, line in enumerate(value.as_py().split("\n")):
                    if len(line) < 2 * edit_chars:
                        continue
                    digest = hashlib.md5(line.encode("utf-8")).digest()
                    before = seen.get(digest)
                    if before is not None and before <= (doc_id, k):
                        continue
                    if len(seen) >= SEEN_LINES:
                        seen.clear()
                    seen[digest] = (doc_id, k)
                    digests.append(digest)
                    ids.append(doc_id)
                    numbers.append(k)
                    lines.append(line)
                    size += len(line)
                    if size > BLOCK_CHARS:
                        yield rows_of(digests, ids, numbers, lines)
                        digests, ids, numbers, lines, size = [], [], [], [], 0
        if lines:
            yield rows_of(digests, ids, numbers, lines)

    return docs.transform(map_batches, run, "digest binary, doc_id long, line int, n int, p0 long, p1 long, p2 long, keys array<long>")


def farther_lines(n_lines: int, docs: DataFrame, edit_chars: int, max_edits: int) -> DataFrame:
    """Digests of the lines that have an earlier line within their bound of 2 to ``max_edits`` edits.

    Lines with a common gram meet without their texts.  Edits change few parities, so
    most far lines are told apart by these there.  A line that is near many, as within a
    large group of near copies, is first compared with the few of least differing parities,
    and only where none of these is within the bound with all others.
    ``n_lines``, the number of different lines, sets the size of buckets.
    """
    names = ["n", "p0", "p1", "p2"]
    with scratch_scope(docs.sparkSession):  # the grams of all lines are removed before the pairs take room
        keyed = materialize(list_keyed(docs, edit_chars, max_edits), "keyed")
        # keys that are listed once are left out before the exact count
        bits = bucket_bits(n_lines)
        repeated = materialize(repeated_prefixes(keyed.select(F.explode("keys").alias("key")), bits), "repeated-prefixes")
        counted = keyed.select(F.xxhash64("digest").alias("code"), F.explode("keys").alias("key"))
        counted = counted.withColumn("prefix", F.shiftrightunsigned("key", 32 - bits))
        counted = MembershipFilter(repeated, "prefix", repeated.count()).apply(counted, "prefix")
        shared = counted.groupBy("key").agg(F.min("code").alias("a"), F.max("code").alias("b"))
        shared = materialize(shared.where("a <> b").select("key"), "shared-grams")
        # repeats of a line are one row from here on; of its grams it keeps those that may be shared
        rows = keyed.select("digest", F.struct("doc_id", "line").alias("at"), *names, F.explode("keys").alias("key"))
        rows = MembershipFilter(shared, "key", shared.count()).apply(rows, "key")
        lines = rows.groupBy("digest").agg(F.min("at").alias("at"), *(F.first(c).alias(c) for c in names), F.collect_set("key").alias("keys"))
        lines = result(lines, "keyed-lines")

    def texts_at(places):
        wanted = rows_with(lines.select("digest", "at"), places, "at").join(places, "at", "left_semi").withColumn("slots", F.array().cast("array<int>"))
        return lines_at(wanted, docs).select("digest", F.struct("doc_id", "line").alias("at"), "text")

    def verified(pairs):
        pairs = materialize(pairs, "gram-pairs")
        ends = materialize(pairs.select(F.explode(F.array("at", "o_at")).alias("at")).distinct(), "ends")
        texts = materialize(texts_at(ends), "pair-lines")
        others = texts.select(F.col("at").alias("o_at"), F.col("text").alias("o_text"))
        pairs = pairs.join(texts, "at").join(others, "o_at")
        return materialize(_verified(pairs.select("digest", "text", "o_text", "bound")), "verified")

    # the nearest earlier lines by their parities are compared first; one is enough
    rows = lines.select("at", *names, F.lit(True).alias("open"), F.explode("keys").alias("key"))
    met = gram_pairs(rows, edit_chars, max_edits, NEAREST)
    met = met.groupBy("at").agg(F.array_sort(F.collect_set(F.struct("odd", "o_at", "bound"))).alias("found"), F.max("more").alias("more"))
    met = materialize(met.select("at", F.slice("found", 1, NEAREST).alias("found"), (F.col("more") | (F.size("found") > NEAREST)).alias("more")), "nearest")
    near = verified(met.select("at", F.explode("found").alias("f")).select("at", "f.o_at", "f.bound"))
    # lines that are not near those are compared with all others that parities allow, where their grams meet: there may be
    # many such pairs, so texts come to the grams and no pair leaves them but one of each line that is near
    more = met.where("more").select("at")
    still = rows_with(lines, more, "at").join(more, "at", "left_semi").join(near, "digest", "left_anti")
    still = materialize(still.select("digest", "keys", F.lit(True).alias("open")), "open-lines")
    if still.isEmpty():
        return near
    keys = materialize(still.select(F.explode("keys").alias("key")).distinct(), "open-grams")
    rows = lines.select("digest", "at", *names, "keys", F.explode("keys").alias("key"))
    rows = MembershipFilter(keys, "key", keys.count()).apply(rows, "key").withColumn("less", F.filter("keys", lambda k: k < F.col("key"))).drop("keys")
    rows = rows.join(still.select("digest", "open"), "digest", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    rows = materialize(rows, "open-rows")
    # texts come only to lines that lengths and parities allow to meet another there
    mates = materialize(gram_pairs(rows, edit_chars, max_edits, None).select(F.xxhash64("key", "digest").alias("code")), "open-mates")
    rows = MembershipFilter(mates, "code", mates.count()).apply(rows.withColumn("code", F.xxhash64("key", "digest")), "code").drop("code")
    rows = materialize(rows, "open-rows")
    texts = materialize(texts_at(rows.select("at").distinct()).select("digest", "text"), "open-texts")
    return near.unionByName(gram_pairs(rows.join(texts, "digest"), edit_chars, max_edits, None))


def gram_pairs(rows: DataFrame, edit_chars: int, max_edits: int, nearest: int | None) -> DataFrame:
    """``at, o_at, bound, odd, more``: open lines with earlier lines of a common gram that lengths and parities allow.

    ``odd`` is the number of differing parities.  With ``nearest``, a gram gives a line so many of the least ``odd``,
    and ``more`` says that it left out some.  Without, rows have ``less``, their line's grams below ``key``, and two lines
    meet at the least of their common grams only, as near copies of a group share most of theirs.  Where rows have
    ``digest`` as well, ``key, digest`` of the lines of such pairs come back instead, a row a line and gram.  With ``text``
    too, the pairs are compared by edits there, and only ``digest`` of the open lines that are within the bound of an
    earlier one comes back.
    """
    names = ["key", "doc_id", "line", "n", "p0", "p1", "p2", "open", *(["less"] if nearest is None else [])]
    further = [c for c in ("digest", "text") if c in rows.columns]
    names += further

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            cut = np.searchsorted(now[0], now[0][-1])  # the last gram may go on in the next batch
            held = [r[cut:] for r in now]
            yield from _met([r[:cut] for r in now], edit_chars, max_edits, nearest)
        if held is not None:
            yield from _met(held, edit_chars, max_edits, nearest)

    rows = rows.select("key", "at.doc_id", "at.line", *names[3:])
    rows = rows.repartition("key").sortWithinPartitions("key", "doc_id", "line")
    if further:
        lines = rows.transform(map_batches, run, "digest binary" if "text" in further else "key long, digest binary")
        return lines.distinct() if "text" in further else lines
    pairs = rows.transform(map_batches, run, "doc_id long, line int, o_doc long, o_line int, bound int, odd int, more boolean")
    places = (F.struct("doc_id", "line").alias("at"), F.struct(F.col("o_doc").alias("doc_id"), F.col("o_line").alias("line")).alias("o_at"))
    return pairs.select(*places, "bound", "odd", "more")


def _numbered(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers for each list of codes, filled up with the last number, and a flag for each number, none set."""
    sizes = np.array([len(x) for x in lists])
    codes, numbers = np.unique(np.concatenate(list(lists)), return_inverse=True)
    out = np.full((len(lists), max(1, int(sizes.max()))), len(codes), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = numbers
    return out, np.zeros(len(codes) + 1, bool)


def _met(rows: list[np.ndarray], edit_chars: int, max_edits: int, nearest: int | None):
    """Batches of ``gram_pairs`` from rows that are sorted by key and place."""
    key, doc_id, line, n = rows[:4]
    p, is_open = np.stack([x.view(np.uint64) for x in rows[4:7]], axis=1), rows[7].astype(bool)
    less = rows[8] if nearest is None else None
    digests, texts = [*rows[9:], None, None][:2]

    def near(later, earlier):
        least = np.minimum(n[later], n[earlier])
        bound = np.minimum(max_edits, least // edit_chars)
        odd = np.bitwise_count(p[later] ^ p[earlier]).astype(np.int32)
        twos = odd[..., 1] + odd[..., 2]
        ok = (bound >= 2) & (np.abs(n[later] - n[earlier]) <= bound) & (odd[..., 0] <= 2 * bound) & (twos <= 4 * bound)
        ok &= (doc_id[later] != doc_id[earlier]) | (line[later] != line[earlier])
        return ok, bound, odd[..., 0] + twos

    def batch_of(later, earlier, bound, odd):
        later, earlier, bound, odd = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (later, earlier, bound, odd))
        if digests is not None and texts is None:
            pair_ends = np.unique(np.concatenate([later, earlier]))
            return pa.RecordBatch.from_arrays([pa.array(key[pair_ends]), pa.array(digests[pair_ends], pa.binary())], ["key", "digest"])
        if texts is not None:
            near_ones = np.unique(later[all_within_edits(texts, later, earlier, bound)])
            return pa.RecordBatch.from_arrays([pa.array(digests[near_ones], pa.binary())], ["digest"])
        more = np.zeros(len(later), bool)
        if nearest is not None:
            order = np.lexsort((earlier, odd, later))
            later, earlier, bound, odd = later[order], earlier[order], bound[order], odd[order]
            first = np.flatnonzero(np.append(True, later[1:] != later[:-1])) if len(later) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(later)))
            keep = np.arange(len(later)) - np.repeat(first, sizes) < nearest
            more = np.repeat(sizes > nearest, sizes)[keep]
            later, earlier, bound, odd = later[keep], earlier[keep], bound[keep], odd[keep]
        cols = [doc_id[later], line[later], doc_id[earlier], line[earlier], bound.astype(np.int32), odd.astype(np.int32), more]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "line", "o_doc", "o_line", "bound", "odd", "more"])

    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(key)))
    small = np.repeat(sizes <= FEW_LINES, sizes)
    found = [[], [], [], []]
    for step in range(1, min(FEW_LINES, int(sizes.max(initial=1)))):
        at = np.flatnonzero((key[step:] == key[:-step]) & small[step:] & is_open[step:]) + step
        ok, *rest = near(at, at - step)
        if less is not None:
            for k in np.flatnonzero(ok):
                ok[k] = set(less[at[k]]).isdisjoint(less[at[k] - step])
        for col, x in zip(found, (at, at - step, *rest), strict=True):
            col.append(x[ok])
    yield batch_of(*found)
    for k in np.flatnonzero(sizes > FEW_LINES):
        found, held = [[], [], [], []], 0
        grams, taken = (None, None) if less is None else _numbered(less[first[k] : first[k] + sizes[k]])
        for at in range(first[k] + 1, first[k] + sizes[k]):
            if not is_open[at]:
                continue
            before = np.arange(first[k], at)
            ok, *rest = near(np.full(1, at), before)
            if grams is not None:
                own, may = grams[at - first[k]], np.flatnonzero(ok)
                taken[own] = True
                taken[-1] = False
                ok[may[taken[grams[may]].any(axis=1)]] = False
                taken[own] = False
            for col, x in zip(found, (np.full(len(before), at), before, *rest), strict=True):
                col.append(x[ok])
            held += int(ok.sum())
            if held > 4 * BLOCK_CHARS:
                yield batch_of(*found)
                found, held = [[], [], [], []], 0
        yield batch_of(*found)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None, max_edits: int = 1, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``doc_id, dropped`` (sorted line numbers from 0) for documents that lose lines."""
    docs = texts_of(docs).where("doc_id is not null")
    with scratch_scope(docs.sparkSession):
        lines = materialize(list_lines(docs, min_chars, exact_chars), "lines")
        place = F.struct("doc_id", "line")
        distinct = lines.groupBy("digest").agg(F.min(place).alias("at"), F.count("*").alias("n"), F.first("keys").alias("keys"))
        distinct = materialize(distinct, "distinct")
        with scratch_scope(docs.sparkSession):
            near = result(near_lines(distinct, docs), "near")
        if max_edits > 1:
            with scratch_scope(docs.sparkSession):
                near = near.unionByName(result(farther_lines(distinct.count(), docs, edit_chars, max_edits), "farther")).distinct()
        # lines that are certainly not near do not meet the near ones
        near = near.withColumn("near", F.lit(True))
        flagged = distinct.select("digest", "at", "n", F.xxhash64("digest").alias("h"))
        flagged = MembershipFilter(near.select(F.xxhash64("digest").alias("h")), "h", near.count()).flag(flagged, "h")
        maybe = flagged.where("__maybe").drop("__maybe").join(near, "digest", "left").where("n > 1 or near")
        losing = maybe.unionByName(flagged.where("not __maybe and n > 1").drop("__maybe").withColumn("near", F.lit(None).cast("boolean")))
        losing = materialize(losing, "losing")
        places = lines.select("doc_id", "line", "digest", F.xxhash64("digest").alias("h"))
        places = MembershipFilter(losing, "h", losing.count()).apply(places, "h").drop("h")
        places = join_skewed(places, losing.drop("h"), "digest", "n", lines.count(), "inner")
        places = places.where("near or at.doc_id <> doc_id or at.line <> line")
        return result(places.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("dropped")), "dropped")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None, max_edits: int = 1, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, exactly or within the edit bound; all rows stay.

    Lines end at line feeds and keep their other white space; a line shorter than
    ``min_chars`` characters stays, but for exact repeats of ``exact_chars`` or more.
    The bound is an edit for every ``edit_chars`` characters of the shorter line, at
    least 1 and at most ``max_edits``.  ``n_chars``, where there is one, becomes the
    length of the new text.  Null texts stay null, a document of which no line
    is left becomes empty, and rows with a null ``doc_id`` stay as they are.
    Rows that repeat a ``doc_id`` with the same text are one document.
    """
    rows = _cut(docs, dropped_lines(docs, min_chars, exact_chars, max_edits, edit_chars))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("__dropped").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
        rows = rows.withColumn("n_chars", n_chars)
    return rows.select(*docs.columns)


def _cut(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines out of ``text``, and ``__dropped``."""
    gone = F.col("__dropped")
    kept = F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains(gone, k))
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return with_edits(docs, dropped.withColumnRenamed("dropped", "__dropped"), "__dropped").withColumn("text", text)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None, max_edits: int = 1, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` for every row of ``docs`` with a ``doc_id``.

    A null or empty text is one empty line.  See ``drop_lines`` for what is removed.
    """
    docs = texts_of(docs).where("doc_id is not null")
    counted = docs.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    n_removed = F.when(F.col("__dropped").isNull(), 0).otherwise(F.size("__dropped")).cast("long")
    return _cut(counted, dropped_lines(docs, min_chars, exact_chars, max_edits, edit_chars)).select(
        "doc_id", "n_lines", n_removed.alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_dedup`` of the whole of ``documents`` with the growing edit bound; exact repeats of any length but 0."""
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), exact_chars=EXACT_CHARS, max_edits=MAX_EDITS)
