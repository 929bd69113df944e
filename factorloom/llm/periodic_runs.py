"""Periodic runs of words, by catching squares online over dyadic blocks.

Words arrive in order.  At level j the text is cut into blocks of ``m = 2 ** j``
words, and each completed block has a catcher.  A suffix of m words that begins
q words after a block's begin, ``m <= q < 2 m``, is compared with that block: so
every appended word advances one suffix comparison a level, with the only catcher
in reach.  Two neighbouring blocks that match at one distance are a new square
(2 m words that occur again q words on); squares of one distance whose blocks
adjoin merge into one run, which is extended to both sides by comparing words.

A run of period q and at least 4 q words holds, at the level with m <= q < 2 m,
two neighbouring blocks together with what lies q words after them, so none is
missed.  Blocks are compared by names: 64-bit hashes, a block's mixed from those
of its halves.  Names only propose: every run is verified on the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.rolling import mix

MIN_LENGTH, MIN_EXPONENT = 6, 4
PIECE = 1 << 16  # words that are appended at once
_LEFT = np.uint64(0xD6E8FEB86659FD93)


class SquareCatchers:
    """Catchers of squares over the blocks of every power of two, fed by ``append``."""

    def __init__(self) -> None:
        self.n = 0
        self.names: list[np.ndarray] = [np.empty(0, np.uint64)]  # by level: names of the windows of 2 ** level words that are complete
        self.squares: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by level: block begins and distances of new squares
        self.seen: list[int] = []  # by level: suffix windows that have been compared

    def append(self, ids: np.ndarray) -> None:
        """Advances all catchers by the words ``ids`` (one number for each different word)."""
        self.names[0] = np.concatenate([self.names[0], ids])
        self.n += len(ids)
        level = 0
        while 4 << level <= self.n:  # else no run has a period of this level
            m = 1 << level
            if level:
                self._name(level)
            names = self.names[level]
            if level == len(self.squares):
                self.squares.append([])
                self.seen.append(m)
            # the windows at i and i + m both equal their catchers' blocks, which adjoin and are as far back
            begin, end = self.seen[level], len(names) - m
            if end > begin:
                at = np.arange(begin, end + m)
                same = names[begin : end + m] == names[(at // m - 1) * m]
                found = begin + np.flatnonzero(same[: end - begin] & same[m:])
                if len(found):
                    block = (found // m - 1) * m
                    self.squares[level].append((block, found - block))
                self.seen[level] = end
            level += 1

    def _name(self, level: int) -> None:
        """Names the windows of ``2 ** level`` words that the last words complete."""
        if level == len(self.names):
            self.names.append(np.empty(0, np.uint64))
        half, done = self.names[level - 1], len(self.names[level])
        step = 1 << (level - 1)
        if len(half) - step > done:
            new = mix(half[done : len(half) - step] * _LEFT + half[done + step :])
            self.names[level] = np.concatenate([self.names[level], new])

    def runs(self, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of all runs so far with at least ``MIN_EXPONENT`` periods, by start, then period."""
        words, found, levels = self.names[0], {}, []
        for level, parts in enumerate(self.squares):
            m = 1 << level
            here: list[tuple[int, int, int]] = []
            if parts:
                block, q = (np.concatenate(x) for x in zip(*parts, strict=True))
                keep = ~self._inside(levels, block, block + q + 2 * m, q)
                block, q = block[keep], q[keep]
                order = np.lexsort((block, q))
                block, q = block[order], q[order]
                chain = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (block[1:] != block[:-1] + m)])) if len(q) else []
                for b, p in zip(block[chain].tolist(), q[chain].tolist(), strict=True):
                    lo, hi = _extended(words, b, p)
                    if hi - lo >= max(min_length, MIN_EXPONENT * p) and (lo, hi) not in found:
                        found[lo, hi] = p
                        here.append((lo, hi, p))
            levels.append(sorted(here))
        return sorted((lo, hi - lo, p) for (lo, hi), p in found.items())

    @staticmethod
    def _inside(levels, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether a run of a lower level holds the square and has a period that divides its distance: no other run then."""
        out = np.zeros(len(q), bool)
        for runs in levels:
            if runs:
                begin, end, period = np.array(runs).T
                for back in (1, 2):  # runs of one level overlap by less than half, so two reach back to a place at most
                    k = np.searchsorted(begin, lo, "right") - back
                    out |= (k >= 0) & (end[np.maximum(k, 0)] >= hi) & (q % period[np.maximum(k, 0)] == 0)
        return out


def _extended(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``period`` apart are identical."""
    lo = hi = at
    step = 64
    while hi + period < len(words):
        equal = words[hi : min(hi + step, len(words) - period)] == words[hi + period : hi + period + step]
        if not equal.all():
            hi += int(equal.argmin())
            break
        hi, step = hi + len(equal), 2 * step
    step = 64
    while lo:
        begin = max(0, lo - step)
        equal = (words[begin:lo] == words[begin + period : lo + period])[::-1]
        if not equal.all():
            lo -= int(equal.argmin())
            break
        lo, step = begin, 2 * step
    return lo, hi + period


def runs_of_words(words: list, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """The runs of a list of words; words are numbered by hash, and what is found is held against the words themselves."""
    if len(words) < max(min_length, MIN_EXPONENT):
        return []
    catchers = SquareCatchers()
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for k in range(0, len(ids), PIECE):
        catchers.append(ids[k : k + PIECE])
    runs = catchers.runs(min_length)
    if any(words[s : s + n - q] != words[s + q : s + n] for s, n, q in runs):  # two words share a hash
        number: dict = {}
        catchers = SquareCatchers()
        catchers.append(np.array([number.setdefault(w, len(number)) for w in words], np.uint64))
        runs = catchers.runs(min_length)
    return runs


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that some run contains after its first period."""
    if not runs:
        return words
    out, at = [], 0
    drops = sorted((s + q, s + n) for s, n, q in runs)
    for lo, hi in drops:
        if hi > at:
            out += words[at : max(at, lo)]
            at = max(at, hi)
    return out + words[at:]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, n_words, runs, text`` for every row of ``docs``: its runs and its text without their repeats.

    ``runs`` is an array of ``(start, length, period)`` by start, then period, in
    words; the returned ``text`` joins the kept words by one space.  Null and empty
    texts, and texts of white space, have no words, no runs and the empty text.
    Rows are treated one by one, so repeated rows and null ``doc_id`` values come
    back; an empty table gives an empty result.  Texts of any length are read
    whole; time grows as n log n in their words.
    """

    def find(batches):
        for batch in batches:
            n_words, starts, lengths, periods, ends, texts = [], [], [], [], [0], []
            for value in batch.column("raw"):
                words = value.as_py().split()  # bytes: at ASCII white space alone
                runs = runs_of_words(words, min_length)
                for s, n, q in runs:
                    starts.append(s)
                    lengths.append(n)
                    periods.append(q)
                n_words.append(len(words))
                ends.append(len(starts))
                texts.append(b" ".join(collapsed(words, runs)).decode("utf-8"))
            parts = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), runs, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "text"])

    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return raw.mapInArrow(find, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in rows whose crc32(doc_id) is divisible by 10, the words from some place on repeat a stretch of the text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.pmod(g, F.greatest(n, F.lit(1))))).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    turned = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``periodic_runs`` of the whole of ``documents`` with planted runs, and digests of what it returns."""
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("longest", longest)
    length, period = F.col("longest.n"), -F.col("longest.q")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * longest.n div -longest.q").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
