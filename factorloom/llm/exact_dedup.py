"""Exact dedup over a log-structured merge index of digests, with DataFrame functions only.

Writing tasks are the memtables: each flushes its rows as a run sorted by digest.
A run comes with a filter over its digests, bounded in size.  Compaction merges
runs of about one size into one of the next level, keeping the smallest identifier
and the number of rows of each digest.  A lookup asks the filters first, so only
rows that a run may have are joined with it.  Digests that occur more than once
are hits, and hits receive a comparison of the whole normalized texts.  Rows that
share a digest but not the text (a collision) are grouped by the text itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import HOT_SHARE, MembershipFilter, join_skewed, materialize

SALTS = 32  # copies of a hot group's kept text, so that its rows are compared in that many tasks


def normalized(text: str | Column = "text") -> Column:
    """The text (null: empty) with every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


FANOUT = 4  # runs of one level that are merged into one of the next


class DigestIndex:
    """Sorted digest runs ``(digest, doc_id, n)`` in the shared folder, by level, with a filter each."""

    def __init__(self) -> None:
        self.levels: list[list[tuple[DataFrame, MembershipFilter]]] = [[]]

    def _add(self, rows: DataFrame, level: int) -> None:
        run = materialize(rows.sortWithinPartitions("digest"), f"run{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((run, MembershipFilter(run, "digest", run.count())))

    def flush(self, rows: DataFrame) -> None:
        """Adds ``(digest, doc_id)`` rows as a run of level 0, a sorted file for each task, without a shuffle."""
        self._add(rows.select("digest", "doc_id", F.lit(1).cast("long").alias("n")), 0)
        self.compact(FANOUT)

    def compact(self, least: int = 1) -> None:
        """Merges the runs of each level that has ``least`` of them or more into one of the next level, from below."""
        level = 0
        while level < len(self.levels):
            runs = [run for run, _ in self.levels[level]]
            above = any(self.levels[level + 1 :])
            if len(runs) >= least and (level == 0 or len(runs) > 1 or (least == 1 and above)) and runs:
                self.levels[level] = []
                rows = reduce(DataFrame.unionByName, runs)
                self._add(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n")), level + 1)
            level += 1

    def runs(self) -> list[tuple[DataFrame, MembershipFilter]]:
        return [run for level in self.levels for run in level]

    def lookup(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``digest``) that the index has, with ``keep_id`` and ``n``: smallest identifier and number of rows."""
        columns = rows.columns
        found = [
            flt.apply(rows, "digest").join(run.select("digest", F.col("doc_id").alias("__id"), F.col("n").alias("__n")), "digest").select(*columns, "__id", "__n")
            for run, flt in self.runs()
        ]
        if not found:
            return rows.select("*", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("n")).limit(0)
        if len(found) == 1:
            return found[0].withColumnsRenamed({"__id": "keep_id", "__n": "n"})
        return reduce(DataFrame.unionByName, found).groupBy(*columns).agg(F.min("__id").alias("keep_id"), F.sum("__n").alias("n"))


def exact_dedup(docs: DataFrame, digest=lambda sha: F.unhex(sha)) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Texts are equal when their normalized forms are (``normalized``; null counts
    as empty, so null and empty texts are one group).  ``keep_id`` is the
    smallest ``doc_id`` of the group; rows that repeat it are all ``kept``.
    Rows with a null ``doc_id`` are left out.  ``digest`` maps the SHA-256 (hex)
    to the index key; any function is right, as hits are compared byte by byte.
    """
    rows = docs.where("doc_id is not null").select("doc_id", normalized().alias("text"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    hashed = materialize(rows.select("doc_id", sha.alias("sha")).withColumn("digest", digest(F.col("sha"))), "hashed")
    n_rows = hashed.count()
    index = DigestIndex()
    index.flush(hashed)
    index.compact()
    merged = index.runs()[0][0]
    hits = materialize(merged.where("n > 1").select("digest", F.col("doc_id").alias("keep_id"), "n"), "hits")
    # rows whose digest the hits' filter does not have are alone and stay where they are
    flagged = MembershipFilter(hits, "digest", hits.count()).flag(hashed, "digest")
    alone = flagged.where("not __maybe").select("doc_id", "sha", "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("n"))
    groups = join_skewed(flagged.where("__maybe").drop("__maybe"), hits, "digest", "n", n_rows).unionByName(alone).select(
        "doc_id", "sha", "digest", (F.coalesce("n", F.lit(1)) >= max(2, n_rows * HOT_SHARE)).alias("hot"),
        F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
    )
    groups = materialize(groups, "groups")

    odd = _collisions(docs, digest, groups.where("group_size > 1"))
    if not odd.isEmpty():
        own = odd.groupBy("digest", "text").agg(F.min("doc_id").alias("own_id"), F.count("*").alias("own_n"))
        own = odd.join(own, ["digest", "text"]).select("doc_id", "sha", "own_id", "own_n").distinct()
        less = odd.groupBy("digest").agg(F.count("*").alias("less"))
        groups = groups.join(own, ["doc_id", "sha"], "left").join(less, "digest", "left")
        groups = groups.withColumn("keep_id", F.coalesce("own_id", "keep_id")).withColumn(
            "group_size", F.coalesce(F.col("own_n"), F.col("group_size") - F.coalesce("less", F.lit(0)))
        )
    return groups.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def _collisions(docs: DataFrame, digest, hits: DataFrame) -> DataFrame:
    """``(doc_id, sha, digest, text)`` of hits whose text is not that of the row their group keeps."""
    # the filter comes before the text is touched: only texts of hits are normalized again
    found = MembershipFilter(hits, "doc_id", hits.count()).apply(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id")
    found = found.select("doc_id", normalized().alias("text"))
    found = found.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    known = hits.select("doc_id", "sha", "keep_id", "hot").distinct()
    found = materialize(found.join(known, ["doc_id", "sha"]).withColumn("digest", digest(F.col("sha"))), "found")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt")
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    # of repeated keeper rows with several texts, the one with the smallest sum stands for the group
    keeper = found.where("doc_id = keep_id").groupBy("keep_id", "digest", "hot").agg(F.min_by("text", "sha").alias("kept_text"))
    pairs = found.select("*", salt).join(keeper.select("keep_id", "digest", "kept_text", salts), ["keep_id", "digest", "salt"])
    return materialize(pairs.where("text <> kept_text").select("doc_id", "sha", "digest", "text"), "collisions")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_dedup`` of the whole of ``documents``."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents where doc_id is not null
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""
