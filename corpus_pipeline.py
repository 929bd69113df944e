"""A corpus pipeline: toxicity, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  Stages but the last return the columns of ``documents``.  Executors give
back the heap of the stage before first.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factorloom.llm.common import materialize, rest_executors
from factorloom.llm.line_dedup import EXACT_CHARS, MAX_EDITS, drop_lines
from factorloom.llm.packing import pack_documents
from factorloom.llm.simhash_dedup import bits_apart, keep_one_of_each
from factorloom.llm.substring_dedup import strip_repeats
from factorloom.llm.toxicity import drop_toxic

FINGERPRINT_WORDS = 4  # of 64 bits, for documents
SIMILARITY = 0.8  # of five-word shingles
SPARE = 2.2  # standard deviations of the differing bits: of pairs at the similarity itself, 97 % differ in fewer
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50  # a repeated run of so many bytes goes if it has more words than that, or op3's 400 bytes


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; ``labels`` are only learnt from."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one or come within op4's edit bound of it."""
    return drop_lines(docs, exact_chars=EXACT_CHARS, max_edits=MAX_EDITS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a similarity of 0.8 by five words connect, the one with the smallest id."""
    return keep_one_of_each(docs, bits_apart(SIMILARITY, FINGERPRINT_WORDS, SPARE), words=5, n_words=FINGERPRINT_WORDS, similarity=SIMILARITY)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings that start twice in the corpus: of over 50 words (and 200 bytes) or of 400 bytes."""
    return strip_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def rested(stage):
    """``stage`` on executors that have given back the heap of the one before."""

    @wraps(stage)
    def run_rested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest_executors(spark)
        return stage(spark, docs, sf_dir)

    return run_rested


STAGES = [
    ("toxicity", rested(toxicity)),
    ("line_dedup", rested(lines)),
    ("simhash_near_dedup", rested(near_duplicates)),
    ("suffix_array_dedup", rested(substrings)),
    ("packing", rested(packing)),
]

#: Fitted weights, fingerprints and suffix arrays are beyond SQL; the operators behind the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
