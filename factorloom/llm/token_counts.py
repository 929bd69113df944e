"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table from frequent pre-tokens to their number of
tokens, bounded by the tokenizer's vocabulary.  What misses it is encoded once
and kept in a bounded cache that lives as long as the Python worker.  Counting
is one narrow pass over the texts: no pre-token is ever shuffled.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.byte_bpe import WordCoder, frequent_lengths, length_coder
from factorloom.llm.common import texts_of

_CODERS: dict[str, WordCoder] = {}  # of this Python worker, by tokenizer file


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Counts are those of the tokenizers library without added special tokens;
    strings of special tokens inside a text count as one token, its default.
    Null and empty texts have 0 bytes and 0 tokens.  Rows are treated one by
    one, so repeated rows and null ``doc_id`` values simply come back; an empty
    table gives an empty result.  Texts of any length are read whole.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(tokenizer_path))

    def count(batches):
        if tokenizer_path not in _CODERS:
            _CODERS[tokenizer_path] = length_coder(tokenizer_path, table.value)
        coder = _CODERS[tokenizer_path]
        for batch in batches:
            texts = [value.as_py() for value in batch.column("text")]
            n_bytes = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
            n_tokens = pa.array(map(coder, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    out = texts_of(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count_tokens`` of the whole of ``documents``, with a limit of 512 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
