"""Packing token pieces into training sequences: vector bin packing by the dot-product heuristic.

Every piece is a vector of tokens, segments and loss-bearing tokens, and a
sequence has a limit in each dimension.  A bin is filled with the fitting piece
whose vector has the largest dot product with what the bin has left, until none
fits (Panigrahy et al., "Heuristics for Vector Bin Packing", 2011).

Texts are tokenized in one narrow pass that leaves only piece metadata; pieces
are dealt into blocks of bounded expected size by a hash of their key, and each
block is packed on its own.  A block loses at most its last bins' padding, so
the share of padding does not grow with the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.byte_bpe import byte_coder
from factorloom.llm.common import map_batches, materialize, texts_of

MAX_TOKENS = 1024
MAX_SEGMENTS = 128
BLOCK_PIECES = 20_000
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens)`` of every text's ids followed by ``end_id``.

    A document is cut into full pieces of ``max_tokens`` and one remainder.
    A null or empty text is the single end id.
    """
    end = np.uint32(end_id).astype("<u4").tobytes()
    size = 4 * max_tokens

    def cut(batches):
        encode = byte_coder(tokenizer_path)
        for batch in batches:
            cols = [[], [], [], [], []]
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(value.as_py()) + end
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    row = (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                    for col, x in zip(cols, row, strict=True):
                        col.append(x)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return texts_of(docs).transform(map_batches, cut, PIECE_SCHEMA)


def pack_block(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and token offset of each row of ``sizes`` (tokens, segments, loss tokens) under ``limits``.

    Equal vectors are one class with a count, so a pick looks at the distinct
    vectors only.  Ties go to the class that sorts first, and to earlier rows
    within a class.  A row that exceeds a limit by itself gets a bin of its own.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    classes, of = np.unique(sizes, axis=0, return_inverse=True)
    members = np.argsort(of.ravel(), kind="stable")
    counts = np.bincount(of.ravel(), minlength=len(classes))
    ends = np.cumsum(counts)
    left = counts.copy()
    scaled = classes / limits
    alone = (classes > limits).any(axis=1) | (scaled >= 1)[:, 0]
    bin_no = 0
    for c in np.flatnonzero(alone):
        rows = members[ends[c] - counts[c] : ends[c]]
        bins[rows] = bin_no + np.arange(len(rows))
        bin_no += len(rows)
        left[c] = 0
    while left.any():
        open_ = np.flatnonzero(left)
        own, share = classes[open_], scaled[open_] / limits
        fresh = True
        while fresh:  # bins over the same classes; one that ran out stays, unpicked, until a bin is done
            room, offset, ran_out = limits.astype(float), 0, False
            while True:
                fits = (own <= room).all(axis=1) & (left[open_] > 0)
                if not fits.any():
                    break
                c = open_[np.argmax(np.where(fits, share @ room, -1.0))]
                row = members[ends[c] - left[c]]
                left[c] -= 1
                ran_out |= left[c] == 0
                bins[row], offsets[row] = bin_no, offset
                offset += int(classes[c, 0])
                room = room - classes[c]
            bin_no += 1
            fresh = not ran_out
    return bins, offsets


def pack_pieces(
    pieces: DataFrame,
    key: list[str],
    tokens: str,
    loss_tokens: str,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss_tokens: int = MAX_TOKENS,
    block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (one row an example or part of one).

    A sequence holds at most ``max_tokens`` of column ``tokens``,
    ``max_segments`` rows and ``max_loss_tokens`` of column ``loss_tokens``; a
    row beyond a limit by itself is alone in its sequence.  ``key`` names the
    columns that order the rows within a block; rows are dealt into blocks by key
    and place in the table, so repeated and null keys spread like others.
    Sequence ids are unique but not consecutive.  ``pieces`` is read twice, so
    pass a written table.
    """
    n_blocks = max(1, -(-pieces.count() // block_pieces))
    limits = np.array([max_tokens, max_segments, max_loss_tokens], np.int64)
    columns = pieces.columns

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable", ignore_index=True)
        sizes = np.stack([pdf[tokens], np.ones(len(pdf), np.int64), pdf[loss_tokens]], axis=1)
        bins, offsets = pack_block(sizes, limits)
        block = int(pdf["_block"].iloc[0])
        return pdf[columns].assign(sequence_id=(block << 32) + bins, offset=offsets)

    block = F.pmod(F.xxhash64(*key, F.monotonically_increasing_id()), F.lit(n_blocks))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return pieces.withColumn("_block", block).groupBy("_block").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Packs all ``docs``; every token of a plain document bears loss.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, loss_tokens,
    sequence_id, offset``.  Null ``doc_id`` rows and repeated rows are packed
    too; an empty table gives an empty result.
    """
    pieces = materialize(cut_documents(docs, tokenizer_path), "pieces")
    pieces = pieces.withColumn("loss_tokens", F.col("length"))
    return pack_pieces(pieces, ["doc_id", "start"], "length", "loss_tokens")


def pack_conversations(turns: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_segments: int = 16, max_loss_tokens: int = MAX_TOKENS // 2) -> DataFrame:
    """Packs conversations (``conv_id, turn, role, text``) as instruction examples: only turns of the assistant bear loss.

    Returns ``conv_id, tokens, loss_tokens, sequence_id, offset``, a row a
    conversation.  A turn's tokens are those of its text and an end id; null texts
    count as empty.  Turns without a ``conv_id`` are left out.  The limit on loss
    tokens keeps a sequence from being all answers.
    """

    def count(batches):
        encode = byte_coder(tokenizer_path)
        for batch in batches:
            tokens = [len(encode(v.as_py() or "")) // 4 + 1 for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("answer"), pa.array(tokens, pa.int64())], ["conv_id", "answer", "tokens"])

    answer = F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("answer")
    counted = turns.where("conv_id is not null").select("conv_id", answer, "text").mapInArrow(count, "conv_id long, answer boolean, tokens long")
    loss = F.sum(F.when(F.col("answer"), F.col("tokens")).otherwise(0)).alias("loss_tokens")
    examples = materialize(counted.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), loss), "examples")
    return pack_pieces(examples, ["conv_id"], "tokens", "loss_tokens", max_tokens, max_segments, max_loss_tokens)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack_documents`` of the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
