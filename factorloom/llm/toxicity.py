"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic function of its distinct words and word
starts; a document's is the noisy-or of its sentences, so one bad sentence makes
a bad document.  The weights are learnt from document labels through the
noisy-or, and afterwards the sentence scores point at the offending sentences.

A sentence without any learnt feature has the probability 0, in fitting and in
scoring, and what a sentence has up to ``QUIET`` counts as 0 in scoring.  So
neutral text adds nothing, however long it is.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import forget_words, map_batches, materialize, scratch_scope, texts_of

SAMPLE_ROWS = 20_000  # labelled documents that the weights are fitted on, the ones with the smallest hash of their id
FEATURES = 1 << 20
MIN_DOCS = 4  # of the sample that a feature must occur in
MIN_DEVIATION = 5.0  # standard deviations by which bad documents must be in excess among those
RIDGE = 2e-5
QUIET = 0.05  # probability of a sentence up to which it says nothing about its document
THRESHOLD = 0.7
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[str]:
    """The text cut behind full stops, exclamation and question marks and line feeds."""
    return _SENTENCE.findall(text)


def features_of(word: str) -> list[int]:
    """Hashed features of a lower-case word: the word, and its first 4, 5 and 6 letters."""
    names = {word + "$"} | {word[:k] for k in (4, 5, 6) if len(word) > k}
    return sorted(zlib.crc32(n.encode("utf-8")) % FEATURES for n in names)


def bucket(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def training_labels(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """``doc_id, y`` of the rows that may be learnt from; of repeated ids the largest label counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (bucket("doc_id", modulus) != held_out))
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def _instances(docs: DataFrame) -> DataFrame:
    """``y, sentences``: the features of each sentence."""

    def run(batches):
        forget_words()
        cached = lru_cache(50_000)(features_of)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [[sorted({f for w in set(_WORD.findall(s)) for f in cached(w)}) for s in sentences(v.as_py().lower())] for v in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["y", "sentences"])

    return docs.select("text", "y").transform(map_batches, run, "y int, sentences array<array<int>>")


def _telling(instances: DataFrame, rate: float) -> list[int]:
    """Features that bad documents have far more often than others, by counts of documents; at most ``FEATURES``."""
    counts = instances.select("y", F.explode(F.array_distinct(F.flatten("sentences"))).alias("f")).groupBy("f").agg(
        F.count("*").alias("n"), F.sum("y").alias("bad")
    )
    excess = (F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    return sorted(r["f"] for r in counts.where((F.col("n") >= MIN_DOCS) & (excess >= MIN_DEVIATION)).select("f").collect())


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = 250) -> tuple[dict[int, float], float]:
    """Weights by feature and the bias, from ``labels`` (``doc_id, y``) and the texts of ``docs``.

    The sample is bounded by ``sample_rows``; the driver gets the telling features
    of its sentences only.  Without rows of both labels there are no weights, and
    the bias is that of the share of ones.
    """
    with scratch_scope(docs.sparkSession):
        ids = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        instances = materialize(_instances(texts_of(docs).join(F.broadcast(ids), "doc_id")), "instances")
        n, ones = instances.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        if not 0 < ones < n:
            share = (ones + 1) / (n + 2)
            return {}, float(np.log(share / (1 - share)))
        often = _telling(instances, ones / n)
        column = {f: k for k, f in enumerate(often)}

        def pick(batches):
            for batch in batches:
                found = [[[column[f] for f in s if f in column] for s in doc] for doc in batch.column("sentences").to_pylist()]
                sizes = [np.array([len(s) for s in doc], "<i4").tobytes() for doc in found]
                feats = [np.array([f for s in doc for f in s], "<i4").tobytes() for doc in found]
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(sizes, pa.binary()), pa.array(feats, pa.binary())], ["y", "sizes", "features"])

        rows = instances.transform(map_batches, pick, "y int, sizes binary, features binary").collect()
    y = np.array([r["y"] for r in rows], float)
    sizes = [np.frombuffer(r["sizes"], "<i4") for r in rows]
    x = np.concatenate([np.frombuffer(r["features"], "<i4") for r in rows])
    doc_of_sentence = np.repeat(np.arange(len(y)), [len(s) for s in sizes])
    sentence = np.repeat(np.arange(len(doc_of_sentence)), np.concatenate(sizes))

    # only sentences with features take part
    some = np.unique(sentence)
    instances_of = Instances(np.searchsorted(some, sentence), x, doc_of_sentence[some], y, len(often))
    w, b = np.zeros(len(often)), -3.0
    m, v, step = np.zeros(len(often) + 1), np.zeros(len(often) + 1), 0.15
    for t in range(1, rounds + 1):
        _, g = instances_of.loss_and_gradient(w, b)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return {int(f): float(s) for f, s in zip(often, w, strict=True) if abs(s) > 1e-3}, float(b)


class Instances:
    """Features of sentences and sentences of labelled documents, as flat arrays.

    ``sentence`` and ``feature`` list the pairs, ``doc`` has each sentence's document, ``y`` the labels.
    """

    def __init__(self, sentence: np.ndarray, feature: np.ndarray, doc: np.ndarray, y: np.ndarray, n_features: int):
        self.sentence, self.feature, self.doc, self.y, self.n_features = sentence, feature, doc, y, n_features

    def loss_and_gradient(self, w: np.ndarray, b: float, ridge: float = RIDGE) -> tuple[float, np.ndarray]:
        """Mean log loss of the noisy-or of each document with ridge penalty, and its gradient by the weights and the bias."""
        y, n = self.y, max(len(self.y), 1)
        z = np.bincount(self.sentence, weights=w[self.feature], minlength=len(self.doc)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        quiet = np.bincount(self.doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        bad = np.clip(-np.expm1(quiet), 1e-9, 1 - 1e-9)
        loss = -(np.where(y > 0, np.log(bad), quiet)).sum() / n + ridge / 2 * float(w @ w)
        # d(log loss)/dz of a sentence: p for a clean document, -p (1 - bad) / bad for a bad one
        pull = np.where(y > 0, -(1 - bad) / bad, 1.0)[self.doc] * p / n
        by_weight = np.bincount(self.feature, weights=pull[self.sentence], minlength=self.n_features) + ridge * w
        return loss, np.append(by_weight, pull.sum())


def score_documents(docs: DataFrame, weights: dict[int, float], bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, offending`` for every row: noisy-or of the sentences, and those that reach a half.

    A text without sentences (null, empty) has the score 0.  Whole texts are
    scored, whatever their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    def run(batches):
        forget_words()
        table = shared.value
        known = _Known(lambda word: any(f in table for f in features_of(word)))
        for batch in batches:
            scores, found = [], []
            for value in batch.column("text"):
                bad: list[str] = []
                scores.append(_score(value.as_py(), table, known, bias, bad))
                found.append(bad)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "score", "offending"]
            )

    out = texts_of(docs).transform(map_batches, run, "doc_id long, score double, offending array<string>")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def _score(text: str, table: dict, known: dict, bias: float, bad: list | None = None) -> float:
    """Noisy-or of a text's sentences; ``bad`` collects the sentences that reach a half."""
    quiet = 0.0
    for part in sentences(text):
        words = [w for w in _WORD.findall(part.lower()) if known[w]]
        if not words:
            continue
        z = bias + sum(table[f] for f in {f for w in words for f in features_of(w)} if f in table)  # once a sentence, as in fitting
        p = 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))
        if p > QUIET:
            quiet += math.log1p(-min((p - QUIET) / (1 - QUIET), 1 - 1e-12))
        if bad is not None and p >= 0.5:
            bad.append(part)
    return -math.expm1(quiet)


class _Known(dict):
    """Does any feature of a word have a weight? Bounded; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        self[word] = value = self.make(word)
        return value


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending`` for every row of ``docs``.

    Labels are learnt only from ids whose crc32 modulo 3 is not 1.  Rows with a
    null ``doc_id`` are scored too, and not held out.
    """
    weights, bias = fit(docs, training_labels(labels, "toxic", 3, 1))
    held_out = F.coalesce(bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return score_documents(docs, weights, bias).select("doc_id", held_out, "score", "predicted", "offending")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; the texts never leave their task."""
    weights, bias = fit(docs, training_labels(labels, "toxic", 3, 1))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    def keep(batches):
        forget_words()
        table = shared.value
        known = _Known(lambda word: any(f in table for f in features_of(word)))
        for batch in batches:
            yield batch.filter(pa.array([_score(v.as_py() or "", table, known, bias) < threshold for v in batch.column("text")], pa.bool_()))

    return docs.transform(map_batches, keep, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``toxicity`` of the whole of ``documents`` learnt from ``labels``, with the number of offending sentences."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels).withColumn("n_offending", F.size("offending")).drop("offending")
