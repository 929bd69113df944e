"""Quality by a sparse rule ensemble (Friedman and Popescu, "Predictive Learning via Rule Ensembles", 2008).

Every text becomes a row of statistics.  A random forest of shallow trees is
grown on the labelled rows; each path from a root is a rule, a conjunction of
bounds on statistics.  A lasso logistic regression keeps few of the rules, and
these are compiled into one Spark column expression that scores all rows.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, scratch_scope, texts_of
from factorloom.llm.toxicity import bucket, training_labels

STATISTICS = [
    "n_bytes", "n_words", "upper", "digit", "space", "mark", "symbol", "bar", "high_byte",
    "mean_word", "longest_word", "repeated_next", "distinct_words", "marked_ends", "mean_line",
]
THRESHOLD = 0.3
TREES, DEPTH, LASSO = 24, 4, 1e-3


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = [
    _kind(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind(b"0123456789"), _kind(b" \t\n\r\v\f"), _kind(b".,;:!?'\"()-"),
    _kind(b"#$%&*@^~<>=+_{}[]\\/`"), _kind(b"|"), np.arange(256) >= 128,
]
_ENDS = frozenset(b"#$%&*!|")


def statistics_of(text: str) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``; shares are of bytes or words, 0 where there are none."""
    data = text.encode("utf-8")
    words = data.split()
    n, k = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = [float(counts[kind].sum()) / max(n, 1) for kind in _KINDS]
    repeated = sum(map(bytes.__eq__, words, words[1:])) / max(k - 1, 1)
    marked = sum(w[-1] in _ENDS for w in words) / max(k, 1)
    longest = max(map(len, words), default=0)
    lines = data.count(b"\n") + 1
    return [
        float(n), float(k), *shares, sum(map(len, words)) / max(k, 1), float(longest),
        repeated, len(set(words)) / max(k, 1), marked, n / lines,
    ]


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each whole text (null: empty), in one pass."""

    def run(batches):
        for batch in batches:
            rows = np.array([statistics_of(v.as_py()) for v in batch.column("text")], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in rows.T.copy())], ["doc_id", *STATISTICS])

    return texts_of(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, float, float], ...]  # (statistic, above, up to), sorted


def tree_rules(debug: str) -> set[Rule]:
    """Rules of every path of a tree in Spark's ``toDebugString``, inner nodes included."""
    found: set[Rule] = set()
    path: list[tuple[int, int, str, float]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            continue
        depth, feature, bound = len(m[1]), int(m[2]), float(m[4])
        path = [p for p in path if p[0] < depth]
        path.append((depth, feature, m[3], bound))
        box: dict[int, tuple[float, float]] = {}
        for _, f, op, x in path:
            lo, hi = box.get(f, (-np.inf, np.inf))
            box[f] = (lo, min(hi, x)) if op == "<=" else (max(lo, x), hi)
        found.add(tuple((f, *box[f]) for f in sorted(box)))
    return found


def rule_column(rule: Rule) -> Column:
    """1.0 where the row's statistics satisfy the rule, else 0.0."""
    tests = []
    for f, lo, hi in rule:
        c = F.col(STATISTICS[f])
        tests += [c > F.lit(lo)] * bool(np.isfinite(lo)) + [c <= F.lit(hi)] * bool(np.isfinite(hi))
    return F.when(reduce(Column.__and__, tests), 1.0).otherwise(0.0)


def fit_rules(rows: DataFrame) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with their weights, and the intercept, from statistics with a label ``y``.

    Without rows of both labels there are no rules, and the intercept is that of the share of ones.
    """
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        share = (ones + 1) / (n + 2)
        return [], float(np.log(share / (1 - share)))
    features = array_to_vector(F.array(*STATISTICS))
    data = rows.select(features.alias("features"), F.col("y").cast("double").alias("y"), *STATISTICS)
    forest = RandomForestClassifier(
        labelCol="y", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=10, maxBins=64, seed=7, featureSubsetStrategy="sqrt"
    ).fit(data)
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
    if not rules:
        return [], float(np.log(ones / (n - ones)))
    fires = rows.select(array_to_vector(F.array(*map(rule_column, rules))).alias("features"), F.col("y").cast("double").alias("y"))
    lasso = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=LASSO, maxIter=100, standardization=True).fit(materialize(fires, "rules"))
    weights = lasso.coefficients.toArray()
    return [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9], float(lasso.intercept)


def score_column(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The fitted ensemble as one expression over the statistics."""
    z = reduce(Column.__add__, [rule_column(r) * F.lit(w) for r, w in rules], F.lit(intercept))
    return 1 / (1 + F.exp(-z))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels are learnt from all rows whose crc32 modulo 5 is not 0.  Null and empty
    texts have statistics of 0 and are scored by them.  Rows with a null
    ``doc_id`` are scored too, and not held out; of repeated ids each row is scored.
    """
    rows = materialize(text_statistics(docs), "statistics")
    with scratch_scope(docs.sparkSession):
        known = materialize(rows.join(training_labels(labels, "quality", 5, 0), "doc_id"), "labelled")
        rules, intercept = fit_rules(known)
    held_out = F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = rows.select("doc_id", held_out, score_column(rules, intercept).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality`` of the whole of ``documents`` learnt from ``labels``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels)
