"""Tokens against the libraries, packing rules, classifiers on held-out rows, and the pipeline."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factorloom.llm.packing import pack_block, pack_conversations, pack_documents, pack_pieces
from factorloom.llm.quality import STATISTICS, fit_rules, quality, score_column, text_statistics
from factorloom.llm.queries import QUERIES, SQL
from factorloom.llm.sentence_pieces import encode_decode, piece_table
from factorloom.llm.token_counts import count_tokens
from factorloom.llm.toxicity import QUIET, Instances, drop_toxic, features_of, fit, score_documents, sentences, toxicity, training_labels
from tests.conftest import SF
from tests.llm.test_dedup import documents
from tests.oracle import assert_same, connect

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts(n=250, seed=1):
    random.seed(seed)
    letters = "ab  ▁\n\t<>0xEé漢😀\u0301\u00a0\u2003.,thein's'll12²_-\x1c"
    odd = ["", None, "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<s>", "</s><unk>", "<0x0A>", " ", "  ", "\n\n a", "a\n", "▁", "x" * 20_000, "it's we'll", "a   b", "a \nb"]
    return [*odd, *("".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(n))]


def test_counts_equal_the_library(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in count_tokens(documents(spark, [*rows, (None, "a b")]), BPE, limit=20).collect()}
    tokenizer = Tokenizer.from_file(BPE)
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 20)
    assert got[None]["n_tokens"] == 2 and count_tokens(documents(spark, []), BPE).count() == 0


def test_pieces_equal_the_library(spark):
    rows = list(enumerate(texts()))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: tuple(r)[1:] for r in encode_decode(documents(spark, rows), PIECES).collect()}
    for i, t in rows:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i] == (len(ids), digest(" ".join(map(str, ids))), digest(sp.decode(ids))), t
    assert encode_decode(documents(spark, []), PIECES).count() == 0


@pytest.mark.parametrize("letters", ["0123456789", string.ascii_letters + "0123456789+/", "".join(map(chr, range(0x4E00, 0x5200))), "😀🎉🚀👍🏽", "éa\u03010漢"])
def test_long_words_equal_the_library(letters):
    word = "".join(random.Random(5).choices(letters, k=20_000))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in (word, f"a {word}\n {word[:2000]}"):
        ids = sp.encode(text)
        got = piece_table(PIECES).encode(text)
        assert got == " ".join(map(str, ids)) and piece_table(PIECES).decode(got) == sp.decode(ids)


def test_piece_table_round_trip():
    table = piece_table(PIECES)
    for t in texts(60, 9):
        assert table.decode(table.encode(t or "")) == sentencepiece.SentencePieceProcessor(model_file=PIECES).decode(
            [int(i) for i in table.encode(t or "").split()]
        )


def test_packed_documents(spark):
    random.seed(3)
    words = ["".join(random.choices("abcdefgh", k=random.randint(1, 9))) for _ in range(500)]
    rows = [(i, " ".join(random.choices(words, k=random.choice([0, 3, 50, 400, 3000])))) for i in range(200)] + [(900, None)]
    pieces = pack_documents(documents(spark, rows), BPE).toPandas()
    tokenizer = Tokenizer.from_file(BPE)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = pieces[pieces.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for _, seq in pieces.sort_values("offset").groupby("sequence_id"):
        assert seq.length.sum() <= 1024 and seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
    assert pieces.length.sum() / (1024 * pieces.sequence_id.nunique()) > 0.95
    assert pack_documents(documents(spark, []), BPE).count() == 0


def test_vector_limits_hold():
    rng = np.random.default_rng(2)
    sizes = np.stack([rng.integers(1, 900, 600), np.ones(600, int), np.zeros(600, int)], axis=1)
    sizes[:, 2] = sizes[:, 0] * rng.random(600)
    sizes[0] = (5000, 1, 10)
    limits = np.array([1024, 4, 500])
    sizes[1:, 2] = np.minimum(sizes[1:, 2], 500)
    bins, _ = pack_block(sizes, limits)
    for b in np.unique(bins):
        own = sizes[bins == b]
        assert len(own) == 1 or (own.sum(axis=0) <= limits).all()
    lower = np.ceil((sizes[1:].sum(axis=0) / limits).max())
    assert len(np.unique(bins)) <= 1.25 * lower + 2
    assert pack_block(np.zeros((0, 3), int), limits)[0].size == 0


def test_instruction_examples_are_packed(spark):
    rows = spark.range(0, 500).select(F.col("id").alias("example"), (F.col("id") % 300 + 1).alias("tokens"), (F.col("id") % 100).alias("loss"))
    packed = pack_pieces(rows, ["example"], "tokens", "loss", max_tokens=512, max_segments=3, max_loss_tokens=120, block_pieces=200)
    worst = packed.groupBy("sequence_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"), F.sum("loss").alias("l")).agg(F.max("t"), F.max("s"), F.max("l")).first()
    assert packed.count() == 500 and worst[0] <= 512 and worst[1] <= 3 and worst[2] <= 120


def test_conversations_are_packed_within_their_loss(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    packed = pack_conversations(turns.unionByName(spark.createDataFrame([(None, 1, "user", "a"), (10**9, 0, None, None)], "conv_id long, turn long, role string, text string")), BPE)
    tokenizer = Tokenizer.from_file(BPE)
    expected: dict = {}
    for r in turns.collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        own = expected.setdefault(r["conv_id"], [0, 0])
        own[0] += n
        own[1] += n * (r["role"] == "assistant")
    expected[10**9] = [1, 0]
    assert {r["conv_id"]: [r["tokens"], r["loss_tokens"]] for r in packed.collect()} == expected
    sums = packed.groupBy("sequence_id").agg(F.sum("tokens").alias("t"), F.sum("loss_tokens").alias("l"), F.count("*").alias("s")).collect()
    assert all(r["s"] == 1 or (r["t"] <= 1024 and r["l"] <= 512 and r["s"] <= 16) for r in sums)


def test_repeated_keys_spread_over_blocks(spark):
    rows = spark.range(0, 6000, 1, 3).select(F.lit(None).cast("long").alias("k"), F.lit(5).cast("long").alias("t"))
    packed = pack_pieces(rows, ["k"], "t", "t", block_pieces=1000)
    sizes = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 32).alias("block")).count().collect()]
    assert sum(sizes) == 6000 and len(sizes) == 6 and max(sizes) < 1500


def held_out_id(k, modulus, remainder):
    return zlib.crc32(str(k).encode()) % modulus == remainder


def labelled(n=900):
    random.seed(8)
    clean = ["wall", "tree", "river", "stone", "cloud", "lamp", "road", "grass"]
    bad = ["vileness", "vilest", "grimoffal"]
    docs, labels = [], []
    for k in range(n):
        sentences = [" ".join(random.choices(clean, k=6)) + "." for _ in range(random.randint(1, 12))]
        toxic, junk = random.random() < 0.2, random.random() < 0.3
        if toxic:
            sentences.insert(random.randrange(len(sentences)), f"the {random.choice(bad)} wall.")
        text = " ".join(sentences)
        docs.append((k, "### $$$ " * 20 + text.upper() if junk else text))
        labels.append((k, int(not junk), int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    docs += [(5000, None), (5001, ""), (5002, "x" * 100_000), (None, "wall.")]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity(documents(spark, docs), lab).collect()}
    held = [(y, rows[k]) for k, _, y in labels if held_out_id(k, 3, 1)]
    assert all(r["held_out"] for _, r in held) and not rows[None]["held_out"]
    assert np.mean([r["predicted"] == y for y, r in held]) > 0.97
    assert all(any("vil" in s.lower() or "grim" in s.lower() for s in r["offending"]) for y, r in held if y and r["predicted"])
    assert rows[5000]["score"] == rows[5001]["score"] == 0 and 0 <= rows[5002]["score"] <= 1
    kept = {r["doc_id"] for r in drop_toxic(documents(spark, docs), lab).select("doc_id").collect()}
    assert kept == {i for i, r in rows.items() if not r["predicted"]}


def test_noisy_or_by_hand_and_neutral_text(spark):
    docs, labels = labelled(400)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights, bias = fit(documents(spark, docs), training_labels(lab, "toxic", 3, 1))
    neutral = " Qqzzq kkxxk." * 20_000  # words of which no feature has a weight
    assert not any(f in weights for w in ("qqzzq", "kkxxk") for f in features_of(w))
    long = [(k + 10_000, t + neutral) for k, t in docs[:40]]
    got = {r["doc_id"]: r["score"] for r in score_documents(documents(spark, docs + long), weights, bias).collect()}
    for k, text in docs:
        quiet = 1.0
        for s in sentences(text):
            found = {f for w in re.findall(r"\w+", s.lower()) for f in features_of(w)} & weights.keys()
            if found:
                p = 1 / (1 + np.exp(-(bias + sum(weights[f] for f in found))))
                quiet *= 1 - max(0.0, (p - QUIET) / (1 - QUIET))
        assert abs(got[k] - (1 - quiet)) < 1e-9
    assert all(abs(got[k + 10_000] - got[k]) < 1e-12 for k, _ in docs[:40])


def test_noisy_or_gradient():
    rng = np.random.default_rng(4)
    doc = np.sort(rng.integers(0, 12, 40))
    data = Instances(rng.integers(0, 40, 150), rng.integers(0, 9, 150), doc, (rng.random(12) < 0.4).astype(float), 9)
    w, b = rng.standard_normal(9), -1.0
    _, g = data.loss_and_gradient(w, b)
    for k in range(10):
        e = np.eye(10)[k] * 1e-6
        up, down = data.loss_and_gradient(w + e[:9], b + e[9])[0], data.loss_and_gradient(w - e[:9], b - e[9])[0]
        assert abs((up - down) / 2e-6 - g[k]) < 1e-6


def test_rules_by_hand(spark):
    """The compiled column is the logistic sum of the rules that hold."""
    docs, labels = labelled(400)
    rows = text_statistics(documents(spark, docs)).join(spark.createDataFrame([(k, q) for k, q, _ in labels], "doc_id long, y int"), "doc_id").cache()
    rules, intercept = fit_rules(rows)
    assert rules
    for r in rows.withColumn("score", score_column(rules, intercept)).collect():
        z = intercept + sum(w for rule, w in rules if all(lo < r[STATISTICS[f]] <= hi for f, lo, hi in rule))
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9
    rows.unpersist()


def test_toxicity_without_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity(documents(spark, [(1, "a b.")]), lab).first()["score"] <= 1
    assert toxicity(documents(spark, []), lab).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality(documents(spark, [*docs, (5000, None), (5001, ""), (None, "a")]), lab).collect()}
    held = [(y, rows[k]) for k, y, _ in labels if held_out_id(k, 5, 0)]
    assert all(r["held_out"] for _, r in held) and np.mean([r["predicted"] == y for y, r in held]) > 0.97
    assert rows[5000]["score"] == rows[5001]["score"] and 0 <= rows[5000]["score"] <= 1
    one = text_statistics(documents(spark, docs[:5])).withColumn("y", F.lit(1))
    assert fit_rules(one)[0] == [] and fit_rules(one.limit(0))[0] == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), SQL[name])


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
