"""Sharding, periodic runs and spelling variants against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import periodic_runs as pr
from factorloom.llm import sharding as sh
from factorloom.llm import spelling_variants as sv
from tests.conftest import SF

DOCS = "doc_id long, text string"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# ---- sharding


def groups_in_order(rows):
    """Sizes of equal texts in the order of their first row."""
    first, size = {}, Counter()
    for i, t in rows:
        t = t or ""
        first[t] = min(first.get(t, (i is not None, i)), (i is not None, i))
        size[t] += len(t.encode()) + 8
    return [size[t] for t in sorted(first, key=first.get)]


def least_capacity(sizes, n):
    """The smallest capacity for ``n`` stretches, larger groups alone, by a plain walk."""

    def shards(c):
        k, held = 0, None
        for x in sizes:
            if held is None or held + x > c:
                k, held = k + 1, x
            else:
                held += x
        return k

    lo, hi = 0, sum(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if shards(mid) <= n else (mid, hi)
    return hi


def checked_shards(rows, out, n):
    """Sizes by shard, after the promises of a sharding have been checked."""
    assert len(out) == len(rows)
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    by_shard, of_text = {}, {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r)
        if len(texts[r.doc_id]) == 1:
            raw = (texts[r.doc_id][0] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
            of_text.setdefault(raw, set()).add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by_shard.values())
    assert set(by_shard) <= set(range(n))
    return {k: sum(r["size"] for r in part) for k, part in by_shard.items()}


@pytest.mark.parametrize("seed", range(3))
def test_shards_have_the_least_capacity(spark, seed):
    rng = random.Random(seed)
    texts = ["x" * rng.randint(0, 400) + str(k) for k in range(150)]
    rows = [(k * 7 % 601, rng.choice(texts)) for k in range(600)]
    sizes = checked_shards(rows, sh.shard_documents(docs_of(spark, rows), 9).collect(), 9)
    groups = groups_in_order(rows)
    capacity = least_capacity(groups, 9)
    assert max(sizes.values()) <= max(capacity, max(groups)) and max(v for v in sizes.values() if v not in groups) <= capacity
    assert len(sizes) == 9 and min(sizes.values()) > 0


@pytest.mark.parametrize("blocks, finer", [(4, 1), (16, 3), (1 << 16, 10)])
def test_cuts_do_not_depend_on_the_blocks(spark, blocks, finer):
    rng = random.Random(5)
    weights = [rng.choice([0, 0, 5, 9, 100]) for _ in range(700)]
    weights[300] = 9000  # more than all others in a shard
    order = spark.createDataFrame([(k, w) for k, w in enumerate(weights)], "at long, weight long")
    capacity, cuts = sh.cut_places(order, len(weights), 6, blocks, finer)
    assert capacity == least_capacity([w for w in weights if w], 6)
    parts = [sum(weights[a:b]) for a, b in zip([0, *cuts], [*cuts, len(weights)], strict=True)]
    assert all(p <= capacity or p == 9000 for p in parts)
    assert (capacity, cuts) == sh.cut_places(order, len(weights), 6)


def test_a_huge_group_leaves_the_others_even(spark):
    rows = [(k, "same" * 50 if k % 3 == 0 else f"text {k}" * 6) for k in range(900)]
    sizes = checked_shards(rows, sh.shard_documents(docs_of(spark, rows), 8).collect(), 8)
    hot = sum(len("same" * 50) + 8 for k in range(900) if k % 3 == 0)
    assert hot in sizes.values() and len(sizes) == 8
    rest = [v for v in sizes.values() if v != hot]
    assert max(rest) <= 1.6 * min(rest)


def test_shards_of_odd_tables(spark):
    assert sh.shard_documents(docs_of(spark, []), 4).collect() == []
    rows = [(1, "a"), (2, None), (3, ""), (None, "b"), (4, "a"), (4, "c"), (5, "a")]
    out = sh.shard_documents(docs_of(spark, rows), 24).collect()
    assert len(checked_shards(rows, out, 24)) == 4  # as many shards as groups
    assert len({r.shard for r in out if r.doc_id in (2, 3)}) == 1  # null counts as empty
    odd = docs_of(spark, [(1, "a", 5, 9), (2, "b", 6, 8)], DOCS + ", at long, shard int")  # names of the operator's own columns
    assert sh.shard_documents(odd, 2).select("doc_id", "shard").orderBy("doc_id").collect() == [(1, 0), (2, 1)]
    same = [(7, "t")] * 5
    assert sorted(r.slot for r in sh.shard_documents(docs_of(spark, same), 3).collect()) == list(range(5))
    long = [(k, "é" * (200_000 if k == 1 else 1)) for k in range(4)]
    checked_shards(long, sh.shard_documents(docs_of(spark, long), 3).collect(), 3)


def test_written_shards_hold_their_rows(spark, tmp_path):
    rows = [(k, f"text {k % 5}", k * 2) for k in range(40)]
    sh.write_shards(docs_of(spark, rows, DOCS + ", more int"), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.more) for r in back.collect()) == rows
    assert back.select("shard").distinct().count() == 3


# ---- periodic runs


def runs_by_hand(words, min_length=6):
    """All maximal stretches by comparing words at every distance."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, 4 * q) and j > i:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def periodic_words(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.choice([5, 40, 300]):
        base = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 21]))]
        words += (base * rng.randint(1, 9))[: rng.randint(1, 120)]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_all_comparisons(seed):
    words = periodic_words(seed)
    assert pr.runs_of_words(words) == runs_by_hand(words)


@pytest.mark.parametrize("words", [["a"] * 500, ["a", "b"] * 250, list("aab" * 80), list("abaababaabaababaababa" * 9), ["a"] * 5, ["a"] * 6, list("abababa"), list("abababab")])
def test_runs_of_strongly_periodic_words(words):
    assert pr.runs_of_words(words) == runs_by_hand(words)


def test_no_runs_in_thue_morse():
    """Sums modulo 2 ** 64 take halves of this word for equal; names and the check of the words do not."""
    words = ["ab"[bin(k).count("1") & 1] for k in range(4096)]
    assert pr.runs_of_words(words) == []


@pytest.mark.parametrize("seed", range(8))
def test_catchers_work_online(seed):
    """Words one by one, in odd portions and at once: the same squares, so the same runs."""
    words = periodic_words(seed + 100)
    ids = np.array([ord(w) for w in words], np.uint64)
    found = []
    for sizes in ([1] * len(ids), [3, 17, 1, 64] * len(ids), [len(ids)]):
        catchers, at = pr.SquareCatchers(), 0
        for size in sizes:
            if at < len(ids):
                catchers.append(ids[at : at + size])
                at += size
        found.append(catchers.runs())
    assert found[0] == found[1] == found[2] == runs_by_hand(words)


def test_long_texts_of_one_word():
    assert pr.runs_of_words([b"w"] * 300_000) == [(0, 300_000, 1)]
    words = [b"%d" % (k % 70_000) for k in range(300_000)]
    assert pr.runs_of_words(words) == [(0, 300_000, 70_000)]


def test_words_that_share_a_hash(monkeypatch):
    words = [-1, -2] * 10  # hash(-1) == hash(-2)
    assert pr.runs_of_words(words) == [(0, 20, 2)]


def test_collapsed_texts(spark):
    rows = [(1, "x a a a a a a y"), (2, None), (3, ""), (4, " \t\n "), (5, "a b a b a b a b a"), (None, "q q q q q q"), (1, "x a a a a a a y"), (6, "café z café z")]
    got = pr.periodic_runs(docs_of(spark, rows)).collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got] == [
        (1, 8, [(1, 6, 1)], "x a y"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 9, [(0, 9, 2)], "a b"), (None, 6, [(0, 6, 1)], "q"), (1, 8, [(1, 6, 1)], "x a y"), (6, 2, [], "café z café z"),
    ]
    assert pr.periodic_runs(docs_of(spark, [])).count() == 0
    assert pr.periodic_runs(docs_of(spark, [(1, "a", 2)], DOCS + ", runs int")).columns == ["doc_id", "n_words", "runs", "text"]


def test_periodic_runs_query_equals_a_loop(spark):
    got = {r.doc_id: r for r in pr.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, r = runs_by_hand(words), got[d.doc_id]
        planted += bool(runs)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r["length"], r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert planted > 5


# ---- spelling variants


def near_by_hand(counts):
    """Neighbours by equal deletions: two words are near if a word without one code point is in both neighbourhoods."""
    keys = {}
    for w in counts:
        for k in range(len(w)):
            keys.setdefault((w[:k], w[k + 1 :]), set()).add(w)  # replaced at k
    near = {w: set() for w in counts}
    for group in keys.values():
        for w in group:
            near[w] |= group - {w}
    for w in counts:
        for k in range(len(w)):
            v = w[:k] + w[k + 1 :]
            if v in counts:
                near[w].add(v)
                near[v].add(w)
    return near


def variants_by_hand(counts):
    near, form = near_by_hand(counts), {}
    for w, vs in near.items():
        if vs:
            best = min(vs, key=lambda v: (-counts[v], v))
            if counts[best] >= 2 * counts[w]:
                form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def variants(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {tuple(r) for r in sv.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("seed, letters, lengths", [(0, "ab", (2, 7)), (1, "abc", (5, 9)), (2, "abé", (2, 5))])
def test_variants_equal_all_comparisons(spark, seed, letters, lengths):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(300)}
    counts = {w: rng.choice([3, 3, 4, 8, 20, 50]) for w in words}
    assert variants(spark, counts) == variants_by_hand(counts)


def test_each_two_near_words_are_found_from_one_side(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(4, 8))) for _ in range(200)})
    counts = {w: k + 3 for k, w in enumerate(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {tuple(r) for r in sv.one_way(df).select("word", "n", "near", "near_n").collect()}
    near = near_by_hand(counts)
    assert found == {(w, counts[w], v, counts[v]) for w in words for v in near[w] if (len(w), w) < (len(v), v)}
    assert {tuple(r) for r in sv.neighbours(df).select("word", "near", "near_n").collect()} == {(w, v, counts[v]) for w in words for v in near[w]}


def test_variants_of_long_words_and_long_shared_prefixes(spark):
    """Rounds follow the branches, not the length: code points without a branch are one edge."""
    a, b = "ab" * 2000, "c" * 70
    counts = {a: 9, a[:-1]: 3, a[1:]: 4, a[:1999] + "z" + a[2000:]: 4, a[:3000] + "y" + a[3000:]: 2, a[:-2]: 5, b: 3, b + "c": 40, b[:35] + "d" + b[36:]: 5, "d" + b: 6}
    assert variants(spark, counts) == variants_by_hand(counts)


def test_chains_of_forms_end_in_one_root(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    counts = {w: 3 * 2**k for k, w in enumerate(words)}
    got = {r[0]: r for r in variants(spark, counts)}
    assert {got[w][2] for w in words} == {"bbbbb"} and got["aaaaa"][1] == "aaaab" and got["bbbbb"][1] is None


def test_ties_go_to_the_first_in_code_point_order(spark):
    got = {r[0]: r for r in variants(spark, {"xxxxx": 3, "xxxxé": 9, "xxxxb": 9, "xxxxZ": 9})}
    assert got["xxxxx"][1] == "xxxxZ" and got["xxxxx"][4] == 3


def test_variants_of_odd_tables(spark):
    schema = "word string, n long"
    assert sv.spelling_variants(spark.createDataFrame([], schema)).count() == 0
    one = sv.spelling_variants(spark.createDataFrame([("alone", 3), (None, 9), ("", 4), ("x", 5)], schema)).orderBy("word").collect()
    assert [tuple(r) for r in one] == [("", None, "", 4, 0, None), ("alone", None, "alone", 3, 0, None), ("x", None, "x", 5, 0, None)]


def counts_by_hand(docs):
    counts, deleted = Counter(), 0
    lower = {i: i + 32 for i in range(65, 91)}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run, deleted = run[:k] + run[k + 1 :], deleted + 1
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}, deleted


def test_words_of_odd_texts(spark):
    rows = [(1, "ÉCOLE École École abc4abcde ABCDE abcde"), (2, None), (3, ""), (None, "abcde straße STRAßE straße İstanbul"), (1, "x" * 50_000 + " " + "y " * 9)]
    rows += rows[-1:] * 2
    got = sv.word_counts(sv.with_deletions(sv.letter_runs(docs_of(spark, rows))))
    want, _ = counts_by_hand(rows)
    assert {r.word: r.n for r in got.collect()} == want
    assert sv.word_counts(sv.with_deletions(sv.letter_runs(docs_of(spark, [])))).count() == 0


def test_spelling_query_equals_a_loop(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts, deleted = counts_by_hand(docs)
    assert deleted > 100
    got = {tuple(r) for r in sv.op13_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == variants_by_hand(counts)


def test_frontiers_stay_near_the_words(spark):
    """Words that share their first half with thousands of others still lead to few states each."""
    counts = {"shared" + "".join(p): 3 for p in __import__("itertools").product("abcdefghij", repeat=3)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    nodes = sv.trie(words).cache()
    edges = nodes.select("node", F.inline("edges")).withColumn("first", F.substring("label", 1, 1))
    frontier, most = sv._begin(words), 0
    for _ in range(8):
        frontier = sv._advance(frontier, nodes, edges).drop("near", "near_n").cache()
        most = max(most, frontier.count())
        frontier = frontier.where((F.col("pos") < F.length("text")) | (F.col("edits") == 0))
    assert most <= 60 * len(counts)


def test_tables_of_words_are_never_broadcast(spark, monkeypatch):
    plans = []
    kept = sv.materialize

    def planned(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, *more)

    monkeypatch.setattr(sv, "materialize", planned)
    words = spark.createDataFrame([("letter", 9), ("lettre", 4), ("leter", 2), ("letters", 30), ("other", 3)], "word string, n long")
    out = sv.spelling_variants(words)
    assert {r.word: r.root for r in out.collect()} == {"letter": "letters", "lettre": "lettre", "leter": "letters", "letters": "letters", "other": "other"}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
