"""Dedup operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factorloom.llm import common
from factorloom.llm import line_dedup as line_module
from factorloom.llm import simhash_dedup
from factorloom.llm.common import MembershipFilter, connected_components, give_back, join_skewed, map_batches, materialize, with_edits
from factorloom.llm.embedding_dedup import Forest, depth_for, similar_vectors, trees_for
from factorloom.llm.exact_dedup import DigestIndex, exact_dedup
from factorloom.llm.line_dedup import bucket_bits, drop_lines, line_dedup, within_edits, repeated_prefixes
from factorloom.llm.simhash_dedup import anchor_masks, bits_apart, keep_one_of_each, links_at_anchors, simhash_components
from factorloom.llm.substring_dedup import remove_repeats, repeated_spans, strip_repeats
from factorloom.llm.suffix_arrays import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, ctx long, n long, hot boolean, spans string, dropped string, _fm long"


def documents(spark, pairs):
    """Documents with further columns whose names occur inside the operators."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, True, "y", "z", 3) for i, t in pairs], SCHEMA)


def union_find(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


# ---- shared helpers


def test_components_of_chains_cliques_and_stars(spark):
    random.seed(1)
    edges = [(k, k + 1) for k in range(1, 60)] + [(200 + a, 200 + b) for a in range(8) for b in range(a)] + [(500, 500 + k) for k in range(1, 40)] + [(7, 7)]
    random.shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    ids = {x for e in edges for x in e}
    expected = union_find(ids, edges)
    assert {i: got.get(i, i) for i in ids} == expected
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_membership_filter_loses_nothing(spark):
    keys = spark.range(0, 5000).withColumnRenamed("id", "k")
    rows = spark.range(0, 50_000).withColumnRenamed("id", "k").withColumn("_fm", F.lit(1))
    kept = MembershipFilter(keys, "k", 5000).apply(rows, "k")
    assert kept.where("k < 5000").count() == 5000 and kept.count() < 12_000
    assert MembershipFilter(keys.where("k < 0"), "k", 0).apply(rows, "k").count() == 0


def test_skewed_join_equals_a_join(spark):
    rows = spark.range(0, 3000).select("id", F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).cast("long").alias("k"))
    table = rows.where("k < 30").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = join_skewed(rows, table, "k", "n", 3000).groupBy().agg(F.sum("m"), F.count("m"), F.count("*")).first()
    expected = rows.join(table, "k", "left").groupBy().agg(F.sum("m"), F.count("m"), F.count("*")).first()
    assert tuple(got) == tuple(expected)
    assert join_skewed(rows, table, "k", "n", 3000, "inner").count() == expected[1]


def test_edits_reach_their_rows(spark):
    docs = documents(spark, [(k, "a") for k in range(100)] + [(None, "b")])
    edits = spark.createDataFrame([(k, [k]) for k in range(0, 100, 3)], "doc_id long, e array<long>")
    rows = with_edits(docs, edits, "e").collect()
    assert len(rows) == 101 and all((r["e"] == [r["doc_id"]]) if r["doc_id"] is not None and r["doc_id"] % 3 == 0 else r["e"] is None for r in rows)


# ---- exact


PAIRS = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (3, None), (4, ""), (8, " "), (7, "x" * 300_000), (11, "x" * 300_000), (12, "é b"), (12, "é b"), (None, "a b")]


def exact_by_hand(pairs):
    texts = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in pairs if i is not None]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    return sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    more = [(100 + k, ["one", "two  words", "three"][k % 3]) for k in range(40)]
    args = {"digest": lambda sha: F.substring(sha, 1, 0)} if weak else {}
    pairs = [p for p in PAIRS if p[0] != 12] + more if weak else PAIRS + more
    got = sorted(tuple(r) for r in exact_dedup(documents(spark, pairs), **args).collect())
    assert got == exact_by_hand(pairs)


def test_digest_index_over_several_flushes(spark):
    random.seed(1)
    index, seen = DigestIndex(), defaultdict(list)
    for k in range(6):
        rows = [(random.choice("abcdefgh") * 3 + str(k % 2), 100 * k + j) for j in range(30)]
        for d, i in rows:
            seen[d].append(i)
        index.flush(spark.createDataFrame(rows, "digest string, doc_id long"))
    assert [len(x) for x in index.levels] == [2, 1]
    ask = spark.createDataFrame([(d,) for d in [*seen, "none"]], "digest string")
    expected = {d: (min(i), len(i)) for d, i in seen.items()}
    assert {r["digest"]: (r["keep_id"], r["n"]) for r in index.lookup(ask).collect()} == expected
    index.compact()
    assert len(index.runs()) == 1
    assert {r["digest"]: (r["keep_id"], r["n"]) for r in index.lookup(ask).collect()} == expected
    assert DigestIndex().lookup(ask).count() == 0


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(documents(spark, [])).count() == 0


# ---- suffix arrays


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(0)
    for t in range(300):
        s = np.append(rng.integers(1, rng.choice([2, 3, 5, 40]) + 1, rng.integers(0, 60)), 0)
        if t % 5 == 0:
            s = np.append(np.tile(rng.integers(1, 3, rng.integers(1, 5)), 10), 0)
        expected = sorted(range(len(s)), key=lambda i, s=s: s[i:].tolist())
        sa = suffix_array(s, int(s.max()) + 1)
        assert sa.tolist() == expected
        lcp = common_prefixes(s, sa, 1000)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            k = 0
            while a + k < len(s) and b + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert lcp[b] == k
    big = np.append(rng.integers(1, 4, 5000), 0)  # the top level by buckets
    assert suffix_array(big, 4).tolist() == sorted(range(len(big)), key=lambda i: tuple(big[i : i + 60]))


def spans_by_hand(pairs, length):
    seen = defaultdict(list)
    texts = [(i, (t or "").encode()) for i, t in pairs if i is not None]
    for k, (_, b) in enumerate(texts):
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]].append((k, s))
    cover = [bytearray(len(b)) for _, b in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                cover[k][s : s + length] = b"\1" * length
    out = []
    for (i, b), c in zip(texts, cover, strict=True):
        kept = bytes(x for x, m in zip(b, c, strict=True) if not m)
        out.append((i, len(b), sum(c), len(re.findall(b"\1+", bytes(c))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeating(seed=3):
    random.seed(seed)
    base = ["".join(random.choice("abé \n") for _ in range(random.randint(300, 900))) for _ in range(5)]
    pairs = []
    for i in range(70):
        s = random.choice(base)
        if random.random() < 0.7:
            k = random.randrange(len(s))
            s = s[:k] + random.choice("xyz") + s[k + random.randint(0, 2) :]
        if random.random() < 0.3:
            s += random.choice(base)
        if random.random() < 0.1:
            s = "ab" * random.randint(100, 500)
        pairs.append((i, s[:50] if random.random() < 0.1 else s))
    return [*pairs, (500, None), (501, ""), (502, "z" * 1000), (None, base[0])]


def test_removed_repeats(spark):
    pairs = repeating()
    got = sorted(tuple(r) for r in remove_repeats(documents(spark, pairs)).collect())
    assert got == spans_by_hand(pairs, 400)


@pytest.mark.parametrize("most", [1, 3])
def test_crowded_cores_are_dealt_out(spark, most):
    pairs = repeating(4)
    spans = {r[0]: sum(s["hi"] - s["lo"] for s in r[1]) for r in repeated_spans(documents(spark, pairs), 400, core_parts=most).collect()}
    assert all(spans.get(i, 0) == n for i, _, n, _, _ in spans_by_hand(pairs, 400))


def test_stripped_texts_keep_whole_characters(spark):
    pairs = repeating(5)
    out = strip_repeats(documents(spark, pairs))
    assert out.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")] and out.count() == len(pairs)
    for r in out.where("text is not null").collect():
        assert r["n_chars"] == len(r["text"])
    assert strip_repeats(documents(spark, [])).count() == 0


# ---- lines


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return len(b) - len(a) == 1 and a[k:] == b[k + 1 :]


def lines_by_hand(pairs, least=20):
    first, by, out = set(), defaultdict(list), []
    for i, t in sorted((p for p in pairs if p[0] is not None), key=lambda p: p[0]):
        lines, kept = (t or "").split("\n"), []
        for line in lines:
            if len(line) >= least:
                near = any(within_one(line, o) for n in (-1, 0, 1) for o in by[len(line) + n])
                if line not in first:
                    first.add(line)
                    by[len(line)].append(line)
                if near:
                    continue
            kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def lined(seed=2):
    random.seed(seed)
    base = ["".join(random.choice("abcé😀 ") for _ in range(random.randint(18, 40))) for _ in range(40)]
    pairs = []
    for i in range(80):
        lines = []
        for _ in range(random.randint(0, 8)):
            line, r = random.choice(base), random.random()
            k = random.randrange(len(line) + 1)
            edits = [line[:k] + random.choice("abx") + line[k:], line[:k] + line[k + 1 :], line[:k] + random.choice("xyz") + line[k + 1 :], line]
            lines.append(edits[min(3, int(r * 5))])
        pairs.append((i * 3, "\n".join(lines)))
    return [*pairs, (1000, None), (1001, ""), (1002, "a" * 30), (1003, "a" * 29), (1004, "a" * 31 + "\n" + "a" * 33), (None, base[0])]


def test_line_dedup(spark):
    pairs = lined()
    assert sorted(tuple(r) for r in line_dedup(documents(spark, pairs)).collect()) == lines_by_hand(pairs)


def test_dropped_lines_keep_rows_and_columns(spark):
    pairs = lined(7)
    out = drop_lines(documents(spark, pairs))
    assert out.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")] and out.count() == len(pairs)
    assert drop_lines(documents(spark, [])).count() == 0 and line_dedup(documents(spark, [])).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bounded_edit_distance():
    random.seed(12)
    for _ in range(1500):
        a = "".join(random.choices("ab😀", k=random.randint(0, 40)))
        b = list(a)
        for _ in range(random.randint(0, 5)):
            k = random.randint(0, len(b))
            b[k : k + random.randint(0, 2)] = random.choices("abc", k=random.randint(0, 2))
        b = "".join(b)
        for most in (0, 1, 2, 5):
            assert within_edits(a, b, most) == (distance(a, b) <= most), (a, b, most)
    long = "".join(random.choices("abc ", k=300_000))
    assert within_edits(long, long[:1000] + "x" + long[1001:200_000] + long[200_001:], 2) and not within_edits(long, long[::-1], 5)


def test_edit_bound_grows_with_the_line(spark):
    random.seed(11)
    lines = []
    for _ in range(24):
        base = "".join(random.choice("abcdé ") for _ in range(random.choice([20, 30, 63, 64, 66, 95, 97, 128, 160, 170, 203])))
        for edits in (0, 1, 2, 3, 4, 5, 6):
            chars = list(base)
            for _ in range(edits):
                k = random.randrange(len(chars))
                chars[k : k + random.randint(0, 1)] = random.choice(["", "x", "yz"[random.randint(0, 1)]])
            lines.append("".join(chars))
    random.shuffle(lines)
    lines += ["}", "", "ok", "}", "", "a" * 400, "a" * 404, "ab" * 100, "ba" * 100]
    expected = []
    for i, line in enumerate(lines):
        bound = lambda o, line=line: min(5, max(1, min(len(o), len(line)) // 32))
        near = any(o == line or (min(len(o), len(line)) >= 20 and abs(len(o) - len(line)) <= 5 and distance(o, line) <= bound(o)) for o in lines[:i])
        expected.append(int(bool(line) and near))
    got = line_dedup(documents(spark, list(enumerate(lines))), exact_chars=1, max_edits=5).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == expected and sum(expected) > 60


def test_far_lines_of_odd_tables(spark):
    schema = "doc_id long, text string, keys string, digest int"
    assert line_dedup(spark.createDataFrame([], schema), exact_chars=1, max_edits=5).count() == 0
    base = "".join(random.Random(3).choices("abcdefgh ", k=200))
    near = base[:50] + "XY" + base[52:]
    rows = [(1, None), (2, ""), (3, base), (3, base), (4, near + "\n" + "a" * 5000), (5, base + "\nshort"), (None, base)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], schema)
    got = line_dedup(docs, exact_chars=1, max_edits=5).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_removed"]) for r in got] == [(1, 0), (2, 0), (3, 0), (3, 0), (4, 1), (5, 1)]


def test_repeated_prefixes(spark):
    rng = np.random.default_rng(5)
    keys = np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, 3000), [0, -1, (1 << 63) - 1, -(1 << 63)]])
    keys = np.concatenate([keys, rng.choice(keys, 700), np.repeat(keys[:2], 500), keys[-4:]])
    grams = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(5)
    for bits in (10, 32):
        prefixes, n = np.unique(keys.view(np.uint64) >> np.uint64(32 - bits), return_counts=True)
        got = [r["prefix"] for r in repeated_prefixes(grams, bits).collect()]
        assert sorted(got) == sorted(prefixes[n > 1].view(np.int64).tolist()) and len(got) >= 600
    assert repeated_prefixes(grams.where("false"), 10).count() == 0
    assert bucket_bits(0) == 10 and bucket_bits(10**12) == 25 and bucket_bits(10**18) == 32


# ---- SimHash


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("checks", [4, 5])
def test_anchors_cover(checks):
    """Every two blocks that differ in at most two bits share an anchor."""
    masks, size = anchor_masks(checks), 1 << checks

    def around(x):
        s = 0
        for p in range(1, size):
            if x >> (p - 1) & 1:
                s ^= p
        return {x ^ m for m in masks[s]}

    random.seed(1)
    for _ in range(200):
        x = random.getrandbits(size)
        a = around(x)
        for i in range(size):
            for j in range(i, size):
                assert a & around(x ^ (1 << i) ^ (1 << j)) if i != j else a & around(x ^ (1 << i))


@pytest.mark.parametrize("crowd", [4096, 1])
def test_links_connect_what_is_close(spark, crowd):
    random.seed(5)
    points = {random.getrandbits(64) for _ in range(150)}
    for p in sorted(points)[:60]:
        for _ in range(25):
            x = p
            for b in random.sample(range(64), random.randint(1, 6)):
                x ^= 1 << b
            points.add(x)
    ids = dict(enumerate(sorted(points)))
    df = spark.createDataFrame([(bytearray(x.to_bytes(8, "little")), [x if x < 2**63 else x - 2**64], i) for i, x in ids.items()], "fp binary, words array<long>, id long")
    got = {r["node"]: r["component"] for r in connected_components(links_at_anchors(df, crowd=crowd)).collect()}
    expected = union_find(ids, [(a, b) for a in ids for b in range(a) if (ids[a] ^ ids[b]).bit_count() <= 4])
    assert {i: got.get(i, i) for i in ids} == expected


def test_crowded_anchors_are_counted_by_buckets_first(spark):
    rng = random.Random(3)
    rows = [(a,) for a in (5, 6, 7, -8) for _ in range(40)] + [(9,)] * 39 + [(rng.randrange(1 << 40),) for _ in range(3000)]
    sent = spark.createDataFrame(rows, "anchor long")
    crowds = simhash_dedup.crowded_anchors(sent, len(rows), 39)
    assert {tuple(r) for r in crowds.select("anchor", "n").collect()} == {(a, 40) for a in (5, 6, 7, -8)}
    assert simhash_dedup.crowded_anchors(sent, len(rows), 40) is None and simhash_dedup.crowded_anchors(sent.limit(0), 0, 40) is None


def test_freed_memory_is_given_back(spark):
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Anonymous:"))

    many = [bytes(1000) for _ in range(200_000)]  # small pieces, which free() keeps below the last one
    most, last = held(), bytes(2000)
    del many
    give_back()
    assert held() < most - 100_000 and len(last) == 2000
    assert sorted(r[0] for r in map_batches(spark.range(50).repartition(3), lambda batches: batches, "id long").collect()) == list(range(50))


def test_simhash_components(spark):
    random.seed(6)
    words = ["w%d" % k for k in range(400)]
    pairs = []
    for i in range(60):
        text = " ".join(random.choices(words, k=300))
        pairs.append((i * 10, text))
        pairs += [(i * 10 + k, text.replace(" w1 ", f" v{k} ").upper()) for k in range(1, 4)]
    pairs += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "One  Two"), (2005, "é Ä"), (2005, "é Ä"), (None, "x")]
    rows = [p for p in pairs if p[0] is not None]
    fps = [(i, fingerprint_by_hand(t)) for i, t in rows]
    expected = union_find({i for i, _ in fps}, [(a, b) for k, (a, x) in enumerate(fps) for b, y in fps[:k] if (x ^ y).bit_count() <= 4])
    got = sorted(tuple(r) for r in simhash_components(documents(spark, pairs)).collect())
    assert got == sorted((i, f"{x:016x}", expected[i]) for i, x in fps)
    kept = sorted(r["doc_id"] for r in keep_one_of_each(documents(spark, pairs)).where("doc_id is not null").collect())
    assert kept == sorted(i for i, _ in fps if expected[i] == i)
    assert simhash_components(documents(spark, [])).count() == 0


def test_near_copies_at_a_similarity(spark):
    """Of planted pairs well above a Jaccard similarity of 0.8 by five words most are found, of those well below few, of others none."""
    random.seed(9)
    words = ["w%d" % k for k in range(5000)]
    pairs, similarity = [], {}
    for i in range(240):
        base = random.choices(words, k=400)
        other = list(base)
        for k in random.sample(range(400), i // 24 * 2):
            other[k] = "v%d" % random.randrange(10**6)
        a, b = ({tuple(x[k : k + 5]) for k in range(396)} for x in (base, other))
        similarity[i] = len(a & b) / len(a | b)
        pairs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in simhash_components(documents(spark, pairs), bits_apart(0.8, 3), 5, 3).collect()}
    linked = {i: got[2 * i] == got[2 * i + 1] for i in similarity}
    assert all(got[2 * i] in (2 * i,) and got[2 * i + 1] in (2 * i, 2 * i + 1) for i in similarity)  # only pairs link
    rate = lambda lo, hi: np.mean([linked[i] for i, s in similarity.items() if lo <= s < hi])
    print("found at 0.95+, 0.88+, 0.80+:", rate(0.95, 2), rate(0.88, 0.95), rate(0.8, 0.88))
    assert rate(0.95, 2) > 0.97 and rate(0.88, 0.95) > 0.8 and rate(0, 0.7) < 0.25


def test_near_copies_are_verified(spark):
    """Links at a Jaccard similarity of 0.8 by five words: nine of ten pairs in [0.80, 0.88), nearly all above, none below."""
    random.seed(10)
    words = ["w%d" % k for k in range(5000)]
    pairs, similarity = [], {}
    for i in range(330):
        base = random.choices(words, k=random.choice([150, 400, 900]))
        other, n = list(base), len(base)
        for k in random.sample(range(n), 1 + int(n * random.uniform(0, 0.035))):
            other[k] = "v%d" % random.randrange(10**6)
        a, b = ({tuple(x[k : k + 5]) for k in range(n - 4)} for x in (base, other))
        similarity[i] = len(a & b) / len(a | b)
        pairs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    found = simhash_components(documents(spark, pairs), bits_apart(0.8, 4, 2.2), 5, 4, similarity=0.8)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    linked = {i: got[2 * i] == got[2 * i + 1] for i in similarity}
    part = lambda lo, hi: [linked[i] for i, s in similarity.items() if lo <= s < hi]
    assert not any(part(0, 0.8)) and len(part(0.7, 0.8)) > 20
    assert np.mean(part(0.8, 0.88)) >= 0.9 and len(part(0.8, 0.88)) > 40
    assert np.mean(part(0.88, 2)) > 0.98


def test_verified_near_copies_of_odd_texts(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    pairs = [(1, "a b c"), (2, "A b  c"), (3, None), (4, ""), (5, " "), (6, "a b d"), (None, "a b c"), (7, long), (8, long + " end"), (1, "a b c"), (7, "something else")]
    found = simhash_components(documents(spark, pairs), bits_apart(0.8, 4, 2.2), 5, 4, similarity=0.8).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7), (7, 7), (8, 7)]
    assert simhash_components(documents(spark, []), 40, 5, 4, similarity=0.8).count() == 0


@pytest.mark.parametrize("frequent", [True, False])
def test_near_copies_all_link(spark, monkeypatch, frequent):
    """Every link of a Jaccard similarity of 0.8 by five words and no other: repeated shingles, chains, groups of copies, shared passages."""
    if not frequent:
        monkeypatch.setattr(simhash_dedup, "ORDER_LEAST", 10**9)
    rng = random.Random(12)
    words = ["w%d" % k for k in range(5000)]
    passage, texts = rng.choices(words, k=60), []
    for i in range(120):  # around the bound
        base = rng.choices(words, k=rng.choice([8, 40, 150, 400])) + passage * (i % 3 == 0)
        other = list(base)
        for k in rng.sample(range(len(base)), 1 + int(len(base) * rng.uniform(0, 0.035))):
            other[k] = "v%d" % rng.randrange(10**6)
        texts += [base, other]
    for i in range(12):  # a phrase over and over in one of two texts with nearly the same shingles
        base = rng.choices(words, k=200)
        texts += [base, base[:100] + base[90:100] * 60 + base[100:], rng.choices(words, k=30) + passage * 40, rng.choices(words, k=30) + passage * 40]
    base = rng.choices(words, k=300)
    for _ in range(60):  # a large group, in which some pairs link and others don't
        other = list(base)
        for k in rng.sample(range(300), rng.randrange(3, 9)):
            other[k] = "v%d" % rng.randrange(10**6)
        texts.append(other)
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    found = simhash_components(documents(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), bits_apart(0.8, 4, 2.2), 5, 4, similarity=0.8)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == union_find(range(len(sets)), links)


def test_pipeline_cuts_passages_of_over_50_words(spark):
    """Passages of 51 words and 300 bytes are cut from both documents; those of 40 words stay, as do all rows."""
    import corpus_pipeline

    rng = random.Random(14)
    own = lambda n: " ".join("w%04d" % rng.randrange(10_000) for _ in range(n))
    passage, short, long_words = own(51), own(40), " ".join("x" * 20 + str(k) for k in range(10, 30))
    assert len(passage) == 305 and len(short) >= corpus_pipeline.PASSAGE_BYTES and len(long_words) > 400
    heads = [own(30) for _ in range(6)]
    texts = [f"{h} {p} end{k}." for k, (h, p) in enumerate(zip(heads, [passage, passage, short, short, long_words, long_words], strict=True))]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.substrings(spark, documents(spark, list(enumerate(texts))), "").collect()}
    assert [got[k] for k in (0, 1)] == [f"{heads[k]}{k}." for k in (0, 1)]  # the run takes the blanks and "end", too
    assert got[2] == texts[2] and got[3] == texts[3] and not any("xx1" in got[k] for k in (4, 5)) and len(got) == 6


def test_few_keys_leave_most_rows_where_they_are(spark):
    rows = spark.range(20_000).select(F.struct(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("int").alias("line")).alias("at"), F.md5(F.col("id").cast("string")).alias("digest"))
    keys = rows.where("at.doc_id % 1000 = 3")
    for key in ("at", "digest"):
        some = line_module.rows_with(rows, keys.select(key), key)
        assert some.columns == rows.columns
        assert some.join(keys.select(key), key, "left_semi").count() == 20 and some.count() < 2000
    assert line_module.rows_with(rows, keys.limit(0), "at").count() == 0


def test_far_lines_of_a_large_group(spark, monkeypatch):
    """A line of a large group whose nearest lines by parities are too far is compared with all others, too."""
    rng = random.Random(15)
    base = "".join(rng.choices("abcdefgh ", k=200))
    lines = [base]
    for k in range(40):
        x = list(base)
        for at in rng.sample(range(200), rng.randrange(3, 9)):
            x[at] = rng.choice("abcdefgh")
        lines.append("".join(x))
    lines.append("".join(reversed(base)))
    expected = [k for k, x in enumerate(lines) if any(within_edits(x, y, 5) for y in lines[:k])]
    assert 10 < len(expected) < 40
    for few, nearest in ((16, 3), (64, 1), (2, 1)):
        monkeypatch.setattr(line_module, "FEW_LINES", few)
        monkeypatch.setattr(line_module, "NEAREST", nearest)
        rows = drop_lines(documents(spark, list(enumerate(lines))), max_edits=5).collect()
        assert sorted(r["doc_id"] for r in rows if r["text"] == "") == expected


@pytest.mark.parametrize("n_lines", [10, 60])
def test_lines_of_a_group_meet_at_one_gram(spark, n_lines):
    rng = random.Random(n_lines)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    lines = []
    for _ in range(n_lines):
        at = rng.randrange(390)
        lines.append(base[:at] + "".join(rng.sample("ijklmnop", rng.randrange(1, 4))) + base[at:])
    index, codes, _ = line_module.line_grams(lines)
    keys = [sorted({int(c) for c in codes[index == k]}) for k in range(n_lines)]
    odd = line_module.parities(lines)
    schema = "key long, at struct<doc_id:long,line:int>, n int, p0 long, p1 long, p2 long, open boolean, less array<long>"
    rows = [(key, (k, 0), len(lines[k]), *map(int, odd[k]), k % 3 > 0, [x for x in keys[k] if x < key]) for k in range(n_lines) for key in keys[k]]
    got = [(r["at"]["doc_id"], r["o_at"]["doc_id"]) for r in line_module.gram_pairs(spark.createDataFrame(rows, schema), 32, 5, None).collect()]

    def may(a, b):
        apart = np.bitwise_count(odd[a].view(np.uint64) ^ odd[b].view(np.uint64))
        return set(keys[a]) & set(keys[b]) and abs(len(lines[a]) - len(lines[b])) <= 5 and apart[0] <= 10 and int(apart[1]) + int(apart[2]) <= 20

    assert sorted(got) == [(a, b) for a in range(n_lines) for b in range(a) if a % 3 and may(a, b)]
    assert len(got) > n_lines


def test_edits_of_many_pairs_at_once():
    rng = random.Random(9)
    lines, pairs = [], []
    for _ in range(1500):
        x = [rng.choice("ab") for _ in range(rng.randrange(30))]
        y = list(x)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", "a", "é", "\U0001f600"])
        pairs.append((len(lines), len(lines) + 1, rng.randrange(6)))
        lines += ["".join(x), "".join(y)]
    a, b, most = np.array(pairs).T
    got = line_module.all_within_edits(lines, a, b, most)
    assert got.tolist() == [line_module.within_edits(lines[i], lines[j], k) for i, j, k in pairs]
    assert 0.3 < got.mean() < 0.9
    assert line_module.all_within_edits(lines, a[:0], b[:0], most[:0]).tolist() == []


@pytest.mark.parametrize("n_lines", [12, 40])
def test_open_lines_leave_no_pairs(spark, n_lines):
    """Near copies of which only a few are within their bound: a row for each such line comes back, whatever the number of pairs."""
    rng = random.Random(n_lines)
    base = [rng.choice("abcdefgh") for _ in range(300)]

    def copy(k):
        x = list(base)
        for at in rng.sample(range(80, 300), 4):
            x[at] = "ijkl"[k % 4]
        return "".join(x)

    lines = [copy(k) for k in range(n_lines)]
    lines[-1] = lines[1][:-2] + "zz"
    odd = line_module.parities(lines)
    index, codes, _ = line_module.line_grams(lines, 32, 5)
    keys = [sorted({int(c) for c in codes[index == k]}) for k in range(n_lines)]
    schema = "key long, at struct<doc_id:long,line:int>, n int, p0 long, p1 long, p2 long, open boolean, less array<long>, text string, digest binary"
    rows = [
        (key, (k, 0), len(lines[k]), *map(int, odd[k]), k % 3 > 0, [x for x in keys[k] if x < key], lines[k], b"%d" % k)
        for k in range(n_lines)
        for key in keys[k]
    ]
    met = spark.createDataFrame(rows, schema)
    got = sorted(int(r["digest"]) for r in line_module.gram_pairs(met, 32, 5, None).collect())
    assert got == [a for a in range(n_lines) if a % 3 and any(line_module.within_edits(lines[a], lines[b], 5) for b in range(a))]
    assert (n_lines - 1 in got) == ((n_lines - 1) % 3 > 0)
    pairs = line_module.gram_pairs(met.drop("text", "digest"), 32, 5, None).collect()
    assert len(pairs) > n_lines
    mates = [(r["key"], int(r["digest"])) for r in line_module.gram_pairs(met.drop("text"), 32, 5, None).collect()]
    least = {(min(set(keys[a]) & set(keys[b])), k) for a, b in ((p["at"]["doc_id"], p["o_at"]["doc_id"]) for p in pairs) for k in (a, b)}
    assert sorted(mates) == sorted(least)


def test_executors_rest_before_each_stage(spark, monkeypatch):
    import corpus_pipeline

    rests = []
    monkeypatch.setattr(corpus_pipeline, "rest_executors", rests.append)
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES[-2:]:
        docs = stage(spark, docs, "")
    assert rests == [spark, spark]
    monkeypatch.undo()

    def used():
        jvm = spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean()
        return jvm.getHeapMemoryUsage().getUsed()

    spark._jvm.java.util.ArrayList(spark._jvm.java.util.Collections.nCopies(30_000_000, None))  # garbage at once
    before = used()
    common.rest_executors(spark)
    assert used() < before


def test_anchors_cost_the_driver_little(spark, monkeypatch):
    words = spark.createDataFrame([([1, -1, 1 << 40, 12345],)], "words array<long>")
    plan = words.select(simhash_dedup._tagged_anchors(F.col("words"), 4, 5).alias("a"))
    assert len(plan._jdf.queryExecution().logical().toJSON()) < 300_000
    rests = []
    monkeypatch.setattr(common, "rest_driver", rests.append)
    for k in range(2 * common.TABLES_A_REST):
        materialize(words, "few")
    assert len(rests) == 2
    monkeypatch.undo()
    common.rest_driver(spark)


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing names and empty tables through all stages, one after the other."""
    import corpus_pipeline

    line = "this line of the document is long enough to be looked at by all stages of the pipeline"
    rows = [(k, f"{line} number {k} {k * k}\n" + " ".join(f"w{k}x{j}" for j in range(60)), "en", "s", 1, 7) for k in range(40)]
    rows += [(100, None, None, None, None, None), (101, "", "en", "s", 0, 1), (None, line, "en", "s", 1, 1), (3, rows[3][1], "en", "s", 1, 1), (102, rows[4][1], "en", "s", 1, 1), (103, "\n\n \n", "en", "s", 3, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long"
    sf = str(tmp_path)
    for name, docs in (("some", rows), ("none", [])):
        spark.createDataFrame(docs, schema).write.parquet(f"{sf}/{name}/documents.parquet")
        spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(40)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/{name}/labels.parquet")
    kept = spark.read.parquet(f"{sf}/some/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, materialize(stage(spark, kept, f"{sf}/some"), "stage")
        assert kept.columns == before.columns and 0 < kept.count() <= before.count()
    packed = corpus_pipeline.packing(spark, kept, f"{sf}/some").collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept.collect()}
    assert corpus_pipeline.run(spark, f"{sf}/none").count() == 0


# ---- embeddings


def test_similar_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    x = np.array([base[rng.integers(30)] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3]) for _ in range(600)])
    x = np.concatenate([x, x[:40], x[:5]])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    degrees = close.sum(axis=1) - 1
    parts = union_find(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(close), strict=True) if a < b])
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] + [None] * 15, [float("inf")] * 16]
    rows = [(k, [float(v) for v in r], 1) for k, r in enumerate(x)] + [(5000 + k, v, 1) for k, v in enumerate(odd)] + [(6000, [1.0, 2.0], 1), (6001, [2.0, 4.0], 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int")
    got = {r["vec_id"]: r for r in similar_vectors(df, leaf=32).collect()}
    assert len(got) == len(rows) - 1
    found = sum(got[k]["n_links"] for k in range(len(x)))
    assert found >= 0.99 * degrees.sum() and all(got[k]["n_links"] <= degrees[k] for k in range(len(x)))
    assert np.mean([got[k]["component_id"] == parts[k] for k in range(len(x))]) > 0.99
    assert all(got[5000 + k]["n_links"] == 0 and got[5000 + k]["kept"] for k in range(len(odd)))
    assert got[6001]["component_id"] == 6000 and got[6001]["n_links"] == 1 and not got[6001]["kept"]
    assert similar_vectors(df.where("vec_id < 0")).count() == 0


def planted(n, dim, rng, pairs, dense=0, noise=0.0):
    """Random vectors, of which some have a partner at a cosine just above 0.95, and a dense group."""
    x = rng.standard_normal((n, dim))
    for k in range(pairs):
        a = x[2 * k] / np.linalg.norm(x[2 * k])
        b = rng.standard_normal(dim)
        b -= (b @ a) * a
        x[2 * k + 1] = a * 0.955 + b / np.linalg.norm(b) * (1 - 0.955**2) ** 0.5
    if dense:
        centre = rng.standard_normal(dim)
        x[-dense:] = centre + noise * rng.standard_normal((dense, dim))
    return x


def links_by_hand(x):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return (unit @ unit.T >= 0.95).sum(axis=1) - 1


@pytest.mark.parametrize("n", [3000, 12_000])
def test_recall_of_planted_links(spark, n):
    x = planted(n, 32, np.random.default_rng(n), 600)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in similar_vectors(df, leaf=64).collect()}
    degrees = links_by_hand(x)
    recall = sum(got.values()) / degrees.sum()
    print("recall of planted links", n, recall)
    assert recall >= 0.97 and all(got[k] <= degrees[k] for k in range(n))


def test_dense_group_is_kept_together_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = planted(6000, 32, rng, 200, dense=2000, noise=0.17).astype(np.float32)
    forest = Forest((x / np.linalg.norm(x, axis=1)[:, None]).astype(float), len(x), leaf=64, block=300)
    row, code = forest.leaves(x[-2000:] / np.linalg.norm(x[-2000:], axis=1)[:, None])
    assert len(forest.blocked) and len(row) / 2000 < 6 * len(forest.directions)
    index, block, cell = forest.cells(code, np.arange(len(code)) % 2000)
    sizes = np.unique(np.stack([code[index], cell]), axis=1, return_counts=True)[1]
    assert sizes.max() < 1200
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    rows = {r["vec_id"]: r for r in similar_vectors(df, leaf=64, block=300).collect()}
    degrees = links_by_hand(x.astype(float))
    found = sum(r["n_links"] for r in rows.values())
    assert found >= 0.99 * degrees.sum() and all(rows[k]["n_links"] <= degrees[k] for k in range(len(x)))


def test_extreme_magnitudes(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [2e-200, -1e-200]), (4, [1.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}


def test_copies_of_a_vector_by_number_of_vectors():
    copies = {n: trees_for(depth_for(n)) * (1 + 0.127) ** depth_for(n) for n in (10**4, 10**6, 10**8)}
    print("expected copies a vector", copies)
    assert copies[10**4] < 12 and copies[10**8] < 100
