"""Spelling variants: words one edit apart, by a frontier of states that descends a distributed trie.

The trie is a table of nodes, each with its edges: a node is a prefix at which a
word ends, words branch or a search begins; an edge carries the code points to the
next node below, so stretches without a branch are one step.  A state is a word, a
position in it, a node and the edits made.  Each round joins all states with the
node table, follows the edges that the word allows, and keeps states at whose node
the word is not at its end; those at its end with one edit are neighbours.

One edit leaves a half of the word as it is.  So searches do not begin at the
root, whose edges every word would follow: they begin below the first half, with
the edit in the second, and once more in the trie of the reversed words, with the
edit in the first.  Prefixes shorter than that are not in the table at all.

Near words are near in both directions, so each two are found from one side only:
from the shorter word, or the one whose code point at the edit is smaller.  The
other direction is the same pair turned round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, result, scratch_scope

MIN_CHARS, MIN_COUNT = 5, 3
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
STARTS = 63  # bits for code points that may follow
LONG_REST = 62  # lengths from here on share a bit
WHOLE = 32  # code points of a node's name that are kept as they are; longer ones end in a digest


def _name(side: Column, prefix: Column) -> Column:
    """The node of a prefix: the prefix itself, or its begin and a digest of all of it."""
    long = F.concat(F.substring(prefix, 1, WHOLE), F.lit("#"), F.sha2(prefix.cast("binary"), 256))
    return F.concat(side, F.when(F.length(prefix) <= WHOLE, prefix).otherwise(long))


def _bit_of(character: str) -> str:
    """SQL of a long with the bit of a code point."""
    return f"shiftleft(1L, ascii({character}) % {STARTS})"


def _fits(k: str) -> Column:
    """Whether what is left of the word after ``k`` (SQL) more code points may follow at the child: by its length and its next code point."""
    rest = f"length(text) - pos - ({k})"
    begins = f"getbit(starts, ascii(substr(text, pos + 1 + ({k}), 1)) % {STARTS}) = 1"
    return F.expr(f"CASE WHEN {rest} < 0 THEN false ELSE getbit(rests, least({LONG_REST}, {rest})) = 1 AND ({rest} = 0 OR {begins}) END")


def _growing(table: DataFrame) -> DataFrame:
    """``table`` as a side of a join that is never broadcast: it grows with the words, and Spark sizes an exploded table, or a packed file, too low."""
    return table.hint("merge")


def _left(text, n) -> Column:
    return F.substr(text, F.lit(1), n)


def letter_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, run`` for every maximal run of at least ``min_chars`` letters in the whole texts; A to Z in lower case."""
    pattern = f"{LETTERS}{{{min_chars},}}"
    run = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")  # then the built-in lower case is that of A to Z alone
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return run.select("doc_id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", upper, upper.lower())).alias("run"))


def _search_begin(side: str, length: Column) -> Column:
    """Code points before a search in a trie: the first half, of the reversed words the longer one; none for words of up to three."""
    half = F.floor(length / 2).cast("int")
    return F.when(length > 3, half if side == "f" else length - half).otherwise(0)


def trie(words: DataFrame) -> DataFrame:
    """``node, edges`` over ``words`` (``word, n``); an edge has ``label, child, word, n, starts, rests``.

    ``word`` and ``n`` are set where a word ends at the child; ``starts`` has a bit
    for the code points that follow there (some share one), ``rests`` for each
    length that may follow (the last for all longer ones).
    A word's prefixes count from where searches of words of about its length begin.  Node names start with ``f`` for words as they are and ``r``
    for reversed ones.
    """
    both = words.select(
        "word", "n", F.explode(F.array(F.struct(F.lit("f").alias("side"), F.col("word").alias("text")), F.struct(F.lit("r").alias("side"), F.reverse("word").alias("text")))).alias("x")
    ).select("word", "n", "x.*")
    length = F.length("text")
    begin = lambda n: F.when(F.col("side") == "f", _search_begin("f", n)).otherwise(_search_begin("r", n))
    first = F.least(*(begin(length + k) for k in (-1, 0, 1)))
    at = both.select("*", begin(length).alias("begin"), F.explode(F.sequence(first, length)).alias("pos"))
    at = at.withColumn("node", _name(F.col("side"), _left("text", F.col("pos"))))
    following = F.substr("text", F.col("pos") + 1, F.lit(1))  # empty where the word ends
    left = F.expr(f"shiftleft(1L, least({LONG_REST}, length(text) - pos))")
    seen = at.groupBy("node").agg(
        F.min(following).alias("a"), F.max(following).alias("b"), F.bool_or(F.col("pos") == F.col("begin")).alias("begins"),
        F.bit_or(F.when(following != "", F.expr(_bit_of("substr(text, pos + 1, 1)")))).alias("starts"), F.bit_or(left).alias("rests"),
    )
    nodes = seen.where("a <> b or a = '' or begins").select("node", "starts", "rests")
    # the nodes on each word's path, and between each two of them an edge
    path = at.select("word", "n", "text", "pos", "node").join(_growing(nodes), "node").groupBy("word", "n", "text", F.substring("node", 1, 1).alias("side"))
    path = path.agg(F.sort_array(F.collect_list(F.struct("pos", "node", "starts", "rests"))).alias("path"))
    step = F.posexplode(F.slice("path", F.lit(2), F.size("path") - 1)).alias("k", "to")
    edges = path.where(F.size("path") > 1).select("word", "n", "text", "path", step).withColumn("from", F.get("path", F.col("k")))
    ends = F.col("to.pos") == F.length("text")
    edges = edges.select(
        F.col("from.node").alias("node"), F.substr("text", F.col("from.pos") + 1, F.col("to.pos") - F.col("from.pos")).alias("label"), F.col("to.node").alias("child"),
        F.when(ends, F.col("word")).alias("word"), F.when(ends, F.col("n")).alias("n"), F.struct(F.coalesce("to.starts", F.lit(0)).alias("starts"), "to.rests").alias("below"),
    )
    # words that share an edge agree in all but its end, where one word alone can end
    edges = edges.groupBy("node", "child").agg(F.min("label").alias("label"), F.min("word").alias("word"), F.min("n").alias("n"), F.min("below").alias("below"))
    return edges.groupBy("node").agg(F.collect_list(F.struct("label", "child", "word", "n", "below.starts", "below.rests")).alias("edges"))


def _begin(words: DataFrame) -> DataFrame:
    """The first frontier ``word, n, text, pos, node, edits``: each word below its first half, in both tries."""
    sides = []
    for side, text in (("f", F.col("word")), ("r", F.reverse("word"))):
        pos = _search_begin(side, F.length("text"))
        rows = words.select("word", "n", text.alias("text")).withColumn("pos", pos)
        sides.append(rows.withColumn("node", _name(F.lit(side), _left("text", F.col("pos")))).withColumn("edits", F.lit(0)))
    return reduce(DataFrame.unionByName, sides)


def _rest(n=None) -> Column:
    """Code points of the word from its position on, the first ``n`` of them."""
    return F.substr("text", F.col("pos") + 1, F.length("text") if n is None else n)


def _plain(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """States without an edit over all edges of their node: as the label is, or with one edit that puts a greater code point in, for one of the word's or beside them."""
    on = frontier.where("edits = 0").join(nodes.hint("shuffle_hash"), "node").select("word", "n", "text", "pos", F.inline("edges").alias("label", "child", "near", "near_n", "starts", "rests"))
    # no length that may follow fits any edit, nor the word as it is: most edges end here, without a look at the text
    shift = "length(text) - pos - length(label)"
    on = on.where(F.expr(f"CASE WHEN {shift} < 0 THEN {shift} = -1 AND rests & 1 = 1 ELSE shiftright(rests, least({LONG_REST}, {shift})) & 3 <> 0 END"))
    size = F.length("label")
    tail = F.substr("label", F.lit(2))
    aligned = _rest(F.lit(1)) == _left("label", F.lit(1))

    def edited(k: str, at_begin: Column) -> Column:
        """One edit apart; where the first code points differ, the edit can but be there.  What tells most cheaply comes first."""
        return _fits(k) & F.when(aligned, F.levenshtein(_rest(F.expr(k)), "label", 1) == 1).otherwise(at_begin)

    after_first = lambda n: F.substr("text", F.col("pos") + 2, n)
    moves = (
        (size, 0, aligned & (_rest(size) == F.col("label"))), (size, 1, (F.col("label") > _rest(size)) & edited("length(label)", after_first(size - 1) == tail)),
        (size - 1, 1, edited("length(label) - 1", _rest(size - 1) == tail)),
    )
    moves = F.array_compact(F.array(*(F.when(ok, F.struct(k.alias("k"), F.lit(more).alias("more"))) for k, more, ok in moves)))
    return on.select("word", "n", "text", "pos", F.col("child").alias("node"), "near", "near_n", "starts", "rests", F.inline(moves).alias("k", "edits"))


def _edited(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """States whose edit is made over the one edge that begins with the word's next code point."""
    own = frontier.where("edits = 1").withColumnRenamed("node", "from").withColumn("first", _rest(F.lit(1)))
    on = own.join(edges.select(F.col("node").alias("from"), "first", "label", F.col("child").alias("node"), F.col("word").alias("near"), F.col("n").alias("near_n"), "starts", "rests").hint("shuffle_hash"), ["from", "first"])
    size = F.length("label")
    return on.where(_fits("length(label)") & (_rest(size) == F.col("label"))).select("word", "n", "text", "pos", "node", "near", "near_n", "starts", "rests", size.alias("k"), "edits")


def _advance(frontier: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All states one edge further.

    Once the edit is made the rest must follow as it is: its length and its next
    code point tell at once where it can't.
    """
    moved = _plain(frontier, nodes).unionByName(_edited(frontier, edges))
    return moved.select("word", "n", "text", (F.col("pos") + F.col("k")).alias("pos"), "node", "edits", "near", "near_n")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: every pair of different ``words`` (``word, n``) one inserted, deleted or replaced code point apart, in both directions."""
    pairs = one_way(words)
    return pairs.select("word", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def one_way(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every pair of ``neighbours`` in one direction, to the longer word or the one of the greater code point.

    Rounds end when no state is left: after as many as the most nodes below the
    half of any word, not its length.  Pairs may come back more than once.
    """
    spark = words.sparkSession
    with scratch_scope(spark):
        nodes = materialize(trie(words), "trie")
        edges = materialize(nodes.select("node", F.inline("edges")).withColumn("first", _left("label", F.lit(1))), "edges")
        frontier = _begin(words)
        found = []
        while True:
            moved = materialize(_advance(frontier, nodes, edges), "frontier")
            done = (F.col("pos") == F.length("text")) & (F.col("edits") == 1) & F.col("near").isNotNull()
            found.append(moved.where(done).select("word", "n", "near", "near_n"))
            # an edit more may still be due at the end of the word, a plain state there is the word itself
            frontier = moved.where((F.col("pos") < F.length("text")) | (F.col("edits") == 0)).drop("near", "near_n")
            if frontier.isEmpty():
                break
        return result(reduce(DataFrame.unionByName, found).where("near <> word"), "neighbours")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last word of each chain of forms, by doubling the steps."""
    spark = forms.sparkSession
    with scratch_scope(spark):
        now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
        while True:
            ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
            step = materialize(now.join(_growing(ahead), "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
            now = step.select("word", "root")
            if step.where("moved").isEmpty():
                break
        return result(now, "word-roots")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (``word, n``; one row a word).

    Near words differ by exactly one code point inserted, deleted or replaced.  The
    form is the near word of largest ``n`` (ties: smallest in code-point order) if
    that is at least ``ratio`` times the word's; the root is where following the
    forms ends, the word itself without one.  The empty word has no neighbours; null
    words are left out; an empty table gives an empty result.
    """
    words = materialize(words.where("word is not null").select("word", "n"), "words")
    # the most frequent neighbour, ties by code points: strings are ordered by UTF-8, which is that order
    pairs = neighbours(words.where("word <> ''")).distinct()
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    found = words.join(_growing(best), "word", "left").withColumn("form_n", -F.col("best.minus"))
    formed = F.col("form_n") >= ratio * F.col("n")
    found = found.select("word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n"))
    found = materialize(found, "forms")
    out = found.join(_growing(_roots(found.where("form is not null"))), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_deletions(runs: DataFrame, divisor: int = 97) -> DataFrame:
    """Runs without one code point where the crc32 of ``<doc_id>:<run>`` is divisible by ``divisor``; a null ``doc_id`` counts as no digits."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    rows = runs.select("run", F.crc32(key.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(_left("run", at), F.substr("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % divisor == 0, cut).otherwise(F.col("run")).alias("run"))


def word_counts(runs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the runs that are long and frequent enough."""
    counts = runs.where(F.length("run") >= min_chars).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spelling_variants`` of the words of the whole of ``documents``, some of which lost a code point."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_variants(word_counts(with_deletions(letter_runs(docs))))
