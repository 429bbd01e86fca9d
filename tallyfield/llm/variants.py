"""Spelling variants of a corpus: words that one inserted, deleted or replaced character tells apart.

Words are counted over all documents. Their neighbours come from a trie that is a table of edges: an edge leads from a node, a
prefix of words, to the next node at which words part or end, and its label is the characters between. A search is a table of
states (word, position, node, edits) that is joined with the edges level by level. A state goes on where a label
agrees with the word, or agrees but for one replaced or inserted character while it has no edit yet; a state with one edit
that ends with its word at a node that is a word is a neighbour. States whose next character no edge takes are dropped at once.

One edit leaves one half of a word as it is. So a word starts at the node of its exact half and never fans out near the root,
once in a trie of the words and once in a trie of the words read backwards. A deletion is the other word's insertion, and a
replacement is followed from the larger character only; both directions are put together at the end.

Edges and states are shuffled by node. A node with many words below it has its edges copied, once for each ``SALT_WORDS``
words, and its states are spread over the copies. Fan-out is bounded by the alphabet. Each level is stored in the shared folder; the
number of levels is that of the partings on the longest way.

A word's form is its neighbour of largest count, if that is at least ``TIMES`` its own. Counts rise along a chain of forms, so a
root is found by doubling the steps, in a number of joins that grows with the logarithm of the chain.

Defined results: a null text has no words, an empty one neither; a null ``doc_id`` counts as an empty text where it enters a checksum.
Repeated rows count as often as they stand there. Ties between forms of one count go to the smaller word in code-point order.
Very long runs are words like others: nodes deeper than ``KEY_CHARS`` are known by a digest of their prefix. An empty table, or one
without a frequent word, gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import lower_ascii, query, table, text_or_empty
from tallyfield.session import materialise

#: Least length and count of a word, how many times as frequent a form must be, which runs are damaged.
LEAST_CHARS, LEAST_COUNT, TIMES, DAMAGE_STEP = 6, 5, 5, 199
#: Depth at which the tries begin; characters of a node's prefix beyond which it is known by a digest; words a copy of an edge.
START, KEY_CHARS, SALT_WORDS = LEAST_CHARS // 2, 40, 100_000


# --- words ----------------------------------------------------------------------------------------------


def runs_of(docs: DataFrame) -> DataFrame:
    """doc_id and run (A-Z in lower case) of every maximal run of letters with ``LEAST_CHARS`` at least."""
    pattern = F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_CHARS)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_or_empty("text"), pattern, F.lit(0))).alias("run"))
    plain = F.lower("run") == F.col("run")  # most runs have nothing to translate
    return runs.select("doc_id", F.when(plain, F.col("run")).otherwise(lower_ascii(F.col("run"))).alias("run"))


def damaged(run: Column, doc_id: Column) -> Column:
    """The run; without one character where the step divides the checksum of id and run."""
    checksum = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (checksum % F.char_length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.char_length(run)))
    return F.when(checksum % DAMAGE_STEP == 0, without).otherwise(run)


def frequent(runs: DataFrame) -> DataFrame:
    """word and n of the words in column ``word`` that are long and frequent enough."""
    counted = runs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.char_length("word") >= LEAST_CHARS) & (F.col("n") >= LEAST_COUNT))


# --- trie -----------------------------------------------------------------------------------------------


def _node(word: Column, depth: Column) -> Column:
    """Key of the node a word passes at a depth: its prefix, or a mark (no letter) and the prefix's digest."""
    prefix = F.substring(word, F.lit(1), depth)
    return F.when(depth <= KEY_CHARS, prefix).otherwise(F.concat(F.lit("#"), F.sha2(prefix.cast("binary"), 256)))


def trie(words: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Edges of the trie of ``words(word, exact)``, and the node each word starts at, at most ``exact`` characters deep.

    Edges: node, salt, label, child, salts (copies of the child's edges), next (first characters of the child's labels), ends (the word
    that ends at the child). Starts: word, pos, node, salts.
    """
    depth = F.explode(F.sequence(F.lit(START), F.char_length("word")))
    passed = words.select("word", "exact", depth.alias("depth")).select("word", "exact", "depth", _node(F.col("word"), F.col("depth")).alias("node"))
    ends = F.col("depth") == F.char_length("word")
    after = F.when(~ends, F.substring("word", F.col("depth") + 1, F.lit(1)))
    nodes = passed.groupBy("node").agg(
        F.collect_set(after).alias("next"),  # bounded by the alphabet
        F.max(F.when(ends, F.col("word"))).alias("ends"),
        F.count(F.lit(1)).alias("below"),
        F.first("depth").alias("depth"),
    )
    parting = (F.size("next") > 1) | F.col("ends").isNotNull() | (F.col("depth") == START)
    salts = F.ceil(F.col("below") / SALT_WORDS).cast("int")
    nodes = nodes.filter(parting).select("node", F.array_join("next", "").alias("next"), "ends", salts.alias("salts"))
    step = F.struct("depth", "node", "salts", "next", "ends")
    ways = passed.join(nodes, "node").groupBy("word").agg(F.first("exact").alias("exact"), F.sort_array(F.collect_list(step)).alias("way"))
    ways = materialise(ways, f"{label}-ways")
    start = F.element_at(F.filter("way", lambda s: s["depth"] <= F.col("exact")), -1)
    starts = ways.select("word", start.alias("s")).select("word", F.col("s.depth").alias("pos"), "s.node", "s.salts")
    to = F.slice("way", F.lit(2), F.size("way"))
    pairs = ways.select("word", F.explode(F.arrays_zip(to.alias("to"), F.slice("way", F.lit(1), F.size("way") - 1).alias("since"))).alias("e"))
    between = F.substring("word", F.col("e.since.depth") + 1, F.col("e.to.depth") - F.col("e.since.depth"))
    edges = pairs.select(
        "e.since.node", F.col("e.since.salts").alias("copies"), between.alias("label"), F.col("e.to.node").alias("child"), "e.to.salts", "e.to.next", "e.to.ends"
    ).dropDuplicates(["child"])
    copied = edges.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")).drop("copies")
    return materialise(copied, f"{label}-edges"), starts


# --- frontier -------------------------------------------------------------------------------------------


def _moves() -> Column:
    """(pos, edits) of the states that an edge leads a state to."""
    size, rest = F.char_length("label"), F.char_length("word") - F.col("pos")
    piece = lambda n: F.substring("word", F.col("pos") + 1, n)
    to = lambda n, edits: F.struct((F.col("pos") + n).cast("int").alias("pos"), F.lit(edits).alias("edits"))
    agrees = (rest >= size) & (piece(size) == F.col("label"))
    free = F.col("edits") == 0
    one_off = lambda n: F.levenshtein(piece(n), "label", 1) == 1
    replaced = free & (rest >= size) & (F.col("label") < piece(size)) & one_off(size)
    inserted = free & (rest >= size - 1) & one_off(size - 1)
    same = F.when(agrees, F.struct((F.col("pos") + size).cast("int").alias("pos"), F.col("edits")))
    return F.array_compact(F.array(same, F.when(replaced, to(size, 1)), F.when(inserted, to(size - 1, 1))))


def near_pairs(words: DataFrame, label: str) -> DataFrame:
    """(word, near): for each word those that one inserted or replaced character leads to, behind its exact part."""
    edges, starts = trie(words, label)
    salt = F.pmod(F.xxhash64("word"), F.col("salts").cast("long")).cast("int")
    frontier = starts.withColumn("edits", F.lit(0))
    found: list[DataFrame] = []
    while True:
        met = frontier.withColumn("salt", salt).drop("salts").join(edges, ["node", "salt"])
        moved = met.select("word", "child", "salts", "next", "ends", F.inline(_moves()))
        over = F.col("pos") == F.char_length("word")
        arrived = over & (F.col("edits") == 1) & F.col("ends").isNotNull()
        goes_on = F.when(F.col("edits") == 0, F.col("next") != "").otherwise(
            ~over & F.contains("next", F.substring("word", F.col("pos") + 1, F.lit(1)))
        )
        kept = moved.select("word", "pos", F.col("child").alias("node"), "salts", "edits", F.when(arrived, F.col("ends")).alias("near"), goes_on.alias("goes_on"))
        level = materialise(kept.filter("near IS NOT NULL OR goes_on"), f"{label}-level")
        found.append(level.filter("near IS NOT NULL").select("word", "near"))
        frontier = level.filter("goes_on").select("word", "pos", "node", "salts", "edits")
        if frontier.isEmpty():
            return reduce(DataFrame.unionAll, found)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near) for all ordered pairs of ``words(word)`` that differ by exactly one character."""
    half = F.floor(F.char_length("word") / 2).cast("int")
    ahead = near_pairs(words.select("word", half.alias("exact")), "trie")
    backward = words.select(F.reverse("word").alias("word"), (F.char_length("word") - half).alias("exact"))
    behind = near_pairs(backward, "backward-trie").select(F.reverse("word").alias("word"), F.reverse("near").alias("near"))
    one_way = ahead.unionAll(behind)
    return one_way.unionAll(one_way.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


# --- forms ----------------------------------------------------------------------------------------------


def with_forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``words(word, n)`` with n_near, form and form_n."""
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best")
    near = pairs.join(counts, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left")
    chosen = -F.col("best.down") >= TIMES * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.down")).alias("form_n"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word of ``forms(word, form)`` that has a form: the end of its chain, by doubling steps."""
    steps = materialise(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = materialise(steps.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "variant-roots")
        if joined.filter("moved").isEmpty():
            return joined.select("word", "root")
        steps = joined.select("word", "root")


def group(words: DataFrame) -> DataFrame:
    """word, n, form, root, n_near and form_n of stored ``words(word, n)``, each word one row."""
    forms = materialise(with_forms(words, neighbours(words.select("word"))), "variant-forms")
    ends = roots(forms)
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i))
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), checked AS (
  SELECT run, count(*) AS n, id FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY run, id
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT]
    ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS b FROM checked
), summed AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc_table
), damaged AS (
  SELECT CASE WHEN h % {DAMAGE_STEP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), one_way AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS rank FROM one_way p JOIN words w ON p.near = w.word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form,
    CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND rank = 1
), chain AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (SELECT word, max_by(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN ends USING (word)
"""


@query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    runs = runs_of(table(spark, folder, "documents").select("doc_id", "text"))
    words = frequent(runs.select(damaged(F.col("run"), F.col("doc_id")).alias("word")))
    return group(materialise(words, "variant-words"))
