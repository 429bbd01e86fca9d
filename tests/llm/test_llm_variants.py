"""Spelling variants against a plain version that compares all words with their one-edit strings."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tallyfield.llm import variants

SCHEMA = "doc_id long, text string"
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    forms, out = {}, []
    neighbours = {w: [v for d in (-1, 0, 1) for v in by_length.get(len(w) + d, []) if near(w, v)] for w in words}
    for w, found in neighbours.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for w, form in forms.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, form, root, words[w], len(neighbours[w]), words[form] if form else None))
    return sorted(out)


def grouped(spark, words):
    rows = variants.group(spark.createDataFrame(sorted(words.items()), "word string, n long")).collect()
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows)


def test_given_documents(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    words = plain_words(docs)
    rows = variants.op13_spelling_variants(spark, folder).collect()
    got = sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows)
    assert any(r[1] for r in got) and got == plain(words)


def test_dense_words_of_few_letters(spark):
    """Nearly every word has neighbours by each kind of edit, at each place, also among repeated letters."""
    rng = random.Random(7)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))): rng.choice([5, 6, 30, 31, 200, 5000]) for _ in range(700)}
    assert grouped(spark, words) == plain(words)


def test_chains_ties_and_prefixes_of_each_other(spark):
    words = {"aaaaaa" + "a" * k: 5 * 6**k for k in range(6)} | {"colour": 5, "colouz": 50, "coloux": 50, "color": 5, "colours": 49}
    words = {w: n for w, n in words.items() if len(w) >= 6}
    got = {r[0]: r for r in grouped(spark, words)}
    assert list(got.values()) == plain(words)
    assert got["aaaaaa"][2] == "a" * 11 and got["colour"][1] == "coloux" and got["colour"][4] == 3


def test_long_words_and_hot_nodes(spark, monkeypatch):
    """Words longer than a readable key, and nodes whose edges are copied."""
    monkeypatch.setattr(variants, "SALT_WORDS", 3)
    rng = random.Random(9)
    stem = "".join(rng.choice("abcdef") for _ in range(300))
    words = {stem + "".join(rng.choice("xyz") for _ in range(3)): rng.choice([5, 40]) for _ in range(60)}
    words |= {stem: 1000, stem[1:]: 6, "q" + stem: 7, stem[:150] + "ÿ" + stem[151:]: 8, stem[:60]: 9, stem[:59]: 90}
    assert grouped(spark, words) == plain(words)


def test_counting_words(spark):
    docs = [(i, "Straße ÀÉÎÕÜß×÷ short Variant variant\nvariant-VARIANT x" + "y" * 40) for i in range(150)]
    docs += [(None, "Nullidword " * 6), (7, None), (8, ""), (9, "variant " * 3000), (9, "variant " * 3000)]
    runs = variants.runs_of(spark.createDataFrame(docs, SCHEMA))
    found = variants.frequent(runs.select(variants.damaged(F.col("run"), F.col("doc_id")).alias("word"))).collect()
    assert {r.word: r.n for r in found} == plain_words(docs)


def test_empty_tables(spark):
    assert variants.group(spark.createDataFrame([], "word string, n long")).count() == 0
    assert grouped(spark, {"lonely": 5}) == [("lonely", None, "lonely", 5, 0, None)]
    runs = variants.runs_of(spark.createDataFrame([], SCHEMA).withColumn("run", F.lit("clash")))
    assert runs.count() == 0
