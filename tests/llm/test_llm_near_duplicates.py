"""SimHash groups and line groups against plain all-pairs versions; fingerprints against true likeness."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tallyfield.llm import components, lines, simhash, sketches

DOCS = "doc_id long, text string, fp string, place long, lost_lines string, kind int"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def with_clashes(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "x", 7, "y", 1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    made = [None, "", "  \t\n ", "one", "one", "ONE", "two words", "É é"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        made.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            made.append(" ".join(copy))
    made.append(" ".join(rng.choice(words) for _ in range(60_000)))
    return made


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, texts):
    fps = [plain_fingerprint(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    expected = groups(len(texts), links)
    for cell_rows in (simhash.CELL_ROWS, 4):  # small cells cut every anchor into a grid
        found = simhash.near_duplicates(with_clashes(spark, texts), cell_rows=cell_rows).collect()
        assert {r.doc_id: r.fp % 2**64 for r in found} == dict(enumerate(fps))
        assert {r.doc_id: r.component_id for r in found} == dict(enumerate(expected))
    assert len(set(expected)) < len(texts) - 20


def test_simhash_keeps_one_of_each_group(spark, texts):
    docs = with_clashes(spark, texts)
    kept = simhash.keep_one(docs.unionAll(docs.filter("doc_id IN (3, 9)")))
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    fps = [plain_fingerprint(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert ids == sorted(set(groups(len(texts), links)))


def test_simhash_null_ids_and_empty_table(spark):
    rows = [(None, "some text here"), (None, "some text here"), (4, "some text here"), (None, "lonely words stand here")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.component_id) for r in found) == ["4", "4", "4", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_every_close_pair_meets_at_a_home():
    rng = np.random.default_rng(3)
    code = simhash.Covering()
    a = rng.integers(-(2**63), 2**63, 500, dtype=np.int64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 3, replace=False):
            b[i] ^= np.array([1 << int(bit)], np.uint64).view(np.int64)[0]
    home = code.home(a)
    met = np.zeros(len(a), bool)
    for at, anchor, _ in code.reach(b):
        met[at[anchor == home[at]]] = True
    assert met.all()


def test_components_of_long_chains_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(100, i) for i in range(200, 500)]
    loop = [(600, 601), (601, 602), (602, 600), (600, 600)]
    edges = spark.createDataFrame(chain + hub + loop, "u long, v long")
    roots = {r.node: r.root for r in components.connected_components(edges).collect()}
    expected = {i: 0 for i in range(61)} | {i: 100 for i in [100, *range(200, 500)]} | {i: 600 for i in (600, 601, 602)}
    assert roots == expected
    nodes, local = components.local_roots(np.array([5, 3, 9, 20]), np.array([4, 4, 3, 21]))
    assert dict(zip(nodes.tolist(), local.tolist(), strict=True)) == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20}


def shingles(line):
    """Runs of eight characters from every character on; a blank line has none."""
    line = lower(line)
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))} if line.strip(" \t\x0b\x0c\r") else set()


def plain_line_dedup(docs):
    """Texts without lost lines; docs: (id, text), ids different."""
    places = [(i, p, line) for i, t in sorted(docs) for p, line in enumerate((t or "").split("\n")) if shingles(line)]
    sets = [shingles(x[2]) for x in places]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    pairs = [(a, b) for a, b in combinations(range(len(places)), 2) if like(sets[a], sets[b])]
    root = groups(len(places), pairs)
    lost = {places[k][:2] for k in range(len(places)) if root[k] != k}
    return {i: t and "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in lost) for i, t in docs}


def test_line_dedup(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("klmnoprst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    passages = [[rng.choice(words) for _ in range(60)] for _ in range(6)]
    docs = [(0, None), (1, ""), (2, "\n \n"), (3, "Same line\nSame line\n\nother"), (4, "same LINE"), (5, "x")]
    for i in range(6, 60):
        made = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(passages)) if rng.random() < 0.6 else [rng.choice(words) for _ in range(30)]
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice(words)
            made.append(" ".join(line))
        docs.append((i, "\n".join(made)))
    docs.append((60, "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(3000))))
    given = with_clashes(spark, [t for _, t in docs])
    clean, lost = lines.dedup_lines(given)
    assert clean.columns == [*given.columns, lost]
    assert {r.doc_id: r.text for r in clean.collect()} == plain_line_dedup(docs)


def test_line_dedup_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a line of words\nb"), (1, "a line of words\nb"), (None, "a line of words\nc"), (None, None)]
    clean, _ = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(r.text) for r in clean.collect()) == ["None", "a line of words\nb", "a line of words\nb", "c"]
    empty, _ = lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def test_fingerprints_estimate_likeness():
    rng = random.Random(2)
    maker = sketches.Sketcher()
    base = [f"w{rng.randrange(5000)}" for _ in range(600)]
    wanted, found = [], []
    for share in (0, 0.02, 0.1, 0.3, 1):
        other = [w if rng.random() > share else f"v{rng.randrange(5000)}" for w in base]
        a, b = ({tuple(x[i : i + 5]) for i in range(596)} for x in (base, other))
        wanted.append(len(a & b) / len(a | b))
        found.append(maker.likeness(maker.sketch(" ".join(base)), maker.sketch(" ".join(other))))
    assert np.abs(np.array(wanted) - found).max() < 0.1
    assert maker.likeness(b"", b"") == 1 and maker.likeness(maker.sketch("a"), b"") == 0
    assert maker.likeness(maker.sketch("one word"), maker.sketch("other word")) < 0.1
    assert maker.sketch("Some TEXT") == maker.sketch("some text") and len(maker.sketch("x")) == 256


def test_fingerprints_in_order_of_ids(spark):
    texts = [None, "", "a b c d e f g", "é" * 10, "a b c d e f g", "x " * 4000, "tail"] + [f"text number {i} of many" for i in range(60)]
    docs = with_clashes(spark, texts).repartition(7)
    found = {r.doc_id: r for r in sketches.compared_with_next(docs).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        text, following = text or "", texts[i - 1] or ""  # descending ids, the largest follows the smallest
        third = len(text) // 3
        new = text[: len(text) - third] + following[:third]
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        maker = sketches.Sketcher()
        assert found[i].fingerprint == maker.sketch(text).hex() and found[i].edited_fingerprint == maker.sketch(new).hex()
        assert found[i].near_next == maker.likeness(maker.sketch(text), maker.sketch(following))
    one = sketches.compared_with_next(spark.createDataFrame([(5, "abc")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert sketches.compared_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sketches.sketches(docs).count() == len(texts)
