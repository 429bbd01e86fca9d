"""Pieces, pages, toxicity, licences, chats, mixing and search against plain versions and hard cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyfield.llm import chat, extraction, licenses, mixing, pieces, search, toxicity

HARD = ["", "a", " ", "   ", "  Hello  wörld\n\tx 中文  ", "a" * 50, "\n\n", "x\0y", "🙂🙂 ñ", "é" * 3000, "ab" * 2000]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.read()


def test_pieces_are_those_of_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rng = random.Random(3)
    letters = "abcdefghABC  ▁▁.,\n\t中文字é🙂ñ012<>[]{}()=thing the 한국어"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    ids = model.encode(texts)
    assert [i.tolist() for i in ids] == library.encode(texts)
    assert [model.decode(i) for i in ids] == [library.decode(i.tolist()) for i in ids]
    assert [model.decode(i) for i in ids] == [t.replace("▁", " ") for t in texts]
    assert model.encode([None]) == [None] and model.decode(None) is None


def message(*fields):
    """Protocol-buffer message of (number, bytes | float | int)."""
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            size, octets = len(value), b""
            while size > 127:
                octets, size = octets + bytes([size & 127 | 128]), size >> 7
            out += bytes([number << 3 | 2]) + octets + bytes([size]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            out += bytes([number << 3, value])
    return out


def test_unigram_search_finds_the_best_sum():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 3))) for _ in range(40)} - {"▁"})
    words = [w for w in words if "▁" not in w[1:]] + ["▁", "a"]
    scores = {w: -float(rng.randint(1, 400)) / 7 for w in words}
    listed = [("<unk>", 0.0, 2)] + [(w, scores[w], 1) for w in scores]
    data = b"".join(message((1, message((1, w.encode()), (2, s), (3, k)))) for w, s, k in listed)
    data += message((2, message((3, 1))), (3, message((3, 1), (4, 0), (5, 1))))
    model = pieces.PieceModel(data)
    assert model.kind == pieces.UNIGRAM
    lowest = min(scores.values()) - pieces.UNKNOWN_COST

    def best(text):
        text, value = "▁" + text.replace(" ", "▁"), [0.0]
        for end in range(1, len(text) + 1):
            ways = [value[end - 1] + lowest] if text[end - 1] not in scores else []
            ways += [value[s] + scores[text[s:end]] for s in range(end) if text[s:end] in scores]
            value.append(max(ways))
        return value[-1]

    for _ in range(300):
        text = "".join(rng.choice("aab b") for _ in range(rng.randint(1, 30)))
        names = [model.pieces[i] for i in model.encode([text])[0]]
        if "<unk>" not in names:
            assert "".join(names) == "▁" + text.replace(" ", "▁")
            assert sum(scores[w] for w in names) == pytest.approx(best(text), abs=1e-3)
    assert model.decode(model.encode(["a zz a"])[0]) == "a" + " " + pieces.UNKNOWN_SURFACE + " a"


def test_encoded_keeps_rows_and_columns(spark, model):
    texts = [*HARD, None, "same", "same"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece_ids string")
    out = pieces.encoded(docs, model)
    assert out.columns == ["doc_id", "text", "piece_ids", "_piece_ids", "decoded"]
    for r in out.collect():
        assert r.decoded == texts[r.doc_id] == r.text and r.piece_ids == "x"
    trips = pieces.round_trips(docs, model).collect()
    assert all(r.same for r in trips) and pieces.encoded(docs.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article class=entry><header><h1>The title &amp; more</h1></header><p><b>First  part<br>goes on &lt;b&gt;.<p>a < b &nbsp; c
<form><p>Your mail</p></form><div id="ad-slot"><p>Buy now</div><script>var t="</p><p>no";</script><!-- <p>no</p> -->
<ul><li>One point</li><li>Another</ul><div class="related-posts"><p>More</div><section id="comments"><p>Nice post!</section>
</article><aside><p>Side</p></aside><footer>(c) x</footer></body>"""


def test_page_text():
    assert extraction.main_text(PAGE) == "The title & more\nFirst part goes on <b>.\na < b c\nOne point\nAnother"
    for odd in (None, "", "<", "<p", "<script>x", "<!-- x", "</div></p>", "<div class='ad'>x<p>y", "<a href='"):
        assert extraction.main_text(odd) == ""
    long = "The cat and the dog were in the house of the man and it was a good day. "
    page = f"<div class=menu><a>Home</a></div><div><h2>Heading</h2><p>{long * 4}<p>Short one.<p>{long * 4}</div><p>Imprint text"
    assert extraction.main_text(page) == "\n".join(["Heading", (long * 4).strip(), "Short one.", (long * 4).strip()])
    assert extraction.main_text("<main><p>Hello<br>there<br><br>x &amp;amp; y</main><p>out") == "Hello there\nx &amp; y"
    assert len(extraction.main_text(f"<article><p>{'word ' * 200_000}</article>")) == 999_999


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    rows = extraction.extract(pages).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(1, len(extraction.main_text(PAGE))), (2, 0), (2, 0)]
    assert extraction.extract(pages.limit(0)).count() == 0


def made_texts(rng, toxic, n):
    stems = ["florb", "grunk", "zwamp"]
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(stems) + "".join(rng.choice("aeiou") for _ in range(3))
        yield " ".join(text)


def test_toxicity_learns_from_parts_of_words(spark):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate([*made_texts(rng, True, 120), *made_texts(rng, False, 300)])]
    rows += [(1000, None), (1001, ""), (1002, "... !!"), (1003, "lu " * 50_000), (None, "nice words"), (1003, "lu " * 50_000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = [(i, 1, int(i < 120)) for i in range(420)] + [(7777, 1, 1), (5, 1, None), (None, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    hidden = [i for i in range(420) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(scores[i] >= 0.5) == (i < 120) for i in hidden])
    assert right > 0.95
    assert all(scores[i] < 0.5 for i in (1000, 1001, 1002, 1003)) and scores[1000] == 0
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if scores[r.doc_id] < 0.5)
    nothing = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.score(docs, nothing).filter("score > 0").count() == 0
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0


def test_held_out_rows_are_not_learnt(spark):
    ids = list(range(200))
    hidden = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in hidden] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def test_license_scan_units(spark):
    grant, warranty = (t for name, t in licenses.TEMPLATES if name == "MIT" and len(t) > 100)
    texts = ["Prose here\nReleased under the MIT license!\nmore", grant.replace(" any", "\nany") + "\n\n" + warranty, None, "", "one", "Licensed under CC BY 4.0"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, unit string")
    found = sorted((r.doc_id, r.unit, r.place, r.license) for r in licenses.scan(docs).collect())
    assert found == [(0, "line", 1, "MIT"), (1, "block", 0, "MIT"), (1, "line", 1, "MIT"), (1, "line", 3, "MIT"), (5, "line", 0, "CC-BY-4.0")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok <| <|| <"
    rows = [(1, 0, "user", odd), (1, 1, "user", None), (1, 2, "assistant", odd), (1, 3, "assistant", ""), (1, 3, "assistant", ""), (1, 4, "a\n<|b", "x\n"), (2, None, None, "t"), (None, 1, "assistant", "n")]
    turns = spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = {r.conv_id: r for r in chat.format_chats(turns).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("learnt")).collect()}
    for conv in (1, 2, None):
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in out[conv].back] == mine
        assert out[conv].learnt == "".join(t for r, t in mine if r == "assistant")
        assert out[conv].formatted == "".join(s.text for s in out[conv].segments)
    assert out[1].formatted.count("<|im_start|>") == 3
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "c", "Z", None]), 1, 2) for i in range(3000)]
    rows += [(5000, None, "null-only", 1, 2), (5001, "x y", "tiny", 1, 2), (5001, "x y", "tiny", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target long")
    size = {}
    for _, t, s, *_ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(size)
    while True:  # share, stop the overfull, share the rest anew
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in full}
        open_ -= full
    drawn, names = mixing.with_copies(docs, mixing.word_count())
    found = drawn.collect()
    for r in found:
        assert r[names["target"]] == pytest.approx(target[r.source]) and r[names["copies"]] <= 3
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    for s in ("a", "b", "c", "Z", None):
        assert taken.get(s, 0) == pytest.approx(target[s], abs=41)  # one document of the largest size
    assert mixed.count() == sum(r[names["copies"]] for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_few_very_uneven_documents_come_near_the_target(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(10 ** rng.uniform(0, 3))), f"s{i % 7}") for i in range(350)]
    rows += [(None, "w " * 50, "s1"), (None, "w " * 70, "s1"), (400, "w " * 20000, "s2"), (401, "", "s3"), (402, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn, names = mixing.with_copies(docs, mixing.word_count(), seed=seed)
    largest, taken, target = {}, {}, {}
    for r in drawn.collect():
        size, number = r[names["size"]], r[names["copies"]]
        largest[r.source] = max(largest.get(r.source, 0), size)
        taken[r.source] = taken.get(r.source, 0) + size * number
        target[r.source] = r[names["target"]]
        assert 0 <= number <= 3
    for s in taken:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_draws_keep_their_probability(spark):
    """Over many seeds every document is taken as often as its source's rate says."""
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(12)]
    each = spark.createDataFrame([(s, i, len(t.split())) for i, t, s in rows], "source string, doc_id long, size long")
    targets = spark.createDataFrame([("a", 16, 20.0), ("b", 16, 12.0)], "source string, source_size long, target double")
    counts = {}
    for seed in range(24):
        for r in mixing.extra_copies(each, targets, seed=seed).collect():
            counts[r.source] = counts.get(r.source, 0) + 1
    assert counts["a"] / (24 * 6) == pytest.approx(0.25, abs=0.1) and counts["b"] / (24 * 6) == pytest.approx(0.75, abs=0.1)


@pytest.mark.parametrize("scale", [1.0, 1e8])
def test_search_is_exact(spark, scale):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (600, 6)) * scale
    x[100:140] = x[3]
    rows = [(i, [float(v) for v in r], 1.0) for i, r in enumerate(x)]
    rows += [(1000, None, 1.0), (1001, [None] * 6, 1.0), (1002, [float("nan")] * 6, 1.0), (1003, [1.0] * 5, 1.0), (None, [1.0] * 6, 1.0), (7, rows[7][1], 1.0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    found = {}
    for r in search.top_k(vectors, F.col("vec_id") % 50 == 0, scale=4).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [[int(v) for v in np.floor(4 * r)] for r in x]
    for q in range(0, 600, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in range(600) if i != q)[:5]
        expected = [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
        assert sorted(found[q]) == expected
    assert search.top_k(vectors.limit(0), F.lit(True)).count() == 0


def test_search_skips_most_candidates():
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 300, (20, 16))
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 10, (4000, 16)))
    pivots = search.choose_pivots(x[:500])
    *_, evaluated = search.best_of_cell(np.arange(40), x[:40], np.arange(4000), x, pivots)
    assert evaluated < 0.5 * 40 * 4000
    assert hashlib.sha256(pivots.tobytes()).hexdigest() == hashlib.sha256(search.choose_pivots(x[:500]).tobytes()).hexdigest()
