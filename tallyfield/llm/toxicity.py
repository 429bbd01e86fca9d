"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is wrapped in angle brackets and cut into character n-grams; each n-gram and the word itself hash to a row of
one embedding table, so a misspelling never seen in training still shares most of its vectors. The vectors of a window
of a few words are averaged and go through a linear softmax over (clean, toxic). A document is toxic if any of its
windows is: training combines the windows as independent causes (one minus the product of their clean
probabilities), scoring takes the most toxic window. So a long clean text gathers no suspicion, and one insult is not
averaged away. Whole texts are scored.

The model is fitted on the driver on a bounded sample, drawn by hash: at most ``PER_CLASS`` labelled documents of each
class and ``WINDOWS_PER_DOCUMENT`` windows of each. It is a vector of 2^BUCKET_BITS numbers once fitted (embedding
times softmax weights), a fixed size to ship, and scoring is one pass without a shuffle.

Defined results: texts without words (null, empty, blank) score 0. Labels other than 0 and 1, and labels of unknown
documents, are left out; without labels of both classes every text scores 0. A null ``doc_id`` counts as held out.
Repeated rows score alike. An empty table gives an empty table; other columns pass through ``keep_clean``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import query, table, text_or_empty

#: Bounds of the training sample: documents of each class, windows of each document.
PER_CLASS, WINDOWS_PER_DOCUMENT = 1000, 256
#: Words of a window, lengths of n-grams, size and width of the embedding table.
WINDOW_WORDS, GRAMS, BUCKET_BITS, WIDTH = 4, (3, 4, 5), 17, 4
#: Training: passes, step, decay, log-odds of a window before training, seed.
PASSES, STEP, DECAY, START_LOG_ODDS, SEED = 40, 0.5, 2e-4, -7.0, 11
#: Words remembered by a task at most, and texts scored at once.
REMEMBERED_WORDS, TEXTS_AT_ONCE = 400_000, 256
#: Rows whose crc32 of the id leaves this remainder mod FOLDS are never learnt from.
FOLDS, HELD_OUT_FOLD = 5, 0
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»…“”‘’–—"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words, one word after the other, and how many each word has.

    A word's rows are its own and those of its n-grams; punctuation at its edges is left out, and pure punctuation has
    none. N-grams of all words are hashed together.
    """
    bare = [w.lower().strip(EDGES) for w in words]
    wrapped = [f"<{w}>" for w in bare]
    lengths = np.fromiter(map(len, wrapped), np.int64, len(wrapped))
    codes = np.frombuffer("".join(wrapped).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    down = np.uint64(64 - BUCKET_BITS)
    known = np.flatnonzero(lengths > 2)
    whole = np.array([zlib.crc32(bare[i].encode("utf-8", "surrogatepass")) for i in known], np.uint64)
    owners, rows = [known], [whole & np.uint64((1 << BUCKET_BITS) - 1)]
    with np.errstate(over="ignore"):
        for n in GRAMS:
            at = np.flatnonzero(np.arange(len(codes)) + n <= ends)
            value = np.full(len(at), n, np.uint64)
            for k in range(n):
                value = (value ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            owners.append(owner[at]), rows.append((value * np.uint64(0xBF58476D1CE4E5B9)) >> down)
    owner, row = np.concatenate(owners), np.concatenate(rows).astype(np.int64)
    return row[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def window_starts(n_words: int) -> np.ndarray:
    return np.arange(0, n_words, WINDOW_WORDS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Log-odds of a window: bias plus the mean of ``weight`` over its subwords."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the most toxic window of each text."""
        out = np.zeros(len(texts))
        for begin in range(0, len(texts), TEXTS_AT_ONCE):
            if not hasattr(self, "_places") or len(self._places) > REMEMBERED_WORDS:
                self._places: dict[str, int] = {}
                self._sums, self._numbers = np.empty(0), np.empty(0, np.int64)
            places = self._places
            split = [(t or "").split() for t in texts[begin : begin + TEXTS_AT_ONCE]]
            new = [w for words in split for w in words if w not in places and places.setdefault(w, len(places)) >= 0]
            if new:
                rows, numbers = subwords(new)
                owner = np.repeat(np.arange(len(new)), numbers)
                self._sums = np.concatenate([self._sums, np.bincount(owner, self.weight[rows], len(new))])
                self._numbers = np.concatenate([self._numbers, numbers])
            for k, words in enumerate(split, begin):
                if words:
                    at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                    starts = window_starts(len(words))
                    total, number = np.add.reduceat(self._sums[at], starts), np.add.reduceat(self._numbers[at], starts)
                    best = np.where(number > 0, self.bias + total / np.maximum(number, 1), -np.inf).max()
                    out[k] = _sigmoid(best) if np.isfinite(best) else 0.0
        return out


def fit_windows(documents: list[list[str]], toxic: list[int]) -> Model:
    """Fit on documents given as lists of windows, a window being a few words."""
    size = 1 << BUCKET_BITS
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size), -np.inf)
    places: dict[str, int] = {}
    bags = [[places.setdefault(w, len(places)) for w in window.split()] for windows in documents for window in windows]
    doc_of = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    words = np.concatenate([np.array(b, np.int64) for b in bags])
    word_begins = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    window_of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    rows, numbers = subwords(list(places))
    word_of = np.repeat(np.arange(len(places)), numbers)
    lengths = np.maximum(np.add.reduceat(numbers[words], word_begins), 1)
    used, rows = np.unique(rows, return_inverse=True)  # only rows that occur are trained

    rng = np.random.default_rng(SEED)
    table_ = rng.normal(0, 0.1, (len(used), WIDTH))
    softmax = rng.normal(0, 0.5, (WIDTH, 2))
    bias = np.array([0.0, START_LOG_ODDS])
    seen = [np.full(table_.shape, 1e-8), np.full(softmax.shape, 1e-8), np.full(2, 1e-8)]

    def move(value: np.ndarray, slope: np.ndarray, past: np.ndarray) -> None:  # Adagrad
        past += slope**2
        value -= STEP * slope / np.sqrt(past)

    for _ in range(PASSES):
        of_word = np.stack([np.bincount(word_of, table_[:, d][rows], len(places)) for d in range(WIDTH)], axis=1)
        bag = np.stack([np.add.reduceat(of_word[:, d][words], word_begins) for d in range(WIDTH)], axis=1) / lengths[:, None]
        z = bag @ softmax + bias
        p = _sigmoid(z[:, 1] - z[:, 0])
        # d(-log likelihood)/d(log-odds) is p in a clean document, and -p times the odds of clean in a toxic one
        clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(documents))
        odds = np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12)
        slope = np.where(y[doc_of] == 1, -p * odds[doc_of], p)
        both = np.stack([-slope, slope], axis=1) / len(y)
        to_bag = (both @ softmax.T) / lengths[:, None]
        to_word = [np.bincount(words, to_bag[:, d][window_of], len(places)) for d in range(WIDTH)]
        to_table = np.stack([np.bincount(rows, to_word[d][word_of], len(used)) for d in range(WIDTH)], axis=1)
        move(softmax, bag.T @ both + DECAY * softmax, seen[1])
        move(bias, both.sum(axis=0), seen[2])
        move(table_, to_table + DECAY * table_ / len(used), seen[0])
    weight = np.zeros(size)
    weight[used] = table_ @ (softmax[:, 1] - softmax[:, 0])
    return Model(weight, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    remainder = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS
    return F.coalesce(remainder == HELD_OUT_FOLD, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on a sample of the labelled ``docs(doc_id, text)``, held-out rows left out; ``labels(doc_id, toxic)``."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    present = usable.join(docs.select("doc_id"), "doc_id", "left_semi")
    by_hash = lambda y: present.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = by_hash(0).unionAll(by_hash(1)).withColumnRenamed("doc_id", "labelled_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                parts = [" ".join(words[s : s + WINDOW_WORDS]) for s in window_starts(len(words))]
                found.append(sorted(parts, key=lambda part: zlib.crc32(part.encode()))[:WINDOWS_PER_DOCUMENT])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["toxic", "windows"])

    kind = labels.schema["toxic"].dataType.simpleString()
    rows = texts.select("toxic", "text").mapInArrow(cut, f"toxic {kind}, windows array<string>").collect()
    rows = sorted((list(r.windows), int(r.toxic)) for r in rows)  # the same order in every run
    rows = [(windows, y) for windows, y in rows if windows]
    return fit_windows([windows for windows, _ in rows], [y for _, y in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with the columns they came with."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", text_or_empty("text").alias("text"))
    scored = score(docs, fit(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
