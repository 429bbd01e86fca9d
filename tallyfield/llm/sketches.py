"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every word shingle is hashed once. The hash's top bits name a bin, and a bin keeps the least hash that falls in it. An
empty bin takes the value of a full one: it walks through all bins in an order of its own, shared by all documents, to
the first full one. Each bin's hash is mixed with the bin's number, so that the bins a short text fills with one hash
do not all agree by the same chance; of the outcome only the ``BITS`` lowest bits are kept and packed, two bins a byte.
Two values agree by chance with probability 2^-BITS; ``likeness`` takes that off.

Defined results: texts without words (null, empty, blank) have the empty fingerprint, like each other fully and nothing
else at all. Equal texts have equal fingerprints. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import query, table
from tallyfield.llm.simhash import shingle_hashes
from tallyfield.session import materialise

#: Words per shingle, number of bins (a power of two), bits kept of each bin, seed of the shingle hash.
SHINGLE_WORDS, BINS, BITS, HASH_SEED = 5, 512, 4, 7


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one 64-bit mixer."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class Sketcher:
    def __init__(self, bins: int = BINS, bits: int = BITS, shingle_words: int = SHINGLE_WORDS, seed: int = HASH_SEED):
        if bins & (bins - 1) or bins * bits % 8 or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8, and together fill whole bytes")
        self.bins, self.bits, self.words, self.seed = bins, bits, shingle_words, seed
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        self.edges = np.arange(bins, dtype=np.uint64) << self.shift
        with np.errstate(over="ignore"):
            x = mix(np.arange(1, bins * bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.salt = x[:bins].copy()
        # for each bin the order in which it looks at the others when it is empty
        self.rank = np.argsort(np.argsort(x.reshape(bins, bins), axis=1), axis=1).astype(np.uint16)

    def sketch(self, text: str | None) -> bytes:
        hashes = np.sort(shingle_hashes(text, self.words, self.seed))
        if not len(hashes):
            return b""
        at = np.minimum(np.searchsorted(hashes, self.edges), len(hashes) - 1)
        least = hashes[at]
        full = (least >> self.shift) == (self.edges >> self.shift)
        if not full.all():
            empty, filled = np.flatnonzero(~full), np.flatnonzero(full)
            least[empty] = least[filled[self.rank[np.ix_(empty, filled)].argmin(axis=1)]]
        values = (mix(least ^ self.salt) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        spread = np.unpackbits(values[:, None], axis=1, bitorder="little")[:, : self.bits]
        return np.packbits(spread).tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """Estimated Jaccard likeness of two texts' shingles, from 0 to 1."""
        if not a or not b:
            return float(a == b)
        x, y = (np.unpackbits(np.frombuffer(s, np.uint8)).reshape(self.bins, self.bits) for s in (a, b))
        chance = 2.0**-self.bits
        return float(min(1.0, max(0.0, ((x == y).all(axis=1).mean() - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """The last third of the text's code points replaced by as many, or all, of the following text's first."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def sketches(docs: DataFrame, sketcher: Sketcher | None = None) -> DataFrame:
    """doc_id and fingerprint (binary) of ``docs(doc_id, text)``."""
    maker = sketcher or Sketcher()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([maker.sketch(t.as_py()) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint binary")


RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
RESULT_TYPES = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
ARROW_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
FINISHED, LAST, FIRST = 0, 1, 2


def compared_with_next(docs: DataFrame, sketcher: Sketcher | None = None) -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness to each other and to the next document.

    The next document is the one with the next smaller ``doc_id``, after the last the first; null ids come last, and
    rows of one id are ordered by text. The texts are range-partitioned by id once and read in order. A partition's
    last text waits for the first text of the next partition that has rows; only those, two a partition, go on to a
    second small step.
    """
    maker = sketcher or Sketcher()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compare(text: str, own: bytes, following: str, of_following: bytes) -> tuple:
        new = edited(text, following)
        of_new = maker.sketch(new)
        digest = hashlib.sha256(new.encode()).digest()
        return len(text), digest, own, of_new, maker.likeness(own, of_new), maker.likeness(own, of_following)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["doc_id", "kind", "part", *RESULT, "text"]
        held = None

        def table_of(ids: list, kinds: list, results: list, texts: list) -> pa.RecordBatch:
            columns = list(zip(*results, strict=True)) if results else [[]] * len(RESULT)
            arrays = [pa.array(c, t) for c, t in zip(columns, ARROW_TYPES, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(kinds, pa.int32()), pa.array([part] * len(ids), pa.int32()), *arrays, pa.array(texts, pa.string())], names
            )

        id_type = None
        blank = (None,) * len(RESULT)
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, kinds, results, texts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                own = maker.sketch(text)
                if held is None:
                    ids.append(doc_id), kinds.append(FIRST), results.append(blank), texts.append(text)
                else:
                    ids.append(held[0]), kinds.append(FINISHED), texts.append(None)
                    results.append(compare(held[1], held[2], text, own))
                held = (doc_id, text, own)
            yield table_of(ids, kinds, results, texts)
        if held is not None:
            yield table_of([held[0]], [LAST], [blank], [held[1]])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [
                compare(text, maker.sketch(text), following, maker.sketch(following))
                for text, following in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            columns = list(zip(*results, strict=True)) if results else [[]] * len(RESULT)
            arrays = [pa.array(c, t) for c, t in zip(columns, ARROW_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *RESULT])

    order = F.col("doc_id").desc_nulls_last()
    ordered = docs.select("doc_id", "text").repartitionByRange(order).sortWithinPartitions(order, "text")
    read = materialise(ordered.mapInArrow(in_order, f"doc_id {kind}, kind int, part int, {RESULT_TYPES}, text string"), "next-text")
    last = read.filter(F.col("kind") == LAST).select("doc_id", "part", "text")
    first = read.filter(F.col("kind") == FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    parts = read.filter(F.col("kind") == LAST).select("part")  # one number a partition
    following = parts.select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part")
    )
    borders = last.join(following, "part").join(first, "next_part").select("doc_id", "text", "next_text")
    done = read.filter(F.col("kind") == FINISHED).select("doc_id", *RESULT)
    every = done.unionByName(borders.mapInArrow(across, f"doc_id {kind}, {RESULT_TYPES}"))
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


@query("op7_document_fingerprints")
def op7_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compared_with_next(table(spark, folder, "documents"))
