"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits hold two blocks of 23 bits, each covered by the perfect binary Golay code: every 23-bit word
lies within 3 bits of exactly one code word. A pair of code words is an anchor; the other 18 bits belong to no block and
are looked at only when fingerprints are compared. The anchor nearest to a fingerprint is its *home*. If two
fingerprints differ in at most two bits, the second lies within 3 + a and 3 + b bits of the first one's home, block by
block, with a + b at most 2. So each fingerprint is sent to all anchors in that reach (61 on average), meets there all
fingerprints at home, and no pair is missed.

There are 2^24 anchors, so a bitmap of the occupied ones always takes 2 MB; a copy of a fingerprint is shipped only
to an anchor at which something is at home. Anchors with many fingerprints are cut into a grid of cells of bounded
size; every home meets every visitor in exactly one cell. A task holds one cell at a time and reports a spanning
forest of the links it finds, not the links themselves, so a large group of near copies stays linear in its size.
Equal fingerprints are one node from the start.

Defined results: texts without words (null, empty, blank) have fingerprint 0 and are linked like any other; a null
``doc_id`` gets its group's component like any row, and does not count for the smallest id; repeated rows get equal
results. An empty table gives an empty table. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import free_name, query, table
from tallyfield.llm.components import connected_components, local_roots
from tallyfield.session import materialise

#: Words per shingle, seed of the shingle hash, most differing bits of a link.
SHINGLE_WORDS, HASH_SEED, MOST_BITS = 3, 42, 2
#: Generator polynomial of the binary Golay code, its length, check bits and covering radius.
GOLAY_POLYNOMIAL, GOLAY_LENGTH, GOLAY_CHECKS, GOLAY_RADIUS = 0b110001110101, 23, 11, 3
#: Fingerprints on one side of a cell, and pairs compared at once.
CELL_ROWS, PAIRS_AT_ONCE = 4096, 1 << 20


def shingle_hashes(text: str | None, words_in_shingle: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of the whole sequence if it is shorter; empty without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_in_shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words_in_shingle] + 1]).tolist()
    spans = zip(starts, ends[words_in_shingle - 1 :].tolist(), strict=True)
    return np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; signed, as Spark keeps it."""
    if not len(hashes):
        return 0
    set_bits = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        octets = part.astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS, passed: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (long) and the ``passed`` columns of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), words_in_shingle)) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *passed])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in passed]
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "fp long", *kinds])
    return docs.select("doc_id", "text", *passed).mapInArrow(run, schema)


class Covering:
    """Home and reachable anchors of fingerprints; tables of some 45,000 error patterns, made from the polynomial."""

    def __init__(self, most_bits: int = MOST_BITS):
        self.most_bits = most_bits
        words = np.arange(1 << (GOLAY_LENGTH - GOLAY_CHECKS), dtype=np.int64)
        rest = words << GOLAY_CHECKS
        for bit in range(GOLAY_LENGTH - 1, GOLAY_CHECKS - 1, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GOLAY_POLYNOMIAL << (bit - GOLAY_CHECKS)), rest)
        self.remainder = rest
        self.patterns, self.offsets = [], []
        for excess in range(most_bits + 1):
            weights = range(GOLAY_RADIUS + 1) if excess == 0 else [GOLAY_RADIUS + excess]
            errors = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(GOLAY_LENGTH), w)], np.int64)
            syndromes = self.syndrome(errors)
            order = np.argsort(syndromes, kind="stable")
            self.patterns.append(errors[order])
            self.offsets.append(np.searchsorted(syndromes[order], np.arange((1 << GOLAY_CHECKS) + 1)))

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.remainder[words >> GOLAY_CHECKS] ^ (words & ((1 << GOLAY_CHECKS) - 1))

    def _blocks(self, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        bits = fps.view(np.uint64)
        mask = np.uint64((1 << GOLAY_LENGTH) - 1)
        blocks = [((bits >> np.uint64(s)) & mask).astype(np.int64) for s in (0, GOLAY_LENGTH)]
        return [(b, self.syndrome(b)) for b in blocks]

    def reach(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Parts of (place in fps, anchor, is home) that together hold every anchor in reach of every fingerprint."""
        (x, sx), (y, sy) = self._blocks(fps)
        message = GOLAY_LENGTH - GOLAY_CHECKS
        for first in range(self.most_bits + 1):
            for second in range(self.most_bits + 1 - first):
                px, ox, py, oy = self.patterns[first], self.offsets[first], self.patterns[second], self.offsets[second]
                nx, ny = ox[sx + 1] - ox[sx], oy[sy + 1] - oy[sy]
                total = nx * ny
                at = np.repeat(np.arange(len(fps)), total)
                k = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
                ax = (x[at] ^ px[ox[sx[at]] + k // ny[at]]) >> GOLAY_CHECKS
                ay = (y[at] ^ py[oy[sy[at]] + k % ny[at]]) >> GOLAY_CHECKS
                yield at, (ax << message) | ay, first == second == 0

    def home(self, fps: np.ndarray) -> np.ndarray:
        return next(self.reach(fps))[1]


def _with_home(nodes: DataFrame, most_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Covering(most_bits)
        for batch in batches:
            home = code.home(np.asarray(batch.column(0), np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int64())], [*batch.schema.names, "home"])

    kind = nodes.schema["first_id"].dataType.simpleString()
    return nodes.select("fp", "first_id").mapInArrow(run, f"fp long, first_id {kind}, home long")


def _occupied(nodes: DataFrame) -> np.ndarray:
    """Bitmap of the anchors at which a fingerprint is at home: 2 MB, whatever the number of fingerprints."""
    place = F.col("home") + 1
    parts = nodes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bitmap = np.zeros(1 << (2 * (GOLAY_LENGTH - GOLAY_CHECKS) - 3), np.uint8)
    for part, bits in parts.collect():
        bitmap[(part - 1) * 4096 : part * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return bitmap


def _visits(nodes: DataFrame, occupied: np.ndarray, most_bits: int) -> DataFrame:
    """(anchor, fp, is_home) for every occupied anchor in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Covering(most_bits)
        for batch in batches:
            fps_of_batch = np.asarray(batch.column(0), np.int64)
            for begin in range(0, len(fps_of_batch), CELL_ROWS):
                fps = fps_of_batch[begin : begin + CELL_ROWS]
                for at, anchor, home in code.reach(fps):
                    met = (occupied[anchor >> 3] >> (anchor & 7) & 1).astype(bool)
                    at, anchor = at[met], anchor[met]
                    columns = [pa.array(anchor), pa.array(fps[at]), pa.array(np.full(len(at), home))]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "fp", "is_home"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long, is_home boolean")


def _cells(visits: DataFrame, cell_rows: int) -> DataFrame:
    """(anchor, across, down, host, fp): homes as hosts and all visitors of each cell of an anchor's grid."""
    sizes = visits.groupBy("anchor").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("is_home").cast("long")).alias("homes"))
    hot = sizes.filter(F.col("all") > cell_rows).select(
        "anchor", F.ceil(F.col("homes") / cell_rows).alias("rows"), F.ceil(F.col("all") / cell_rows).alias("columns")
    )
    placed = visits.join(hot, "anchor", "left").withColumns(
        {"rows": F.coalesce("rows", F.lit(1)), "columns": F.coalesce("columns", F.lit(1))}
    )
    spread = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    visitors = placed.select("anchor", steps("rows").alias("across"), spread("columns").alias("down"), F.lit(False).alias("host"), "fp")
    hosts = placed.filter("is_home").select("anchor", spread("rows").alias("across"), steps("columns").alias("down"), F.lit(True).alias("host"), "fp")
    return visitors.unionAll(hosts)


def _links(cells: DataFrame, most_bits: int) -> DataFrame:
    """Spanning links (u, v) of all pairs that meet in a cell and differ in few enough bits."""

    def forest(key: np.ndarray, host: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows are ordered by cell (``key`` counts cells); hosts and visitors of a cell stand in any order."""
        order = np.lexsort((host, key))
        key, host, fp = key[order], host[order], fp[order]
        begins = np.searchsorted(key, key, "left")
        visitors = np.searchsorted(key * 2 + host, key * 2, "right") - begins
        hosts = np.flatnonzero(host)
        us, vs = [], []

        def compare(at: np.ndarray, first: np.ndarray, number: np.ndarray) -> None:
            a = np.repeat(at, number)
            b = np.arange(len(a)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
            near = np.bitwise_count(fp[a] ^ fp[b]) <= most_bits
            near &= fp[a] != fp[b]
            us.append(fp[a[near]])
            vs.append(fp[b[near]])
            if sum(map(len, us)) > PAIRS_AT_ONCE:
                nodes, roots = local_roots(np.concatenate(us), np.concatenate(vs))
                us[:], vs[:] = [nodes], [roots]

        load = np.cumsum(visitors[hosts])
        begin = 0
        while begin < len(hosts):
            done = load[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(load, done + PAIRS_AT_ONCE, "right")))
            at = hosts[begin:end]
            compare(at, begins[at], visitors[at])
            begin = end
        if not us:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        nodes, roots = local_roots(np.concatenate(us), np.concatenate(vs))
        return nodes[nodes != roots], roots[nodes != roots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None  # the last cell may go on in the next batch
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([np.asarray(batch.column(i), np.int64) for i in range(3)], axis=1)
            host = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), bool)
            fp = np.asarray(batch.column(4), np.int64)
            if kept is not None:
                cell, host, fp = np.concatenate([np.broadcast_to(last, (len(kept[1]), 3)), cell]), np.concatenate([kept[0], host]), np.concatenate([kept[1], fp])
            key = np.concatenate([[0], np.cumsum((cell[1:] != cell[:-1]).any(axis=1))])
            cut = int(np.searchsorted(key, key[-1]))
            last, kept = cell[-1].copy(), [host[cut:].copy(), fp[cut:].copy()]
            u, v = forest(key[:cut], host[:cut], fp[:cut])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if kept is not None:
            u, v = forest(np.zeros(len(kept[1]), np.int64), *kept)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    keys = ["anchor", "across", "down"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def _groups(marked: DataFrame, most_bits: int, cell_rows: int) -> DataFrame:
    """fp, root (smallest fingerprint of its group) and component_id of the fingerprints of ``marked(doc_id, fp)``."""
    nodes = materialise(_with_home(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), most_bits), "simhash-nodes")
    visits = materialise(_visits(nodes, _occupied(nodes), most_bits), "simhash-visits")
    links = _links(_cells(visits, cell_rows), most_bits)
    labels = connected_components(links, "simhash-links")
    members = materialise(labels.join(nodes.select(F.col("fp").alias("node"), "first_id"), "node"), "simhash-labels")
    least = members.groupBy("root").agg(F.min("first_id").alias("least_id"))
    joined = members.join(least, "root").select(F.col("node").alias("fp"), "root", "least_id")
    component = F.coalesce("least_id", "first_id").alias("component_id")
    return nodes.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), component)


def near_duplicates(
    docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS, most_bits: int = MOST_BITS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable over links of at most ``most_bits`` bits."""
    marked = materialise(fingerprints(docs, words_in_shingle), "simhash")
    ids = _groups(marked, most_bits, cell_rows).select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest ``doc_id`` (nulls last), then fingerprint, then text.

    A row is lost only to a row of its own group, also if it has no id or the id of a row in another group.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    marked = materialise(fingerprints(keyed, words_in_shingle, ("h1", "h2")), "simhash")
    rooted = materialise(marked.join(_groups(marked, most_bits, CELL_ROWS).select("fp", "root"), "fp"), "simhash-roots")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")
    best = rooted.groupBy("root").agg(F.min(order).alias("best"))
    chosen = rooted.join(best, "root").filter(order == F.col("best"))
    key, one, two, group = (free_name(docs, c) for c in ("kept_id", "kept_h1", "kept_h2", "kept_group"))
    chosen = chosen.select(F.col("doc_id").alias(key), F.col("h1").alias(one), F.col("h2").alias(two), F.col("root").alias(group)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(one)) & (F.xxhash64(F.lit("second"), "text") == F.col(two))
    rows = docs.join(chosen, same).groupBy(group).agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("row"))
    return rows.select("row.*")


@query("op1_simhash_dedup")
def op1_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
