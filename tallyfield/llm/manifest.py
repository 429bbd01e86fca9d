"""Merkle manifest of a table, with checkpointed levels and recomputed proofs.

Each row is a leaf: a SHA-256 over its fields. The leaves of one source, in order of ``doc_id``, form a tree in which every
``ARITY`` consecutive nodes become one, until one is left, the source's subroot; the subroots, in order of their source, form
the tree of the manifest's root.

Only every ``LEVELS``-th level of a tree is stored, one row for each aligned subtree of up to ``ARITY ** LEVELS`` stored nodes.
The levels between are computed inside a task, used and dropped: on the way up for the subtree's root, and again when proofs are
read. A proof goes from the root down. A stored subtree gets the path from its own root to the manifest's root, recomputes its
missing inner nodes from its stored nodes, and hands each of these the path made longer by its siblings.

A source with a third of all rows is no large task: leaves are numbered in ranges of source and id together
(``operators.ordered``), and from then on a group is one subtree. Texts are read once and never shuffled, what moves is
a digest a row. Levels are stored in the shared folder; rounds grow with the logarithm of the rows.

Defined results: a null field counts as ``-``; a null source is a source of its own and comes first, and so do null ids in
their source. Rows that share an id are ordered by leaf, so repeated rows are equal neighbours. A source with one row has that
leaf as its subroot. Empty and very long texts need no care. An empty table gives an empty manifest without a root (None).
Only the named fields enter a leaf; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import query, table
from tallyfield.operators import ordered
from tallyfield.session import materialise

#: Nodes of a run, levels from one stored level to the next, fields of a leaf.
ARITY, LEVELS = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Stored nodes of an aligned subtree, bytes of a digest.
SUBTREE, DIGEST = ARITY**LEVELS, 32


# --- leaves and runs ------------------------------------------------------------------------------------


def leaf(fields: Sequence[Column]) -> Column:
    """Digest (binary) of the fields: each ``-`` if null, else its UTF-8 length, a colon and the value."""
    text = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def run_digest(run: Sequence[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in run).encode()).digest()


def height(nodes: int) -> int:
    """Levels above ``nodes`` nodes until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def climb(nodes: Sequence[bytes], levels: int) -> list[list[bytes]]:
    """The given nodes and the levels above them, up to the one ``levels`` higher."""
    found = [list(nodes)]
    for _ in range(levels):
        below = found[-1]
        found.append([run_digest(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return found


def steps_from(found: list[list[bytes]], place: int) -> bytes:
    """A node's path to the subtree's root: for each level a byte (place in its run, nodes of the run) and the siblings."""
    path = []
    for level in found[:-1]:
        begin = place - place % ARITY
        run = level[begin : begin + ARITY]
        path.append(bytes([(place - begin) * (ARITY + 1) + len(run)]))
        path += [d for i, d in enumerate(run, begin) if i != place]
        place //= ARITY
    return b"".join(path)


def read_path(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place in the run, siblings from left to right) of each level."""
    at = 0
    while at < len(path):
        place, nodes = divmod(path[at], ARITY + 1)
        end = at + 1 + (nodes - 1) * DIGEST
        yield place, [path[i : i + DIGEST] for i in range(at + 1, end, DIGEST)]
        at = end


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for place, siblings in read_path(path):
        digest = run_digest([*siblings[:place], digest, *siblings[place:]])
    return digest


def siblings_digest(path: bytes) -> str:
    return run_digest([d for _, siblings in read_path(path) for d in siblings]).hex()


# --- stored levels --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Stored levels of several trees, and the trees' roots.

    ``blocks[j]`` has a row for each aligned subtree of the j-th stored level: tree, part, nodes (of that level in the tree)
    and members (pos, digest and, in the lowest level, carried columns). ``roots`` has tree, digest and block, the last
    stored level below the root.
    """

    blocks: list[DataFrame]
    roots: DataFrame


def _gathered(nodes: DataFrame, carried: Sequence[str], label: str) -> DataFrame:
    """Aligned subtrees of nodes(tree, pos, nodes, digest): at most ``SUBTREE`` members a row."""
    part = F.expr(f"pos div {SUBTREE}").alias("part")
    members = F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("members")
    return materialise(nodes.groupBy("tree", part).agg(F.first("nodes").alias("nodes"), members), label)


def _roots_of(block: DataFrame, label: str) -> DataFrame:
    """tree, pos, nodes and digest of the next stored level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, part = batch.column(0), batch.column(1)
            nodes = batch.column(2).to_pylist()
            up = [min(LEVELS, height(n)) for n in nodes]
            made = [climb(m, u)[-1][0] for m, u in zip(batch.column(3).to_pylist(), up, strict=True)]
            left = [-(-n // ARITY**u) for n, u in zip(nodes, up, strict=True)]
            yield pa.RecordBatch.from_arrays([tree, part, pa.array(left, pa.int64()), pa.array(made, pa.binary())], ["tree", "pos", "nodes", "digest"])

    slim = block.select("tree", "part", "nodes", F.col("members.digest").alias("digests"))
    return materialise(slim.mapInArrow(run, "tree string, pos long, nodes long, digest binary"), label)


def forest(leaves: DataFrame, order: Sequence[str], carried: Sequence[str], label: str) -> Forest:
    """Trees over ``leaves(tree, digest, *order, *carried)``; ``order`` settles the leaves' places in a tree."""
    ranges = ordered.in_ranges(leaves, ["tree"], [*order, "digest"])
    numbered = ordered.whole(ordered.number_rows(ranges, ["tree"], [*order, "digest"], "pos"))
    sizes = ranges.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"))
    placed = numbered.withColumn("pos", F.col("pos") - 1).join(sizes, "tree")
    blocks, roots = [_gathered(placed, carried, f"{label}-level")], []
    while True:
        above = _roots_of(blocks[-1], f"{label}-nodes")
        roots.append(above.filter("nodes = 1").select("tree", "digest", F.lit(len(blocks) - 1).alias("block")))
        rest = above.filter("nodes > 1")
        if rest.isEmpty():
            break
        blocks.append(_gathered(rest, [], f"{label}-level"))
    every = roots[0]
    for more in roots[1:]:
        every = every.unionAll(more)
    return Forest(blocks, every)


def _paths(block: DataFrame, tails: DataFrame, carried: Sequence[str]) -> DataFrame:
    """tree, pos, subroot, digest, path and carried columns of every stored node, from the paths of the subtrees' roots."""
    joined = block.join(tails, ["tree", "part"]).select("tree", "part", "nodes", "subroot", "tail", F.col("members.digest").alias("digests"), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, tails_, digests = (batch.column(i).to_pylist() for i in (2, 4, 5))
            paths = []
            for n, tail, members in zip(nodes, tails_, digests, strict=True):
                levels = climb(members, min(LEVELS, height(n)))
                paths.append([steps_from(levels, place) + tail for place in range(len(members))])
            columns = [*(batch.column(i) for i in (0, 3, 6)), pa.array(paths, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "subroot", "members", "paths"])

    members = block.schema["members"].dataType.simpleString()
    found = joined.mapInArrow(run, f"tree string, subroot binary, members {members}, paths array<binary>")
    each = found.select("tree", "subroot", F.explode(F.arrays_zip("members", "paths")).alias("m"))
    return each.select("tree", "subroot", "m.members.pos", "m.members.digest", F.col("m.paths").alias("path"), *[f"m.members.{c}" for c in carried])


def paths(trees: Forest, ends: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Paths of all leaves; ``ends(tree, block, subroot, tail)`` tells how each tree's root goes on."""
    tails = None
    for j in range(len(trees.blocks) - 1, -1, -1):
        own = ends.filter(F.col("block") == j).select("tree", F.lit(0).cast("long").alias("part"), "subroot", "tail")
        tails = own if tails is None else own.unionByName(tails)
        if j:
            # the nodes of this level are the roots of the subtrees one stored level below
            tails = _paths(trees.blocks[j], tails, []).select("tree", F.col("pos").alias("part"), "subroot", F.col("path").alias("tail"))
    return _paths(trees.blocks[0], tails, carried)


# --- manifest -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """Stored levels of all sources' trees and of the tree above them; ``root`` is None for an empty table."""

    sources: Forest
    top: Forest
    root: bytes | None


def build(docs: DataFrame, carried: Sequence[str] = ("doc_id",), fields: Sequence[str] = FIELDS) -> Manifest:
    """Manifest of ``docs``; the ``carried`` columns are kept beside the leaves for whoever reads proofs."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null first, then bytewise
    own = [c for c in carried if c != "doc_id"]
    leaves = docs.select(tree.alias("tree"), "doc_id", leaf([F.col(f) for f in fields]).alias("digest"), *own)
    sources = forest(materialise(leaves, "manifest-leaves"), ["doc_id"], ["doc_id", *own], "manifest")
    subroots = sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest", "block")
    top = forest(subroots, ["source"], ["source", "block"], "manifest-top")
    root = top.roots.first()
    return Manifest(sources, top, bytes(root["digest"]) if root else None)


def proofs(manifest: Manifest, carried: Sequence[str] = ("doc_id",)) -> DataFrame:
    """doc_id, leaf, subroot, path (binary, see ``read_path``) and carried columns of every row of the manifest."""
    last = manifest.top.roots.select("tree", "block", F.col("digest").alias("subroot"), F.lit(b"").alias("tail"))
    tops = paths(manifest.top, last, ["source", "block"])
    # one row a source, stored so that the planner knows its size
    ends = materialise(tops.select(F.col("source").alias("tree"), "block", F.col("digest").alias("subroot"), F.col("path").alias("tail")), "manifest-ends")
    own = [c for c in carried if c != "doc_id"]
    found = paths(manifest.sources, ends, ["doc_id", *own])
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "path", *own)


def checked(found: DataFrame, claimed: str, root: bytes | None) -> DataFrame:
    """``found(..., path)`` with proof_sha256, folded_root (from the leaf in column ``claimed``) and verified."""
    keep = [c for c in found.columns if c not in ("path", claimed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways, leaves = batch.column("path").to_pylist(), batch.column(claimed).to_pylist()
            roots = [folded(digest, way) for digest, way in zip(leaves, ways, strict=True)]
            columns = [
                *(batch.column(c) for c in keep),
                pa.array([siblings_digest(w) for w in ways], pa.string()),
                pa.array([r.hex() for r in roots], pa.string()),
                pa.array([r == root for r in roots], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "proof_sha256", "folded_root", "verified"])

    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in keep)
    return found.mapInArrow(run, f"{kinds}, proof_sha256 string, folded_root string, verified boolean")


SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i))
), hashed AS (
  SELECT doc_id, source, text, '' || CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
      || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 2 = 0 AS tampered
  FROM documents, crc_table
), leaves AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' WHEN tampered THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')
      ELSE strlen(text) || ':' || text END) AS claimed FROM hashed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1
  GROUP BY tree, level, pos // 3, n
), subroots AS (SELECT tree, h AS subroot, level AS height, (SELECT max(tree) + 1 FROM placed) AS trees FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, tree AS pos, trees AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n
), steps AS (
  SELECT p.row, l.level, n.pos, n.h, p.pos // (3 ** l.level)::BIGINT AS own
  FROM placed p JOIN subroots s USING (tree) JOIN (SELECT DISTINCT level FROM nodes) l ON l.level < s.height
  JOIN nodes n ON n.tree = p.tree AND n.level = l.level AND n.pos // 3 = p.pos // (3 ** (l.level + 1))::BIGINT
  UNION ALL
  SELECT p.row, 1000 + l.level, n.pos, n.h, p.tree // (3 ** l.level)::BIGINT
  FROM placed p JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) l ON true
  JOIN tops n ON n.level = l.level AND n.pos // 3 = p.tree // (3 ** (l.level + 1))::BIGINT
), sides AS (
  SELECT row, level, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < own), '') AS before,
    coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > own), '') AS after FROM steps GROUP BY row, level
), numbered AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY level) AS step FROM sides
), proofs AS (SELECT row, sha256(string_agg(before || after, '' ORDER BY level)) AS proof, max(step) AS steps FROM numbered GROUP BY row
), folds AS (
  SELECT row, 1 AS step, claimed AS h FROM placed
  UNION ALL SELECT f.row, f.step + 1, sha256(s.before || f.h || s.after) FROM folds f JOIN numbered s ON s.row = f.row AND s.step = f.step
), roots AS (SELECT row, max_by(h, step) AS folded FROM folds GROUP BY row)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
  folded AS folded_root, folded = (SELECT h FROM tops WHERE n = 1) AS verified
FROM placed JOIN subroots USING (tree) JOIN roots USING (row) LEFT JOIN proofs USING (row)
"""


@query("op11_merkle_manifest", SQL)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Where 2 divides the checksum of the id, the claimed leaf is that of the text without its line feeds."""
    docs = table(spark, folder, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = F.when(tampered, leaf([*[F.col(f) for f in FIELDS[:-1]], text]))
    manifest = build(docs.withColumn("claimed", claimed), ["doc_id", "claimed"])
    found = proofs(manifest, ["doc_id", "claimed"]).withColumn("claimed", F.coalesce("claimed", "leaf"))
    shown = found.select("doc_id", "path", "claimed", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot")])
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string").alias("root")
    return checked(shown, "claimed", manifest.root).select("*", root)
