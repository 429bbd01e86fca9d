"""The Merkle manifest against a plain version that builds every level of every tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def plain_siblings(levels, at):
    found = []
    for level in levels[:-1]:
        begin = at - at % 3
        found.append((at - begin, [d for i, d in enumerate(level[begin : begin + 3], begin) if i != at]))
        at //= 3
    return found


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256) of every row."""
    order = lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, plain_leaf(r))
    by_source = {}
    for row in sorted(rows, key=order):
        by_source.setdefault(row[3], []).append(row)
    trees = [plain_levels([plain_leaf(r) for r in members]) for members in by_source.values()]
    top = plain_levels([levels[-1][0] for levels in trees])
    out = []
    for t, members in enumerate(by_source.values()):
        for k, row in enumerate(members):
            siblings = plain_siblings(trees[t], k) + plain_siblings(top, t)
            out.append((row[0], trees[t][0][k], trees[t][-1][0], top[-1][0], digest(*[d for _, s in siblings for d in s])))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    made = manifest.build(docs)
    shown = manifest.proofs(made).select("doc_id", "path", "leaf", F.col("leaf").alias("claimed"), "subroot")
    checked = manifest.checked(shown, "claimed", made.root).collect()
    assert all(r.verified for r in checked)
    return sorted([(r.doc_id, r.leaf.hex(), r.subroot.hex(), r.folded_root, r.proof_sha256) for r in checked], key=str)


def row(i, source, text="a\nb", lang="en", n_chars=3):
    return (i, text, lang, source, n_chars)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 81, 82, 244])
def test_one_source_of_every_shape(spark, size):
    given = [row(i, "s", f"text {i}") for i in range(size)]
    assert found(spark, given) == plain(given)


def test_sources_of_unlike_size_nulls_and_repeated_rows(spark):
    given = [row(i, "big", f"t{i}") for i in range(300)]
    given += [row(1000 + i, f"s{i}", "") for i in range(7)]
    given += [row(2000, None, None, None, None), row(2001, "", "x" * 200_000), row(2002, "é\U0001f600", "\n\n"), row(2003, None, "same")]
    given += [row(5, "dup", "same")] * 4 + [row(None, "dup", "no id"), row(None, "dup", "other"), row(5, "dup", "unlike")]
    assert found(spark, given) == plain(given)


def test_empty_table_has_no_root(spark):
    made = manifest.build(spark.createDataFrame([], SCHEMA))
    assert made.root is None and manifest.proofs(made).count() == 0


def test_a_changed_text_or_a_changed_sibling_fails(spark):
    given = [row(i, f"s{i % 3}", f"line {i}\nnext") for i in range(50)]
    docs = spark.createDataFrame(given, SCHEMA)
    tampered = F.when(F.col("doc_id") % 2 == 0, manifest.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.replace("text", F.lit("\n"), F.lit(""))]))
    made = manifest.build(docs.withColumn("claimed", tampered), ["doc_id", "claimed"])
    rows = manifest.proofs(made, ["doc_id", "claimed"]).withColumn("claimed", F.coalesce("claimed", "leaf"))
    got = {r.doc_id: r.verified for r in manifest.checked(rows, "claimed", made.root).collect()}
    assert got == {i: i % 2 == 1 for i in range(50)}
    one = rows.filter("doc_id = 1").first()
    path = bytearray(one.path)
    path[-1] ^= 1
    assert manifest.folded(bytes(one.leaf), bytes(one.path)) == made.root
    assert manifest.folded(bytes(one.leaf), bytes(path)) != made.root


def test_extra_columns_with_clashing_names_do_not_matter(spark):
    given = [row(i, "s", f"t{i}") for i in range(5)]
    docs = spark.createDataFrame(given, SCHEMA)
    clashing = docs.withColumns({c: F.lit("x") for c in ("tree", "pos", "digest", "part", "nodes", "leaf", "path", "block")})
    assert manifest.build(clashing).root == manifest.build(docs).root


def test_query_marks_exactly_the_tampered_rows_with_line_feeds(spark, folder):
    rows = manifest.op11_merkle_manifest(spark, folder).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    broken = {i for i, t in texts.items() if zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in t}
    assert len(rows) == len(texts) and broken
    assert {r.doc_id for r in rows if not r.verified} == broken
    assert all((r.folded_root == r.root) == r.verified for r in rows)
