"""The pipeline's stages over the given tables and over an empty table."""

import corpus_pipeline
from tallyfield.llm import mixing, toxicity


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = out.collect()
    first = spark.read.parquet(f"{folder}/documents.parquet")
    scores = toxicity.score(first, toxicity.fit(first, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    assert sorted(r.doc_id for r in seen["toxicity"]) == sorted(r.doc_id for r in scores if r.score < 0.5)
    assert sorted(r.doc_id for r in seen["line_dedup"]) == sorted(r.doc_id for r in seen["toxicity"])
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"] if r.text is not None)
    ids = [r.doc_id for r in seen["simhash_dedup"]]
    assert len(ids) == len(set(ids)) <= len(seen["line_dedup"])
    kept = spark.createDataFrame(seen["simhash_dedup"], first.schema)
    drawn, names = mixing.with_copies(kept, mixing.word_count())
    expected = {r.doc_id: r[names["copies"]] for r in drawn.collect() if r[names["copies"]]}
    found = {}
    for r in seen["source_mixing"]:
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == expected
    assert len(seen["sentencepiece"]) == len(seen["source_mixing"])
    assert all(r.decoded == r.text.replace("▁", " ") for r in seen["sentencepiece"])


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
