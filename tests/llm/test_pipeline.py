"""The pipeline's stages in order, each against what its operator says of its input."""

from __future__ import annotations

import corpus_pipeline
from groundsieve.llm import decontamination, line_dedup, near_duplicates, quality
from groundsieve.llm.common import table
from groundsieve.sources.staging import stage
from llm_tools import documents

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, seen = table(spark, FOLDER, "documents"), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "ngram_jaccard", "benchmark_decontamination", "best_fit_packing"]
    for name, apply in corpus_pipeline.STAGES[:-1]:
        seen[name] = docs, (docs := stage(apply(spark, docs, FOLDER), "test"))
        before, after = seen[name]
        assert after.columns == before.columns and after.dtypes == before.dtypes
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = seen["quality_rules"]
    assert ids(after) == ids(quality.quality_table(before).where("kept")) and len(ids(after)) < before.count()
    before, after = seen["line_dedup"]
    assert ids(after) == ids(before)
    left = {r.doc_id: r.text for r in line_dedup.deduplicated(before).collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {i: (t, len(t)) for i, t in left.items()}
    before, after = seen["ngram_jaccard"]
    classes = near_duplicates.near_duplicate_classes(before)
    assert ids(after) == sorted({r.class_id for r in classes.collect()}) and len(ids(after)) < before.count()
    before, after = seen["benchmark_decontamination"]
    leaked = {r.doc_id for r in decontamination.leaks(before, table(spark, FOLDER, "benchmark")).collect()}
    assert ids(after) == [i for i in ids(before) if i not in leaked] and leaked
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert sorted(set(r.doc_id for r in packed.collect())) == ids(docs)


def test_run_is_the_stages_in_a_row(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096


def test_messy_documents_go_through(spark, messy, nothing):
    for docs in (messy, nothing):
        for _, apply in corpus_pipeline.STAGES:
            docs = stage(apply(spark, docs, FOLDER), "test")
    assert docs.count() == 0
