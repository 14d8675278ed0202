"""The stages of the pipeline, each against brute force on its own input."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    from plumeline.llm import decontaminate, mixing, near_dedup, quality
    from plumeline.llm.common import read, stage

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "tokens"]
    inputs = [read(spark, DATA, "documents")]
    for name, function in corpus_pipeline.STAGES:
        inputs.append(stage(function(spark, inputs[-1], DATA), name))
    documents, good, single, clean, mixed, tokens = inputs
    assert all(sorted(x.columns) == sorted(documents.columns) for x in inputs[:-1])
    labels = {r.doc_id: r.quality for r in read(spark, DATA, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    everything = {r.doc_id for r in documents.collect()}
    assert sum((d in kept) == bool(q) for d, q in labels.items()) >= 0.9 * len(labels)
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(good).collect()}
    assert {r.doc_id for r in single.collect()} == {d for d, c in near.items() if d == c}
    hit = {r.doc_id for r in decontaminate.contamination(single, read(spark, DATA, "benchmark")).where("n_hit > 0").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - hit
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(clean).collect() if r.taken}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == times and kept <= everything
    assert {r.doc_id: r["count"] for r in tokens.groupBy("doc_id").count().collect()} == counts
    assert quality.TRAIN_ROWS == 20_000


def test_registration(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names}
    assert set(entry.oracle_sql()) <= set(names)
