"""The pipeline's stages against what each is to do with its own input."""

import os

import corpus_pipeline
from samples import edge_rows
from test_dedup import plain_components, plain_lines

from reelgate.llm.mixing import mix
from reelgate.session import shared_dir

SAMPLE = "/root/testdata/sf0.001"


def test_stages_on_the_sample(spark, tmp_path):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    columns = docs.columns
    held = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, held[-1], SAMPLE).write.parquet(path)
        held.append(spark.read.parquet(path))
    assert all(d.columns == columns for d in held[:-1])
    first, kept, lined, single, mixed, packed = [d.collect() for d in held]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SAMPLE}/labels.parquet").collect()}
    assert all(labels.get(r.doc_id) != 0 for r in kept)
    assert {r.doc_id for r in first if labels.get(r.doc_id) == 1} <= {r.doc_id for r in kept}
    lines = {i: t for i, _, t in plain_lines([(r.doc_id, r.text) for r in kept])}
    assert {r.doc_id: r.text for r in lined} == lines and all(r.n_chars == len(r.text) for r in lined)
    roots = plain_components([(r.doc_id, r.text) for r in lined], 5, 80)
    assert sorted(r.doc_id for r in single) == sorted(d for d, (_, root) in roots.items() if root == d)
    taken = {r.doc_id: len(r.copies) for r in mix(held[3]).collect()}
    assert sorted(r.doc_id for r in mixed) == sorted(d for d, n in taken.items() for _ in range(n))
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def test_stages_on_edge_rows(spark, documents, tmp_path):
    docs = documents(edge_rows())
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, SAMPLE).write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0


def test_stages_on_empty_tables_and_clashing_names(spark, documents, tmp_path):
    empty, wide = documents([], extra=True), documents(edge_rows(), extra=True)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, SAMPLE).count() == 0
        done = stage(spark, wide, SAMPLE)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert done.columns == wide.columns
        path = str(tmp_path / str(number))
        done.write.parquet(path)
        wide = spark.read.parquet(path)
    assert wide.count() > 0


def test_run_leaves_its_last_table_only(spark):
    root = shared_dir(spark).removeprefix("file:")
    before = {p for p in os.listdir(root) if p.startswith("pipeline-")}
    assert corpus_pipeline.run(spark, SAMPLE).count() > 0
    (own,) = {p for p in os.listdir(root) if p.startswith("pipeline-")} - before
    assert os.listdir(f"{root}/{own}") == [str(len(corpus_pipeline.STAGES) - 1)]


def test_run_is_registered(spark):
    import __spark_entry__

    assert corpus_pipeline.ORACLE_SQL is None
    assert __spark_entry__.queries()["pipeline"](spark, SAMPLE).count() > 0
