"""The pipeline's stages on the smallest tables, each against its operator's own result."""

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from clienttrace.llm import queries as registered
from clienttrace.llm.common import written


def test_stages(spark, sf_dir):
    docs = registered.table(spark, sf_dir, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = written(stage(spark, docs, sf_dir), "stage")
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after))
        if k < 4:
            assert docs.columns == columns
        sizes.append(len(after))
    assert sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3] and sizes[5] == sizes[4]
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_odd_rows(spark, sf_dir, frame, odd_texts):
    for rows in (odd_texts, []):
        docs = frame(rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), "stage")
            assert set(docs.columns) == set(frame([]).columns)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_registered():
    found = queries()
    assert [n for n in found if n.startswith("op")] and "pipeline" in found
    assert len([n for n in found if n.startswith("op") and n[2].isdigit()]) == 13
    assert set(registered.SQL) <= set(oracle_sql())
