"""All stages on awkward and empty tables."""

import corpus_pipeline


def test_stages_on_awkward_documents(spark, docs, folder):
    """Nulls, empty, repeated and very long texts, a long blank one, null and repeated ids, extra columns: every stage gives a defined result."""
    blank = spark.createDataFrame([(300, " " * 1_200_000, "en", "src1", 1_200_000, "x", 7, 0.5), (301, "\n" * 20_000 + "a", None, None, None, None, None, None)], docs.schema)
    now = docs.unionByName(blank)
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, now, folder)
        assert kept.columns == corpus_pipeline.COLUMNS, name
        rows = kept.collect()
        assert {r.doc_id for r in rows} <= ids and rows, name
        if name in ("toxicity", "line_dedup"):
            assert {100, 101, 103, 300, 301} <= {r.doc_id for r in rows}, name
        now = spark.createDataFrame(rows, kept.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in now.select("doc_id").collect()}
    assert max(r.length for r in out) <= 1024 and len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_stages_on_an_empty_table(spark, docs, folder):
    now = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        assert now.count() == 0
