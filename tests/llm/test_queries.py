"""The registered queries and the pipeline on the smallest tables."""

import pytest

import corpus_pipeline
from emberlake.llm import decontam, linededup, packing, shingles, toxicity
from emberlake.llm.common import table
from emberlake.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(name, spark, duck, folder):
    assert rows_of(QUERIES[name](spark, folder)) == oracle_rows(duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_one_row_for_each_document(name, spark, folder):
    found = QUERIES[name](spark, folder)
    ids = {r[0] for r in table(spark, folder, "documents").select("doc_id").collect()}
    if name.startswith("op6"):
        assert {i for r in found.select("doc_ids").collect() for i in r[0]} == ids
    elif name.startswith("op8"):
        assert {r[0] for r in found.select("doc_id").collect()} <= ids
    else:
        assert {r[0] for r in found.select("doc_id").collect()} == ids


def test_pipeline_stage_by_stage(spark, folder):
    """Each stage against what its operator says of its own input."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    clean = corpus_pipeline.reject_toxic(spark, docs, folder)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad and clean.columns == docs.columns
    lines = corpus_pipeline.drop_boilerplate_lines(spark, clean, folder)
    counts, totals = {}, {}
    for r in clean.collect():
        totals[r.source] = totals.get(r.source, 0) + 1
        for x in {x.strip(" ") for x in (r.text or "").split("\n")} - {""}:
            counts[r.source, x] = counts.get((r.source, x), 0) + 1
    drop = {k for k, n in counts.items() if n >= linededup.LEAST_PAGES and n > corpus_pipeline.LINE_RATIO * totals[k[0]]}
    texts = {r.doc_id: r for r in lines.collect()}
    for r in clean.collect():
        kept = [x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in drop]
        want = "\n".join(kept) if any(x.strip(" ") for x in kept) or not r.text.strip(" \n") else r.text
        assert texts[r.doc_id].text == want and texts[r.doc_id].n_chars == len(want)
    alone = corpus_pipeline.drop_near_duplicates(spark, lines, folder)
    assert sorted(r.doc_id for r in alone.collect()) == sorted({r.component_id for r in shingles.near_duplicates(lines).collect()})
    fresh = corpus_pipeline.drop_contaminated(spark, alone, folder)
    leaked = {r.doc_id for r in decontam.leaks(alone, table(spark, folder, "benchmark")).collect()}
    assert {r.doc_id for r in fresh.collect()} == {r.doc_id for r in alone.collect()} - leaked
    out = corpus_pipeline.pack(spark, fresh, folder)
    assert rows_of(out) == rows_of(packing.pack_documents(fresh))
    whole = corpus_pipeline.run(spark, folder)
    assert rows_of(whole.select("doc_id", "start", "length", "ids_crc32")) == rows_of(out.select("doc_id", "start", "length", "ids_crc32"))
