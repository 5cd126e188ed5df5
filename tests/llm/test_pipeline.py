from __future__ import annotations

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from echotide.llm._store import materialise

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], DIR), "test"))
    return out


def test_columns_and_rows(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns
        assert 0 < after.count() <= before.count()
    assert stages[-1].count() == stages[-2].count()
    assert stages[3].count() == stages[2].count()


def test_no_leak_or_passage_is_left(spark, stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    runs = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = word.findall(r.text.lower())
        runs |= {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    for t in texts.values():
        w = word.findall(t.lower())
        assert not any(tuple(w[k : k + 8]) in runs for k in range(len(w) - 7))


def test_tokens_decode_to_the_text(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    assert all(r.decoded == texts[r.doc_id] for r in stages[5].collect())


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, DIR).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((r.doc_id, r.ids) for r in stages[-1].collect())


@pytest.mark.parametrize("place", range(5))
def test_stages_on_odd_and_no_rows(spark, docs, no_docs, place):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like those used inside."""
    _, stage = corpus_pipeline.STAGES[place]
    kept = stage(spark, docs, DIR)
    assert 0 < kept.count() <= docs.count()
    assert stage(spark, no_docs, DIR).count() == 0
    if place < 4:
        assert kept.columns == corpus_pipeline.COLUMNS
        if place != 2:  # other stages leave texts as they are
            texts = {(str(r.doc_id), r.text) for r in docs.collect()}
            assert {(str(r.doc_id), r.text) for r in kept.collect()} <= texts


def test_intermediate_tables_are_deleted(spark):
    from echotide.llm import _store as store

    before = len(store.WRITTEN)
    corpus_pipeline.run(spark, DIR).count()
    assert len(store.WRITTEN) - before <= 2  # the last stage's input and its own
