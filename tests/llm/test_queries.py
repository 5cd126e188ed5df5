"""Every registered query of the subpackage on the small tables: its columns, its SQL, and what its contract fixes."""

from __future__ import annotations

import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest

from echotide.llm import html_extraction, queries

DIR = Path("/root/testdata/sf0.001")
COLUMNS = {
    "op1_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2_quality_classifier": "doc_id held_out score predicted",
    "op3_feistel_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_html_extraction": "page_id url text n_chars",
    "op5_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_multiset_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10_language_id": "doc_id held_out lang_pred score",
}
PAGES = {"op4_html_extraction", "op8_warc"}


@pytest.fixture(scope="module")
def results(spark):
    return {name: make(spark, str(DIR)) for name, make in queries.QUERIES.items()}


@pytest.fixture(scope="module")
def rows(results):
    return {name: df.collect() for name, df in results.items()}


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{DIR}/{n}.parquet").collect() for n in ("documents", "pages", "labels")}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(results, rows, tables, name):
    assert set(COLUMNS[name].split()) <= set(results[name].columns)
    held = tables["pages" if name in PAGES else "documents"]
    key = "page_id" if name in PAGES else "doc_id"
    assert sorted(r[key] for r in rows[name]) == sorted(r[key] for r in held)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(results, rows, name):
    db = duckdb.connect()
    for file in DIR.glob("*.parquet"):
        db.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = db.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert columns == sorted(results[name].columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in rows[name]))) == sorted(map(str, (tuple(r[k] for k in place) for r in want.fetchall())))


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_quality(rows, tables):
    got = {r.doc_id: r for r in rows["op2_quality_classifier"]}
    assert all(r.held_out == (crc(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())


def test_sharding(rows, tables):
    texts = {r.doc_id: (r.text or "").encode() for r in tables["documents"]}
    got = rows["op3_feistel_sharding"]
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "rows" for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_pages(rows, tables):
    """The template's result on the given pages is that of their articles, whole."""
    got = {r.page_id: r for r in rows["op4_html_extraction"]}
    alone = {r.page_id: html_extraction.main_text(html_extraction.Page(r.html)) for r in tables["pages"]}
    assert all(got[i].n_chars == len(got[i].text) for i in got)
    kept = [len(got[i].text) / max(1, len(t)) for i, t in alone.items()]
    assert sum(kept) / len(kept) >= 0.99


def test_tokens(rows, tables):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    texts = {r.doc_id: r.text or "" for r in tables["documents"]}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows["op6_sentencepiece"]:
        ids = model.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)))) and r.decoded_sha256 == sha(model.decode(ids))


def test_next_documents(rows, tables):
    docs = sorted(((r.doc_id, r.text or "") for r in tables["documents"]), reverse=True)
    got = {r.doc_id: r for r in rows["op9_multiset_fingerprint"]}
    for k, (i, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[(k + 1) % len(docs)][1][:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())


def test_languages(rows, tables):
    known = {r.doc_id: r.lang for r in tables["documents"]}
    got = {r.doc_id: r for r in rows["op10_language_id"]}
    assert all(r.held_out == (crc(i, 4) == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [got[i].lang_pred == lang for i, lang in known.items() if lang and got[i].held_out and got[i].lang_pred != "und"]
    assert sum(held) / len(held) > 0.9
