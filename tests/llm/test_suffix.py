from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echotide.llm import suffix_array, suffix_dedup


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 3), st.sampled_from([0, 2, 40]))
def test_suffix_array(values, times, small):
    values = values * times
    before, suffix_array._SMALL = suffix_array._SMALL, small
    try:
        got = suffix_array.suffix_array(np.array(values, np.int64)).tolist()
    finally:
        suffix_array._SMALL = before
    assert got == sorted(range(len(values)), key=lambda i: values[i:])


def brute(texts, length):
    """Rows equal in id and text are one document; documents come by id, null last, then by any order of texts."""
    documents = sorted({(i is None, i or 0, t or "") for i, t in texts})
    seen, out = set(), {}
    for none, i, t in documents:
        data = t.encode()
        gone = set()
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone.update(range(s, s + length))
            seen.add(data[s : s + length])
        kept = bytes(b for k, b in enumerate(data) if k not in gone)
        spans = sum(k - 1 not in gone for k in gone)
        out[None if none else i, t] = len(data), len(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("more", [{}, {"block": 600}, {"hot": 1, "sample": 1, "block": 900}, {"bits": 8, "block": 5000}])
def test_matches_brute_force(spark, docs, texts, more):
    unique = {}
    for i, t in texts:  # distinct texts of one id have no fixed order
        unique.setdefault(i, t)
    rows = [(i, t) for i, t in texts if unique[i] == t]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = suffix_dedup.summary(table, length=100, **more).collect()
    expected = brute(rows, 100)
    assert len(got) == len(rows)
    want = sorted((str(i), *expected[i, t or ""]) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert any(r.n_removed for r in got)


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_random_repeats(spark, block):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(20, 300))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 5))) + ("xy" * rng.randint(0, 120))) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = suffix_dedup.summary(table, length=100, block=block, hot=4, sample=2).collect()
    expected = brute(rows, 100)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {
        (i, *expected[i, t]) for i, t in rows
    }


def test_all_columns_are_kept(docs, no_docs):
    out = suffix_dedup.deduplicate(docs)
    assert out.columns == [c for c in docs.columns if c != "repeats"]
    assert out.count() == docs.count()
    assert suffix_dedup.deduplicate(no_docs).count() == 0
    assert suffix_dedup.summary(no_docs).count() == 0


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(TypeError, match="whole number"):
        suffix_dedup.summary(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_one_anchor_in_most_segments(spark):
    """A line that all documents share, with other words around it: its anchor is split, the result is exact."""
    rng = random.Random(12)
    line = "".join(rng.choice("abcdefgh ") for _ in range(70))
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, word(60) + line + word(60)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = suffix_dedup.summary(table, length=100, hot=16, sample=1, block=4000).collect()
    expected = brute(rows, 100)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {(i, *expected[i, t]) for i, t in rows}
