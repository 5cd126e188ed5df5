from __future__ import annotations

import re
from collections import defaultdict

import pytest

from echotide.llm import decontamination

ITEMS = "item_id bigint, text string, doc_id int"


def brute(texts, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    held = defaultdict(set)
    for item, text in items:
        w = word.findall(low(text))
        for k in range(max(1, len(w) - window + 1)) if w and item is not None else []:
            held[tuple(w[k : k + window])].add(str(item))
    out = []
    for doc, text in texts:
        found = list(word.finditer(low(text)))
        w = [m[0] for m in found]
        hit, ids = set(), set()
        for n in {len(p) for p in held}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in held:
                    ids |= held[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        starts = [k for k in sorted(hit) if k - 1 not in hit]
        spans = []
        for k in starts:
            end = k
            while end + 1 in hit:
                end += 1
            spans.append((found[k].start(), found[end].end()))
        out.append((doc, len(w), len(hit), tuple(sorted(ids)), tuple(spans)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(texts):
    by = dict(texts)
    cut = by[41].split(" ")
    return [
        (3, "".join(c.upper() if c.isascii() else c for c in " ".join(cut[20:40]))),
        (12, " ".join(cut[30:45])),
        (7, "the, SAME lines"),
        (8, None),
        (9, ""),
        (None, " ".join(cut[20:40])),
        (3, "ab ab ab ab ab ab ab ab ab"),
        (20, "漢字かな交じり文"),
    ]


def test_matches_brute_force(spark, docs, texts, items):
    table = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    got = decontamination.decontaminate(docs, table).collect()
    rows = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.end) for s in r.spans)) for r in got]
    assert sorted(rows, key=str) == brute(texts, items, 8)
    assert all(r.contaminated == (r.n_items >= 2) and r.n_items == len(r["items"]) for r in got)
    assert any(r.contaminated for r in got)


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], ITEMS)
    assert decontamination.decontaminate(no_docs, none).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.decontaminate(docs, none).collect())


def test_columns_go_along(spark, docs, items):
    table = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    got = decontamination.decontaminate(docs, table, keep=("doc_id", "text", "bucket", "digest"))
    assert sorted((str(r.doc_id), r.text, r.bucket) for r in got.collect() if r.text) == sorted(
        (str(r.doc_id), r.text, r.bucket) for r in docs.collect() if r.text
    )


def test_large_benchmark(spark):
    """Twenty million characters of patterns are one automaton and one scan of the documents."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(3300)]
    size = sum(len(" ".join(w)) for _, t in items for w in zip(*(t.split()[k:] for k in range(8)), strict=False))
    assert size > 20_000_000
    texts = [(i, f"clean words {' '.join(t.split()[i % 100 : i % 100 + 8 - i % 2])} and more") for i, t in items[:400]]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert {r.doc_id: list(r["items"]) for r in got.collect()} == {i: [str(i)] if i % 2 == 0 else [] for i, _ in texts}


def test_several_digits_a_word(texts, items, monkeypatch):
    """More words than digits: each takes several, and no match begins inside a word."""
    known = sorted((str(i), t) for i, t in items if i is not None and t is not None)
    one = decontamination.Patterns(known, 8)
    monkeypatch.setattr(decontamination, "_BASE", 3)
    more = decontamination.Patterns(known, 8)
    assert one.width == 1 and more.width > 2
    for _, text in texts:
        assert decontamination.scan(one, text) == decontamination.scan(more, text)
