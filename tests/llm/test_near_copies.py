from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from echotide.llm import near_copies  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def grams(text, shingle=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))}


def brute(rows):
    """The rows kept: the smallest id of each component of Jaccard links of 0.8 or more."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(min(i for (i, _), r in zip(rows, root, strict=True) if r == c) for c in set(root))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = [word() for _ in range(12)]
    texts = []
    for n in (1, 3, 6, 12, 40, 120, 300, 700):
        for _ in range(3):
            base = [word() for _ in range(n)]
            texts.append(base)
            for edits in (1, 2, 3, 5, 9, 14):
                t = list(base)
                for _ in range(edits * n // 300 + 1):
                    t[rng.randrange(n)] = word()
                texts.append(t + line if edits == 5 else t[: n - n // 9] if edits == 9 else t)
    texts += [[], []]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_keeps_what_brute_force_keeps(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute(rows)


def test_order_of_grams_never_decides(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(r.doc_id for r in near_copies.keep_first(docs, sample=1, often=50).collect())
    assert got == brute(rows)


def test_large_grams_are_dealt_by_pieces(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(r.doc_id for r in near_copies.keep_first(docs, group=3).collect())
    assert got == brute(rows)


def test_null_ids_and_empty(spark, no_docs, texts):
    assert near_copies.keep_first(no_docs).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, None), (None, ""), (5, "c")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in near_copies.keep_first(rows).collect()), key=str)
    assert got == sorted([(None, "a b"), (4, None), (5, "c")], key=str)
