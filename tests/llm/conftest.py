from __future__ import annotations

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, digest string, doc int, tie int, repeats string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeioustrnlé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Ids and texts: null, empty, blank, long, repeated, near copies, shared passages, odd characters."""
    rng = random.Random(11)
    passage = words(rng, 60)
    base = words(rng, 120)
    rows = [(i, words(rng, rng.randint(1, 90))) for i in range(10, 40)]
    rows += [(40 + i, f"{words(rng, 15)} {passage} {words(rng, 10)}") for i in range(6)]
    near = base.split(" ")
    near[60] = "changed"
    rows += [(50, base), (51, base), (52, " ".join(near)), (53, base + " x")]
    rows += [(60, None), (61, ""), (62, "   \n\t "), (63, "漢字かな交じり文 \U0001f600 ▁▁ <s> \u0000 é"), (64, "ab " * 3000)]
    rows += [(65, words(rng, 9000)), (66, "."), (50, base), (67, "the same\nlines\nthe same"), (68, "lines\nthe same\nthe same")]
    rows += [(None, words(rng, 30)), (None, None), (-5, passage)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with further columns, nulls among them, named like those that operators use inside."""
    rows = [(i, t, None if k % 3 else "en", None if k % 4 else "s", None, k, None, k, None, "r") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
