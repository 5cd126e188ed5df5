"""What Python workers hold: little beside a batch, and nothing that grows with the texts met."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest

from echotide.llm import _store as store


def test_portions_hold_all_rows_in_order():
    texts = ["a" * 30, None, "", "é" * 40, "b", None, "c" * 500, "d"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": texts}).slice(1)
    parts = list(store.portions(batch, "text", 50))
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()
    assert [p.num_rows for p in parts] == [3, 3, 1]  # each ends with the row that fills it
    assert [p.num_rows for p in store.portions(batch.slice(0, 0), "text", 50)] == [0]


def test_trimmed_gives_memory_back_after_each_task(monkeypatch):
    given = []
    monkeypatch.setattr(store, "give_back", lambda: given.append(1))
    assert list(store.trimmed(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]
    assert given == [1]
    left = store.trimmed(lambda batches: batches)(iter([1, 2]))
    next(left)
    left.close()  # a task that reads no further
    assert given == [1, 1]


@pytest.fixture(scope="module")
def model():
    pytest.importorskip("ahocorasick")
    from echotide.llm import sentencepiece_bpe

    return sentencepiece_bpe.read_model(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))


def test_common_units_outlast_rare_ones(model):
    from echotide.llm import sentencepiece_bpe

    codec = sentencepiece_bpe.Codec(model, keep=50, pairs=100)
    asked: list[str] = []
    ids = codec.ids
    codec.ids = lambda unit: asked.append(unit) or ids(unit)
    for k in range(1000):
        codec.both(f"the w{k}q")
        assert len(codec) + len(codec.older) <= 100
        assert len(codec.fits) <= 100
    assert asked.count(f"{sentencepiece_bpe.MARK}the") == 1


@pytest.mark.parametrize("digests", [False, True])
def test_encoding_a_batch_takes_little_memory(model, digests):
    from echotide.llm import sentencepiece_bpe

    rng = random.Random(3)
    known = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(known, k=600)) for _ in range(1200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    codec = sentencepiece_bpe.Codec(model)
    expected = [codec.both(t) for t in texts[:5]]  # the units are known from here on
    run = sentencepiece_bpe._encoder(lambda: codec, ("ids", "decoded"), digests)
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    rows, largest, first = 0, 0, []
    for part in run(iter([batch])):
        rows += part.num_rows
        largest = max(largest, tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before)
        first = first or part.to_pylist()[:5]
    tracemalloc.stop()
    assert rows == len(texts)
    assert largest < 24_000_000  # the ids of all rows alone, as lists of numbers, take more
    assert [r["n_tokens"] for r in first] == [n for n, _, _ in expected]
    if not digests:
        assert [(",".join(map(str, r["ids"])), r["decoded"]) for r in first] == [e[1:] for e in expected]
