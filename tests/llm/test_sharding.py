from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from echotide.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 1023])
def test_permutation(spark, n):
    row = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("bigint"), 7).alias("p"))
    assert sorted(r.p for r in row.collect()) == list(range(n))


def test_law(docs, texts):
    got = sharding.shard(docs, shards=4, buckets=8).collect()
    assert len(got) == len(texts)
    sizes = [sum(r.shard == k for r in got) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    expected = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == expected


def test_does_not_depend_on_partitions(docs):
    pick = lambda d: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in sharding.shard(d).collect())
    assert pick(docs) == pick(docs.repartition(7))


def test_empty(no_docs):
    assert sharding.shard(no_docs).count() == 0


def chained(*values: tuple[int, int]) -> int:
    """Spark's hash of integers, each (value, bytes): the hash so far is the next one's seed."""
    import xxhash

    h = 42
    for v, size in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), h)
    return h - (h >> 63 << 64)


def test_places_equal_a_loop(spark):
    """Row numbers, the network and its walks, one row at a time in Python."""
    import math
    import zlib

    key, buckets, shards = 77, 5, 4
    texts = [(7 * k - 3, "é" * (k % 5) + "x" * (k % 11)) for k in range(61)]
    rows = [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts]
    bucket = lambda r: chained(*[(v, 8) for v in r]) % buckets
    order = sorted(rows, key=lambda r: (bucket(r), r))
    left = math.ceil(math.sqrt(len(rows)))
    right = -(-len(rows) // left)

    def step(x):
        a, b = divmod(x, right)
        for t in range(sharding.ROUNDS):
            if t % 2 == 0:
                a = (a + chained((b, 8), (key, 4), (t, 4)) % left) % left
            else:
                b = (b + chained((a, 8), (key, 4), (t, 4)) % right) % right
        return a * right + b

    want = set()
    for number, (i, size, crc) in enumerate(order):
        at = step(number)
        while at >= len(rows):
            at = step(at)
        want.add((i, size, crc, at % shards, at // shards))
    table = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = sharding.shard(table, shards=shards, key=key, buckets=buckets).collect()
    assert {(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got} == want


def test_long_texts(spark):
    """Texts of megabytes, near a batch's size and over it."""
    table = spark.createDataFrame([(k, "é" * (1 << 20 + k)) for k in range(3)], "doc_id bigint, text string")
    got = {r.doc_id: r["size"] for r in sharding.shard(table, shards=2).collect()}
    assert got == {k: 2 * (1 << 20 + k) + 1 for k in range(3)}
