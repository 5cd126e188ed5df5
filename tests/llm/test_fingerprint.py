from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from echotide.llm import fingerprint


def lanes(spark, text):
    return F.array(*[F.lit(x) for x in spark.range(1).select(fingerprint.vector(fingerprint.paragraph_roots(F.lit(text))).alias("v")).first().v])


def test_order_and_moves(spark):
    one = spark.range(1)
    vec = lambda t: fingerprint.vector(fingerprint.paragraph_roots(F.lit(t)))
    got = one.select(
        (vec("a\nb\na") == vec("b\na\na")).alias("order"),
        (vec("a\nb") == vec("a\nb\nb")).alias("times"),
        (fingerprint.inserted(vec("a\nb"), F.lit("c\na")) == vec("a\na\nb\nc")).alias("plus"),
        (fingerprint.deleted(vec("a\nb\nc"), F.lit("b")) == vec("c\na")).alias("minus"),
        fingerprint.likeness(vec("a\nb\nc"), vec("c\nb\na")).alias("same"),
        fingerprint.likeness(vec("a\nb\nc\nd"), vec("a\nb\nc\nz")).alias("near"),
        fingerprint.likeness(vec("a\nb\nc"), vec("x\ny\nz")).alias("far"),
    ).first()
    assert got.order and not got.times and got.plus and got.minus
    assert got.same == 1.0 and got.near > 0.4 and got.far < 0.2


@pytest.mark.parametrize("range_rows", [1000, 1])
def test_edited_texts(docs, texts, range_rows):
    got = fingerprint.compare_edited(docs, range_rows=range_rows).collect()
    rows = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        expected.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(expected)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_small_tables(spark, no_docs):
    assert fingerprint.compare_edited(no_docs).count() == 0
    one = spark.createDataFrame([(None, "ab")], "doc_id bigint, text string")
    assert fingerprint.compare_edited(one).first().edited_sha256 == hashlib.sha256(b"aa").hexdigest()


@pytest.mark.parametrize("n", [10, 60, 150, 700, 3000])
def test_likeness_does_not_sink_with_length(spark, n):
    text = lambda a, z: "\n".join(f"paragraph {k}" for k in range(a, z))
    rows = [(text(0, 2 * n), text(n // 2, 2 * n + n // 2), "part"), (text(0, n), text(n, 2 * n), "none"), (text(0, n), text(0, n), "all")]
    vec = lambda c: fingerprint.vector(fingerprint.paragraph_roots(F.col(c)))
    table = spark.createDataFrame(rows, "a string, b string, what string").select("what", vec("a").alias("a"), vec("b").alias("b"))
    got = {r.what: r.near for r in table.select("what", fingerprint.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    assert abs(got["part"] - 0.6) < 0.2 and got["none"] < 0.1 and got["all"] == 1.0


def test_vectors_equal_a_loop(spark):
    """Every lane against sums made one paragraph at a time."""
    import xxhash

    signed = lambda x: x - (x >> 63 << 64)
    text = "a\nb\nb\n\nlast one é"
    got = spark.range(1).select(fingerprint.vector(fingerprint.paragraph_roots(F.lit(text))).alias("v")).first().v
    least = 4 ** (fingerprint.GROUPS - 1)
    dense = [[0, 0, 0] for _ in range(fingerprint.DENSE)]
    sparse = [[0] * fingerprint.SPARSE for _ in range(fingerprint.GROUPS)]
    for p in text.split("\n"):
        root = hashlib.sha256(p.encode()).hexdigest()
        inner = xxhash.xxh64_intdigest(root.encode(), 42)  # Spark chains: the hash so far is the next one's seed

        def draw(salt, inner=inner):
            return xxhash.xxh64_intdigest(salt.to_bytes(4, "little"), inner)

        for i in range(fingerprint.DENSE):
            for k in range(3):
                dense[i][k] = (dense[i][k] + (draw(i) >> 21 * k)) % (1 << 20)
        lane, value, rank = (signed(draw(fingerprint.DENSE + j)) for j in range(3))
        for g in range(fingerprint.GROUPS):
            if rank % least < least >> 2 * g:
                at = lane % fingerprint.SPARSE
                sparse[g][at] = (sparse[g][at] + value % ((1 << 16) - 1) + 1) % (1 << 16)
    assert got[: fingerprint.DENSE] == [a + (b << 21) + (c << 42) for a, b, c in dense]
    assert got[fingerprint.DENSE :] == [x for group in sparse for x in group]


def test_rows_match_fingerprints_of_their_texts(docs, texts):
    """Fingerprints and likeness of each row against those of its own text, taken alone."""
    alone = fingerprint.fingerprints(docs).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), fingerprint.as_hex(F.col("lanes")).alias("f"))
    want = {(str(r.doc_id), r.f) for r in alone.collect()}
    got = fingerprint.compare_edited(docs).collect()
    assert {(str(r.doc_id), r.fingerprint) for r in got} == want and len(got) == len(texts)
    assert all(r.near_edited == 1.0 for r in got if r.fingerprint == r.edited_fingerprint)


def test_native_and_long(spark):
    """No Python workers; a text of megabytes and ids of another type."""
    rows = [("b", "x\n" * 500_000), ("a", "y" * 3_000_000), (None, "z"), ("b", "x\n" * 500_000)]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    result = fingerprint.compare_edited(table)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in result.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    b, a = rows[0][1], rows[1][1]
    assert got == {
        ("b", 1_000_000, sha(b)),
        ("b", 1_000_000, sha(b[:500_000] + a[:500_000])),
        ("a", 3_000_000, sha(a[:1_500_000] + "z")),
        (None, 1, sha("z")),
    }
