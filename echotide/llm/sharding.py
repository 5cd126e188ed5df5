"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0 to N-1 in an order that depends on their values alone.  A
keyed Feistel network permutes the numbers of a slightly larger rectangle; where
it leads beyond N-1 it is applied again (cycle walking), so it is a bijection of
0 to N-1.  The permuted number p gives shard ``p mod shards`` and slot
``p div shards``: shard sizes differ by one at most, slots have no gaps, and
both follow from the row number.

Defined results: rows equal in id, size and checksum are interchanged freely; a
null text has no bytes and a null checksum counts as that of the empty text; a
null id is numbered like any other value; an empty table gives an empty table;
other columns are ignored.

Scale: only id, size and checksum are shuffled.  Rows are hashed into buckets,
numbered within their bucket and offset by the summed counts of the buckets
before theirs, so no task sorts more than its buckets; the one ordered pass is
over ``buckets`` sums.  All expressions are native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
#: A walk leaves the rectangle's surplus, under a square root of it, with each step; this many never were needed.
WALKS = 24


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def feistel(number: Column, left: Column, right: Column, key: int, rounds: int = ROUNDS) -> Column:
    """Permutes 0 to left*right-1 by a network that alters both residues in turn."""

    def turn(half: Column, t: Column) -> Column:
        mixed = lambda x, m: F.pmod(F.xxhash64(x, F.lit(key), t), m)
        a, b = half["a"], half["b"]
        even = t % 2 == 0
        return F.struct(
            F.when(even, F.pmod(a + mixed(b, left), left)).otherwise(a).alias("a"),
            F.when(even, b).otherwise(F.pmod(b + mixed(a, right), right)).alias("b"),
        )

    start = F.struct(_div(number, right).alias("a"), F.pmod(number, right).alias("b"))
    turns = F.array(*[F.lit(t) for t in range(rounds)])
    return F.aggregate(turns, start, turn, lambda h: h["a"] * right + h["b"])


def permuted(number: Column, total: Column, key: int = 0, rounds: int = ROUNDS, walks: int = WALKS) -> Column:
    """Permutes 0 to total-1; raises an error should a walk not end within ``walks`` steps."""
    left = F.greatest(F.ceil(F.sqrt(total.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    right = _div(total + left - 1, left)
    step = lambda x: feistel(x, left, right, key, rounds)
    walk = F.aggregate(
        F.array(*[F.lit(i) for i in range(walks)]),
        step(number),
        lambda x, _: F.when(x >= total, step(x)).otherwise(x),
    )
    return F.when(walk < total, walk).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))


def number_rows(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Adds ``row_number`` (0 to N-1, by values of ``keys`` alone) and ``total`` (N)."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = sums.select(
        "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    at = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)).cast("bigint")
    numbered = dealt.withColumn("within", at).join(offsets, "bucket")
    return numbered.withColumn("row_number", F.col("offset") + F.col("within") - 1).drop("bucket", "within", "offset")


def shard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    key: int = 20240501,
    buckets: int = 8192,
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, row_number, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
    )
    dealt = number_rows(rows, ["doc_id", "size", "text_crc32"], buckets)
    place = dealt.withColumn("place", permuted(F.col("row_number"), F.col("total"), key))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        _div(F.col("place"), F.lit(shards)).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
