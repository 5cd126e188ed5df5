"""SimHash near-duplicates: fingerprints linked within a Hamming radius by BK-trees.

Texts are lower-cased in A-Z and cut into words at white space; every run of
``shingle`` words, repeats included (the whole sequence, if it is shorter), is
hashed with XXH64.  A fingerprint bit is 1 if it is set in over half the hashes;
a text without words has fingerprint zero.

Search runs over distinct fingerprints, each with the smallest doc_id that has
it.  The 64 bits are cut into radius+2 blocks: two fingerprints within the radius
agree on at least two of them.  A shard is one pair of blocks and its value; each
shard builds a BK-tree, whose children are keyed by their distance to the parent,
and a search follows only the edges within the radius of its own distance.  The
links found in a shard are reduced to a spanning forest before they leave it.
Trees are not broadcast: all trees together grow with the corpus, and every
fingerprint would have to ask every one of them (figures in the README), so
fingerprints travel to the shards that may hold a neighbour.  Components follow
from alternating large-star and small-star steps over the forests' edges.

Defined results: a null text is the empty text; rows that repeat an id are linked
by their own fingerprints; a row with a null id belongs to the component of its
fingerprint, which has a null id if no row of it has one; an empty table gives an
empty table; other columns are ignored.

Scale: equal fingerprints collapse before any search, whatever the size of their
group.  A shard of more than ``shard_size`` members is split by further bits: what
it leaves free is cut into radius+1 blocks, and two members within the radius agree
on at least one of them, so each member goes to radius+1 smaller shards, again and
again until they fit or too few bits are free to matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialise, small_batches

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def hashes_of(text: str | None, shingle: int = 3, seed: int = 42) -> list[int]:
    """The hashes of a text's runs of words, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), seed)]
    runs = zip(*(words[i:] for i in range(shingle)), strict=False)
    return [digest(b" ".join(run), seed) for run in runs]


def majority(hashes: list[int]) -> int:
    """The bits set in over half the hashes."""
    import numpy as np

    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    return majority(hashes_of(text, shingle, seed))


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """Per row: doc_id, fingerprint (the 64 bits as a signed long) and tie, a hash of the text."""
    small_batches(docs.sparkSession)
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_of(t, shingle, seed) for t in batch.column("text").to_pylist()]
            signed = pa.array([f - (f >> 63 << 64) for f in found], pa.int64())
            out = {"doc_id": batch.column("doc_id"), "fingerprint": signed, "tie": batch.column("tie")}
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint bigint, tie bigint")


class BKTree:
    """Integers under Hamming distance; a child's key is its distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        at = self.root
        while d := (at[0] ^ value).bit_count():
            if d not in at[1]:
                at[1][d] = (value, {})
                return
            at = at[1][d]

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            held, children = todo.pop()
            d = (held ^ value).bit_count()
            if d <= radius:
                found.append(held)
            for key in range(max(1, d - radius), d + radius + 1):
                if key in children:
                    todo.append(children[key])
        return found


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(members: list[int], queries: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Edges that connect whatever ``queries`` and ``members`` are linked; at most one for each."""
    tree = BKTree()
    for m in members:
        tree.add(m)
    parent = {x: x for x in (*members, *queries)}
    for q in queries:
        for m in tree.within(q, radius):
            a, b = _root(parent, q), _root(parent, m)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield q, m


def _masks(radius: int) -> list[int]:
    """One mask for each pair of the radius+2 blocks of 64 bits."""
    n = radius + 2
    edge = [64 * i // n for i in range(n + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(n)]
    return [a | b for a, b in itertools.combinations(block, 2)]


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _finer(mask: int, radius: int) -> list[int]:
    """The masks that add to ``mask`` one of radius+1 blocks of the bits it leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    edge = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << i for i in free[a:z]) for a, z in zip(edge[:-1], edge[1:], strict=True)]


def _dealt(rows: DataFrame, masks: Column) -> DataFrame:
    """Each fingerprint in the shard of each of its masks: mask, value and fingerprint."""
    dealt = rows.select("fingerprint", F.explode(masks).alias("mask"))
    return dealt.select("mask", F.col("mask").bitwiseAND(F.col("fingerprint")).alias("value"), "fingerprint")


def links(distinct: DataFrame, radius: int, shard_size: int) -> DataFrame:
    """Edges (a, b) of fingerprints that connect all those within the radius of each other."""
    masks = _masks(radius)
    dealt = _dealt(distinct, F.array(*[F.lit(_signed(m)) for m in masks]))
    found: DataFrame | None = None
    while True:
        free = 64 - min(m.bit_count() for m in masks)
        small = 1 << free <= shard_size or len(masks) > 486  # four times finer leaves some six bits free
        sizes = materialise(dealt.groupBy("mask", "value").agg(F.count("*").alias("size")).where("size > 1"), "shards")
        large = sizes.where(F.col("size") > shard_size)
        last = small or large.isEmpty()
        members = dealt.join(sizes if last else sizes.where(F.col("size") <= shard_size), ["mask", "value"])
        edges = _searched(members.select("mask", "value", "fingerprint"), radius)
        if last:
            return edges if found is None else found.unionByName(edges)
        edges = materialise(edges, "edges")
        found = edges if found is None else found.unionByName(edges)
        finer = F.create_map(*[F.lit(x) for m in masks for x in (_signed(m), [_signed(f) for f in _finer(m, radius)])])
        rows = dealt.join(large, ["mask", "value"]).select("fingerprint", "mask")
        dealt = materialise(_dealt(rows, F.get(F.array(finer[F.col("mask")]), F.lit(0))).distinct(), "dealt")
        masks = sorted({f for m in masks for f in _finer(m, radius)})


def _searched(members: DataFrame, radius: int) -> DataFrame:
    """A forest of each shard's links."""
    names = ("mask", "value", "fingerprint")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
        for _, group in itertools.groupby(rows, key=lambda r: r[:2]):
            held = sorted(f % (1 << 64) for *_, f in group)
            found = list(forest(held, held, radius))
            if found:
                a, b = ([_signed(x) for x in side] for side in zip(*found, strict=True))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(search, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable, itself left out."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while mark != (mark := now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialise(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    seed: int = 42,
    radius: int = 2,
    shard_size: int = 4096,
) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable by links, and tie."""
    rows = materialise(
        fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "fingerprints"
    )
    distinct = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(distinct, radius, shard_size))
    rooted = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("fingerprint").alias("known"), "component_id")
    return rows.join(named, rows.fingerprint == named.known).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "tie"
    )


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """All columns of one row of each component, that with the smallest id.

    Of rows equal in id and text one stays.  Rows without an id go if their component has one; else they all stay, but
    for equal texts.
    """
    groups = materialise(near_duplicates(docs, id_col=id_col, text_col=text_col, **settings), "components")
    return first_of(docs, groups, id_col=id_col, text_col=text_col)


#: Rows of 16 bytes or little more that are broadcast at most: some 3 MB.
FEW = 200_000


def first_of(docs: DataFrame, groups: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep_first`` by ``groups``: per row doc_id, component_id and tie.

    Rows to drop are broadcast while they are few; beyond, they are met in a shuffle.
    """
    known = F.col("component_id").isNotNull()
    gone = groups.where(known & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).distinct()
    gone = materialise(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    left = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (tie == F.col("__tie")), "left_anti")
    stay = groups.where(~known | F.col("doc_id").eqNullSafe(F.col("component_id")))
    if stay.groupBy("doc_id", "tie").count().where("count > 1").isEmpty():
        return left
    return left.withColumn("__tie", tie).dropDuplicates([id_col, "__tie"]).drop("__tie")
