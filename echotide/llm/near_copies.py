"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

Words are those of ``simhash``; every run of ``shingle`` words (the whole sequence, if it is shorter) is a 64-bit
gram, and texts without words share one gram.  Two texts are linked if their sets of grams agree in at least
``per_mille`` thousandths of their union; groups are the components of these links.

No radius of a SimHash is sure to reach a given similarity, so SimHash only proposes: its links, and links of each
text to one text, drawn for each of its first grams, that shares it, are checked and joined to components.  Then all pairs
that could still be similar and lie in different components are checked.  These follow from prefixes: with all
grams in one order, similar sets share one among the first n - ceil(t n) + 1 of each, and the first they share
leaves enough behind it.  So no link is missed, and a large group of copies is not compared pair by pair.  Where a gram
is met by texts of several components, they are held against each other in place, and only pairs that pass leave.

Defined results: as in ``simhash``; a null text is the empty text.

Scale: the order puts grams that a sample of the texts shows often last, so that common lines make few pairs; the
sample decides only the order, never the result.  Before sets are fetched, pairs are held against bitmaps, short ones and
then wide ones: the bits in which the parities of two sets differ are at most the grams in which the sets do.  Sets and
wide bitmaps are not kept, but made anew from the texts of the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from ._store import discard, materialise, portions, small_batches, trimmed

BITS, WIDE = 512, 8192
#: Parts that the texts of a component are dealt to when they are told its smallest id.
SALTS = 32


def _grams(text: str, shingle: int, seed: int):
    """A text's grams in order of value, as signed numbers, and the hashes of all its runs."""
    import numpy as np

    hashes = simhash.hashes_of(text, shingle, seed)
    some = hashes or simhash.hashes_of("-", shingle, ~seed % (1 << 64))
    return np.unique(np.array(some, "u8").view("i8")), hashes


def _parities(sets: list, bits: int):
    """Per set, of its grams by their lowest bits, which places hold an odd number; a row of bytes for each set."""
    import numpy as np

    out = np.zeros((len(sets), bits // 8), "u1")
    for k, s in enumerate(sets):
        out[k] = np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype("u1"))
    return out


def _lists(sets: list) -> pa.Array:
    import numpy as np

    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, "i8"), pa.int64()))


def texts_of(docs: DataFrame, text_col: str) -> DataFrame:
    """Per row: text (null as empty) and tie, its hash."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.withColumn("tie", F.xxhash64("text"))


def _sets(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Per row: tie and grams, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, "text")):
            found = [_grams(t, shingle, seed)[0] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("tie"), _lists(found)], ["tie", "grams"])

    return texts.mapInArrow(trimmed(run), "tie bigint, grams array<bigint>")


def _maps(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Per row: tie, size and map, the parities of the grams in ``WIDE`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, "text")):
            found = [_grams(t, shingle, seed)[0] for t in part.column("text").to_pylist()]
            maps = pa.array([m.tobytes() for m in _parities(found, WIDE)], pa.binary())
            sizes = pa.array([len(f) for f in found], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("tie"), sizes, maps], ["tie", "size", "map"])

    return texts.mapInArrow(trimmed(run), "tie bigint, size int, map binary")


def contents(texts: DataFrame, late: list[int], *, shingle: int, seed: int, per_mille: int) -> DataFrame:
    """Per row: tie, fingerprint, size, bits (the parities of the grams) and prefix, the first grams, those ``late`` last."""
    import numpy as np

    held = texts.sparkSession.sparkContext.broadcast(np.sort(np.array(late, "i8")))

    def first(grams):
        if len(held.value):
            at = np.minimum(np.searchsorted(held.value, grams), len(held.value) - 1)
            grams = grams[np.argsort(held.value[at] == grams, kind="stable")]
        return grams[: len(grams) - (len(grams) * per_mille + 999) // 1000 + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, "text")):
            found = [_grams(t, shingle, seed) for t in part.column("text").to_pylist()]
            sets = [g for g, _ in found]
            marks = pa.array([simhash._signed(simhash.majority(h)) for _, h in found], pa.int64())
            words = pa.array(_parities(sets, BITS).view("i8").ravel(), pa.int64())
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (BITS // 64), pa.int32()), words)
            sizes = pa.array([len(g) for g in sets], pa.int32())
            columns = [part.column("tie"), marks, sizes, bits, _lists([first(g) for g in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["tie", "fingerprint", "size", "bits", "prefix"])

    return texts.mapInArrow(trimmed(run), "tie bigint, fingerprint bigint, size int, bits array<bigint>, prefix array<bigint>")


def _of(known: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of ``known`` whose tie may be among the ``ends``: a bitmap of hashes leaves out most others unshuffled."""
    bits = min(1 << 26, max(1 << 15, 16 * ends.count()))
    place = F.pmod(F.xxhash64("tie"), F.lit(bits))
    group, at = F.floor(place / 32768), F.pmod(place, F.lit(32768)).cast("int")
    maps = ends.groupBy(group.alias("group")).agg(F.expr(f"bitmap_construct_agg(pmod(pmod(xxhash64(tie), {bits}L), 32768L))").alias("map"))
    byte = F.conv(F.hex(F.substring("map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
    near = known.withColumn("group", group).join(F.broadcast(maps), "group").where(held)
    return near.drop("group", "map")


def _meeting(per_mille: int):
    """From texts in order of gram: the pairs of one gram, of other components, that sizes, places and bitmaps let be similar."""
    import numpy as np

    names = ("gram", "p", "q", "tie", "root", "size", "place")

    def passed(held: dict, bits) -> pa.RecordBatch:
        found = []
        key = np.stack([held["gram"], held["p"], held["q"]])
        at, step = np.arange(len(held["gram"])), 0
        while len(at):  # pairs of rows that stand ``step`` apart, for all groups at once
            step += 1
            at = at[at + step < len(held["gram"])]
            at = at[(key[:, at] == key[:, at + step]).all(axis=0)]
            a, b = at, at + step
            left = np.minimum(held["size"][a] - held["place"][a], held["size"][b] - held["place"][b])
            both = held["size"][a] + held["size"][b]
            may = (held["root"][a] != held["root"][b]) & (left * (1000 + per_mille) >= both * per_mille)
            a, b, both = a[may], b[may], both[may]
            differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            may = differ * (1000 + per_mille) <= both * (1000 - per_mille)
            found.append(np.stack([held["tie"][a[may]], held["tie"][b[may]]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        pairs = np.unique(np.sort(pairs, axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict | None = None
        words = np.zeros((0, BITS // 64), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names}
            bits = batch.column("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITS // 64)
            if kept is not None:
                now = {n: np.concatenate([kept[n], now[n]]) for n in names}
                bits = np.concatenate([words, bits])
            key = np.stack([now["gram"], now["p"], now["q"]])
            cut = int(np.flatnonzero((key == key[:, -1:]).all(axis=0))[0])  # the last group may go on
            yield passed({n: now[n][:cut] for n in names}, bits[:cut])
            kept, words = {n: now[n][cut:] for n in names}, bits[cut:]
        if kept is not None:
            yield passed(kept, words)

    return run


def _met_pairs(rooted: DataFrame, small: DataFrame, per_mille: int, group: int) -> DataFrame:
    """The pairs left to be checked.  A gram of more than ``group`` texts is dealt to tasks by pairs of its pieces."""
    sizes = rooted.groupBy(F.col("gram").alias("of")).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > group).select("of", F.ceil(F.col("n") / group).cast("int").alias("pieces"))
    rows = rooted.join(large, F.col("gram") == F.col("of"), "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    rows = rows.join(small.select(F.col("tie").alias("t"), "bits"), F.col("tie") == F.col("t"))
    own = F.pmod(F.xxhash64("tie"), F.col("pieces")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    dealt = rows.select("gram", "p", "q", "tie", "root", "size", "place", "bits").repartition("gram", "p", "q")
    return dealt.sortWithinPartitions("gram", "p", "q").mapInArrow(trimmed(_meeting(per_mille)), "a bigint, b bigint").distinct()


def _end(rows: DataFrame, c: str) -> DataFrame:
    return rows.select(F.col("tie").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in rows.columns if x != "tie"])


def _near(pairs: DataFrame, small: DataFrame, per_mille: int) -> DataFrame:
    """Of the pairs (a, b) of texts, those that bitmaps let be similar."""
    marked = pairs.join(_end(small, "a"), "a").join(_end(small, "b"), "b")
    differ = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    marked = marked.where(differ * (1000 + per_mille) <= (F.col("size_a") + F.col("size_b")) * (1000 - per_mille))
    return marked.select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("tie")).union(pairs.select("b")).distinct()


def _nearer(pairs: DataFrame, texts: DataFrame, shingle: int, seed: int, per_mille: int) -> DataFrame:
    """Of the pairs (a, b) of texts, those that wide bitmaps let be similar; these hold for long texts too."""
    maps = _maps(_of(texts, _ends(pairs)), shingle, seed).dropDuplicates(["tie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u8").reshape(-1, WIDE // 64) for c in ("map_a", "map_b"))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            both = batch.column("size_a").to_numpy().astype("i8") + batch.column("size_b").to_numpy()
            may = pa.array(differ * (1000 + per_mille) <= both * (1000 - per_mille))
            yield batch.select(["a", "b"]).filter(may)

    joined = pairs.join(_end(maps, "a"), "a").join(_end(maps, "b"), "b")
    return joined.select("a", "b", "size_a", "size_b", "map_a", "map_b").mapInArrow(trimmed(run), "a bigint, b bigint")


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, seed: int, per_mille: int) -> DataFrame:
    """Of the pairs (a, b) of texts, those that are similar."""
    some = materialise(pairs, "pairs")
    left = materialise(_nearer(some, texts, shingle, seed, per_mille), "pairs")
    sets = _sets(_of(texts, _ends(left)), shingle, seed).dropDuplicates(["tie"])
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - common
    both = left.join(_end(sets, "a"), "a").join(_end(sets, "b"), "b")
    found = materialise(both.where(common * 1000 >= union * per_mille).select("a", "b"), "links")
    discard(some)
    discard(left)
    return found


def _may(size_a: Column, size_b: Column, per_mille: int) -> Column:
    return F.least(size_a, size_b) * 1000 >= F.greatest(size_a, size_b) * per_mille


def links(
    texts: DataFrame, *, shingle: int, seed: int, per_mille: int, radius: int, shard_size: int, sample: int, often: int, group: int
) -> DataFrame:
    """Edges (a, b) of similar texts, by tie, that connect all similar texts."""
    check = lambda pairs: _similar(pairs, texts, shingle, seed, per_mille)
    seen = _sets(texts.where(F.pmod("tie", F.lit(sample)) == 0), shingle, seed)
    seen = seen.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    late = [r["gram"] for r in seen.where("count >= 8").orderBy(F.desc("count")).limit(often).collect()]
    known = materialise(contents(texts, late, shingle=shingle, seed=seed, per_mille=per_mille), "contents")
    bounds = known.select("tie", "size", F.posexplode("prefix").alias("place", "gram"))
    of_gram = Window.partitionBy("gram")
    centre = F.min(F.struct(F.xxhash64("tie", "gram").alias("draw"), "tie", "size")).over(of_gram)
    ends = [F.min("tie").over(of_gram).alias("y"), F.max("tie").over(of_gram).alias("z")]
    met = bounds.select("*", centre["tie"].alias("a"), centre["size"].alias("size_a"), *ends)
    met = materialise(met.where("y <> z").drop("y", "z").dropDuplicates(["gram", "tie"]), "prefixes")
    small = materialise(known.select("tie", "size", "bits", "fingerprint").dropDuplicates(["tie"]), "texts")
    stars = met.where("tie <> a").where(_may(F.col("size"), F.col("size_a"), per_mille)).select("a", F.col("tie").alias("b"))
    marks = small.groupBy("fingerprint").agg(F.min("tie").alias("least"))
    marks = materialise(marks, "fingerprints")
    alike = simhash.links(marks, radius, shard_size)
    end = lambda c: marks.select(F.col("fingerprint").alias(c), F.col("least").alias(f"least_{c}"))
    alike = alike.join(end("a"), "a").join(end("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    equal = small.select("fingerprint", "tie").join(marks, "fingerprint").where("tie <> least")
    proposed = stars.unionByName(alike).unionByName(equal.select(F.col("least").alias("a"), F.col("tie").alias("b")))
    proposed = proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    small = small.drop("fingerprint")
    first = check(_near(proposed, small, per_mille))
    roots = simhash.components(first).withColumnRenamed("node", "tie")
    rooted = met.select("gram", "tie", "size", "place").join(roots, "tie", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "tie"))
    mixed = rooted.groupBy("gram").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("gram")
    rooted = materialise(rooted.join(mixed, "gram"), "rooted")
    found = first.unionByName(check(_met_pairs(rooted, small, per_mille, group)))
    discard(known)
    discard(met)
    discard(rooted)
    return found


def near_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    per_mille: int = 800,
    seed: int = 42,
    radius: int = 2,
    shard_size: int = 4096,
    sample: int = 16,
    often: int = 100_000,
    group: int = 4096,
) -> DataFrame:
    """Per row: doc_id, component_id, the smallest doc_id reachable by links, and tie, a hash of the text."""
    small_batches(docs.sparkSession)
    edges = links(
        texts_of(docs, text_col), shingle=shingle, seed=seed, per_mille=per_mille, radius=radius, shard_size=shard_size,
        sample=sample, often=often, group=group,
    )
    roots = materialise(simhash.components(edges), "roots")
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), tie.alias("tie"))
    least = materialise(rows.groupBy("tie").agg(F.min("doc_id").alias("least")), "least")
    # of each component the smallest id, over its texts and its root; told to the texts by salted keys, as one component
    # may have very many
    linked = roots.union(roots.select("root", "root").distinct()).toDF("t", "root").join(least, F.col("t") == F.col("tie"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    spread = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = linked.select("t", "root", F.pmod("t", F.lit(SALTS)).cast("int").alias("salt"))
    named = salted.join(spread, ["root", "salt"]).select(F.col("t").alias("tie"), "component_id")
    every = least.join(named, "tie", "left").select("tie", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(every, "tie").select("doc_id", "component_id", "tie")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """All columns of one row of each component, as in ``simhash.keep_first``."""
    groups = materialise(near_copies(docs, id_col=id_col, text_col=text_col, **settings), "components")
    return simhash.first_of(docs, groups, id_col=id_col, text_col=text_col)
