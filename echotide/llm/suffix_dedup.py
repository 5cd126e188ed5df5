"""Removal of repeated byte strings, exact over the whole corpus, by suffix arrays.

A byte goes if a string of ``length`` bytes covers it that also starts earlier:
in a document with a smaller id, or further left in the same one.  Strings never
cross documents and are judged on the input.

Search.  Every string of ``length`` bytes has one anchor, the leftmost of its
``gram``-byte pieces with the smallest hash.  Strings that follow one another and
share their anchor make up a segment, so equal strings lie in segments with equal
anchors, at the same distance from them.  Of segments that are equal as a whole (in
a 128-bit digest of their bytes) all but the first are repeats throughout, and they
collapse, first within a batch.  What is left of anchors with several different
segments goes through suffix arrays: the segments of many anchors are put together
to blocks of about ``block`` bytes, a suffix array of a block brings equal strings
side by side, and in each run of equal strings all but the first are repeats.
Anchors whose hashes (of ``bits`` bits) collide are only searched together.

Anchors with many different segments (counted on a sample of documents; it decides
only how work is dealt out) are spread over parts of about ``hot`` segments, and
groups that outgrow a block are cut.  The first strings of each part are then
compared across parts by a 128-bit digest, pre-aggregated.

Defined results: a null text is empty; a text shorter than ``length`` bytes loses
nothing; rows that are equal in id and text are one document and are marked
alike; rows equal in id alone come in order of a hash of their texts; a null id
comes after all others; ids are whole numbers, and other types are refused; an
empty table gives an empty table.  Other columns are kept; if they have the name of
a column that is added, the added one replaces them.

Scale: one shuffle of about one short row for every 37 bytes of text, one of the
texts that have such segments, and one of all texts for the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._store import materialise, small_batches, trimmed
from .suffix_array import suffix_array

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


class Hashes:
    """Hashes of all pieces of a fixed length of a byte string."""

    def __init__(self, bits: int = 64, seed: int = 5):
        self.shift = _U(64 - bits)
        self.codes = np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) <= n:
            n = 2 * n + 1024
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(32))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._reach(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=total[1:], dtype=np.uint64)
        return total

    def pieces(self, total: np.ndarray, n: int) -> np.ndarray:
        return self.mixed((total[n:] - total[:-n]) * self.inverses[: len(total) - n]) >> self.shift


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def segments(data: bytes, length: int, gram: int, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """Per segment: hash of its anchor, the halves of a digest of all of it, its start and its end."""
    if len(data) < length:
        nothing = np.zeros(0, np.int64)
        return nothing.astype(np.uint64), nothing.astype(np.uint64), nothing.astype(np.uint64), nothing, nothing
    total = hashes.sums(np.frombuffer(data, np.uint8))
    width = length - gram + 1
    grams = hashes.pieces(total, gram)
    least = sliding_min(grams, width)
    # equal neighbours in ``least`` may still be two anchors with equal grams: the leftmost one leaves first
    change = np.flatnonzero((least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])) + 1
    start = np.concatenate([[0], change])
    end = np.concatenate([change, [len(least)]]) - 1 + length
    digest = xxhash.xxh3_128_digest
    said = b"".join([digest(data[a:z]) for a, z in zip(start.tolist(), end.tolist(), strict=True)])
    halves = np.frombuffer(said, np.uint64).reshape(-1, 2)
    return least[start], halves[:, 0], halves[:, 1], start, end


def union(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals, ordered by owner and start, with those of one owner that touch made one."""
    if not len(starts):
        return owner, starts, ends
    wide = np.int64(max(int(ends.max()), 0) + 1)
    reach = np.maximum.accumulate(ends + owner * wide) - owner * wide
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    return owner[heads], starts[heads], reach[np.append(heads[1:], len(starts)) - 1]


def _signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


_FOUND = "kind int, key bigint, seg bigint, more bigint, doc bigint, tie bigint, start int, end int"


def _batch(names: tuple[str, ...], *columns) -> pa.RecordBatch:
    """Columns by name; a number stands for a column of it."""
    n = max(len(c) for c in columns if not np.isscalar(c))
    kinds = [pa.int32() if name in ("kind", "start", "end") else pa.int64() for name in names]
    arrays = [pa.array(np.full(n, c) if np.isscalar(c) else c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(names))


_NAMES = ("kind", "key", "seg", "more", "doc", "tie", "start", "end")


def _searcher(length: int, gram: int, bits: int = 64, gather: int = 8 << 20):
    """Segments of texts (kind 0); of equal ones in a batch only the first, the others as repeats (kind 1)."""

    def flush(held: list[tuple[int, int, bytes]], hashes: Hashes) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda d: d[:2])
        parts = [segments(data, length, gram, hashes) for _, _, data in held]
        counts = [len(p[0]) for p in parts]
        if not sum(counts):
            return
        key, seg, more, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.repeat(np.arange(len(held)), counts)
        by = np.argsort(seg, kind="stable")
        now, before = by[1:], by[:-1]
        again = np.zeros(len(by), bool)
        again[now] = (seg[now] == seg[before]) & (more[now] == more[before]) & (key[now] == key[before])
        docs = np.array([d for d, _, _ in held], np.int64)
        ties = np.array([t for _, t, _ in held], np.int64)
        first = ~again
        halves = _signed(seg[first]), _signed(more[first])
        yield _batch(_NAMES, 0, _signed(key[first]), *halves, docs[at[first]], ties[at[first]], start[first], end[first])
        owner, a, b = union(start[again], end[again], at[again])
        if len(a):
            spread = _signed(Hashes.mixed(docs[owner].view(np.uint64)))
            yield _batch(_NAMES, 1, spread, 0, 0, docs[owner], ties[owner], a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Hashes(bits), [], 0
        for batch in batches:
            for doc in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "data")), strict=True):
                held.append(doc)
                size += len(doc[2])
                if size >= gather:
                    yield from flush(held, hashes)
                    held, size = [], 0
        yield from flush(held, hashes)

    return run


_GROUPED = "kind int, key bigint, piece int, doc bigint, tie bigint, start int, end int"


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments in order of key, digest, document and start: repeats, and what suffix arrays must decide.

    Only the last row's state is carried on, however large a key's group is.
    """
    last: tuple | None = None  # key and part, digest, and the key's first segment if it is still to be given
    names = (*_NAMES, "piece")
    order = ("kind", "key", "piece", "doc", "tie", "start", "end")
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        new_key = np.ones(batch.num_rows, bool)
        new_seg = np.ones(batch.num_rows, bool)
        new_key[1:] = (c["key"][1:] != c["key"][:-1]) | (c["piece"][1:] != c["piece"][:-1]) | (c["kind"][1:] != c["kind"][:-1])
        new_seg[1:] = (c["seg"][1:] != c["seg"][:-1]) | (c["more"][1:] != c["more"][:-1])
        if last is not None:
            new_key[0] = c["kind"][0] == 1 or (c["key"][0], c["piece"][0]) != last[0]
            new_seg[0] = (c["seg"][0], c["more"][0]) != last[1]
        known = c["kind"] == 1
        first = (new_key | new_seg) & ~known
        repeat = ~first
        run = np.cumsum(new_key)  # 0: goes on from the last batch
        firsts = np.bincount(run[first], minlength=run[-1] + 1)
        firsts[0] += last is not None
        several = first & ((firsts[run] > 1) | (c["piece"] >= 0))
        out = []
        if last is not None and last[2] is not None and firsts[0] > 1:
            out.append(pa.RecordBatch.from_pydict({n: pa.array([last[2][n]], batch.schema.field(n).type) for n in order}))
        if last is not None and firsts[0] > 1:
            last = (*last[:2], None)
        for rows, kind in ((repeat, 1), (several, 0)):
            if rows.any():
                picked = {n: c[n][rows] for n in order} | {"kind": np.full(rows.sum(), kind)}
                out.append(pa.RecordBatch.from_pydict({n: pa.array(picked[n], batch.schema.field(n).type) for n in order}))
        yield from out
        end = batch.num_rows - 1
        if known[end]:
            last = None
        else:
            waiting = None
            if c["piece"][end] < 0 and firsts[run[end]] == 1:
                if run[end] == 0:
                    waiting = last[2] if last is not None else None
                else:
                    at = int(np.flatnonzero(first & (run == run[end]))[0])
                    waiting = {n: c[n][at].item() for n in order} | {"kind": 0}
            last = ((c["key"][end], c["piece"][end]), (c["seg"][end], c["more"][end]), waiting)


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments listed for each document."""
    for batch in batches:
        for doc, tie, data, listed in zip(*(batch.column(n).to_pylist() for n in ("doc", "tie", "data", "listed")), strict=True):
            rows = {"key": [s["key"] for s in listed], "piece": [s["piece"] for s in listed]}
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(rows["key"], pa.int64()),
                    "piece": pa.array(rows["piece"], pa.int32()),
                    "doc": pa.array([doc] * len(listed), pa.int64()),
                    "tie": pa.array([tie] * len(listed), pa.int64()),
                    "start": pa.array([s["start"] for s in listed], pa.int32()),
                    "bytes": pa.array([data[s["start"] : s["end"]] for s in listed], pa.binary()),
                }
            )


def repeated_strings(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of ``length`` bytes of the texts, in order: its text, its start, whether it came before.

    One suffix array over all texts, with a mark between them, brings equal
    strings side by side.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\0".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = data.astype(np.int64) + 1
    symbols[begin[1:] - 1] = 0
    counts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[text] + start
    if not len(at):
        return text, start, np.zeros(0, bool)
    string_at = np.full(len(data), -1, np.int64)
    string_at[at] = np.arange(len(at))
    order = string_at[suffix_array(symbols)]
    order = order[order >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    place = at[order]
    same = np.zeros(len(order), bool)
    for i in range(1, len(order), 1 << 15):
        now = slice(i, min(i + (1 << 15), len(order)))
        same[now] = (windows[place[now]] == windows[place[now.start - 1 : now.stop - 1]]).all(axis=1)
    run = np.cumsum(~same) - 1
    least = np.minimum.reduceat(order, np.flatnonzero(~same))
    again = np.zeros(len(order), bool)
    again[order] = order != least[run]
    return text, start, again


_DECIDED = "kind int, one bigint, two bigint, doc bigint, tie bigint, start int, end int"


def _decider(length: int, block: int):
    """Repeats among segments in order of key, piece, document and start.

    Kind 1: stretches of a document that are repeats; kind 2: a string, by its
    digest, that is the first of its part of a group that was cut.
    """

    def decide(groups: list[tuple[bool, list[tuple[int, int, int, bytes]]]]) -> Iterator[pa.RecordBatch]:
        rows = [(cut, *r) for cut, members in groups for r in members]
        if not rows:
            return
        rows.sort(key=lambda r: r[1:4])  # parts of one group may meet here
        text, start, again = repeated_strings([r[4] for r in rows], length)
        docs, ties, begins = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        a = begins[text] + start
        owner, s, e = union(a[again], a[again] + length, text[again])
        if len(s):
            yield _decided(1, 0, 0, docs[owner], ties[owner], s, e)
        cut = np.array([r[0] for r in rows])
        new = np.flatnonzero(cut[text] & ~again)
        for i in range(0, len(new), 1 << 14):
            part = new[i : i + (1 << 14)]
            digests = [
                hashlib.blake2b(rows[t][4][b : b + length], digest_size=16).digest()
                for t, b in zip(text[part].tolist(), start[part].tolist(), strict=True)
            ]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield _decided(2, halves[:, 0], halves[:, 1], docs[text[part]], ties[text[part]], a[part], a[part] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[bool, list]] = []
        waiting, group, held, cut, name = 0, [], 0, False, None
        for batch in batches:
            for key, piece, *row, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (key, piece) != name:
                    if group:
                        groups.append((cut, group))
                        waiting += held
                    if waiting >= block:
                        yield from decide(groups)
                        groups, waiting = [], 0
                    name, group, held, cut = (key, piece), [], 0, piece >= 0
                group.append((*row, data))
                held += len(data)
                if held >= block:
                    cut = True
                    yield from decide([(True, group)])
                    group, held = [], 0
        yield from decide([*groups, (cut, group)])

    return run


def _decided(*columns) -> pa.RecordBatch:
    return _batch(("kind", "one", "two", "doc", "tie", "start", "end"), *columns)


def _keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, bool]:
    """A document's place in order, what tells rows with equal ids apart, and whether no two have one."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a whole number, as documents come in its order")
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST))
    unique = docs.groupBy(doc.alias("doc")).count().where("count > 1").isEmpty()
    tie = F.lit(0) if unique else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return doc, tie.cast("bigint"), unique


#: Anchors of 12 bytes that are broadcast at most; more are met in a shuffle.
FEW = 200_000


def spans(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    gram: int = 32,
    block: int = 1 << 18,
    sample: int = 64,
    hot: int = 1024,
    bits: int = 64,
    keys: tuple[Column, Column, bool] | None = None,
) -> DataFrame:
    """Per document that has any: doc, tie and its ``spans`` of bytes that are repeats, in order and apart."""
    small_batches(docs.sparkSession)
    gram = min(gram, length)
    doc, tie, unique = keys or _keys(docs, id_col, text_col)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(doc.alias("doc"), tie.alias("tie"), data.alias("data")).where(F.octet_length("data") >= length)
    rows = rows if unique else rows.dropDuplicates(["doc", "tie"])
    search = trimmed(_searcher(length, gram, bits))
    some = rows.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(sample)) == 0).mapInArrow(search, _FOUND)
    counts = some.where("kind = 0").groupBy(F.col("key").alias("of")).agg(F.count_distinct("seg").alias("n"))
    parts = F.ceil(F.col("n") * sample / hot).cast("int")
    crowded = materialise(counts.where(F.col("n") * sample >= hot).where("n > 1").select("of", parts.alias("parts")), "crowded")
    crowded = F.broadcast(crowded) if crowded.count() <= FEW else crowded
    found = rows.mapInArrow(search, _FOUND).join(crowded, (F.col("kind") == 0) & (F.col("key") == F.col("of")), "left")
    piece = F.when(F.col("parts").isNotNull(), F.pmod("seg", "parts")).otherwise(-1)
    found = found.withColumn("piece", piece.cast("int")).drop("of", "parts")
    dealt = found.repartition("key", "piece").sortWithinPartitions("kind", "key", "piece", "seg", "more", "doc", "tie", "start")
    sifted = materialise(dealt.mapInArrow(_sift, _GROUPED), "segments")

    listed = (
        sifted.where("kind = 0")
        .groupBy(F.col("doc").alias("d"), F.col("tie").alias("t"))
        .agg(F.collect_list(F.struct("key", "piece", "start", "end")).alias("listed"))
    )
    joined = rows.join(listed, (F.col("doc") == F.col("d")) & (F.col("tie") == F.col("t")))
    pieces_of = joined.select("doc", "tie", "data", "listed").mapInArrow(
        _cutter, "key bigint, piece int, doc bigint, tie bigint, start int, bytes binary"
    )
    ordered = pieces_of.repartition("key", "piece").sortWithinPartitions("key", "piece", "doc", "tie", "start")
    decided = materialise(ordered.mapInArrow(trimmed(_decider(length, block)), _DECIDED), "repeats")
    across = decided.where("kind = 2").select("one", "two", F.struct("doc", "tie", "start").alias("at"), "end")
    earliest = across.groupBy(F.col("one").alias("o"), F.col("two").alias("w")).agg(F.min("at").alias("least"), F.count("*").alias("n"))
    earliest = earliest.where("n > 1")
    later = across.join(earliest, (F.col("one") == F.col("o")) & (F.col("two") == F.col("w"))).where("at <> least")
    stretch = F.struct("start", "end").alias("span")
    parts = (
        sifted.where("kind = 1").select("doc", "tie", stretch),
        decided.where("kind = 1").select("doc", "tie", stretch),
        later.select("at.doc", "at.tie", F.struct("at.start", "end").alias("span")),
    )
    together = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return together.groupBy("doc", "tie").agg(F.collect_set("span").alias("spans"))


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((s["start"], s["end"]) for s in found or []):
        if out and s[0] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s[1])
        else:
            out.append(s)
    return out


def kept(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in gone for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def marked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Every row with all its columns and ``repeats``, the spans of its text's bytes to remove (null: none)."""
    keys = doc, tie, _ = _keys(docs, id_col, text_col)
    found = spans(docs, id_col=id_col, text_col=text_col, keys=keys, **settings)
    found = found.select(F.col("doc").alias("__doc"), F.col("tie").alias("__tie"), F.col("spans").alias("repeats"))
    rows = docs.drop("repeats")
    joined = rows.join(found, (doc == F.col("__doc")) & (tie == F.col("__tie")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], "repeats")


def summary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t or "").encode() for t in batch.column("text").to_pylist()]
            gone = [merged(s) for s in batch.column("repeats").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(d) for d in data], pa.int64()),
                    "n_removed": pa.array([sum(b - a for a, b in g) for g in gone], pa.int64()),
                    "n_spans": pa.array([len(g) for g in gone], pa.int64()),
                    "kept_sha256": pa.array(
                        [hashlib.sha256(kept(d, g)).hexdigest() for d, g in zip(data, gone, strict=True)], pa.string()
                    ),
                }
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Every row with all its columns, its text without repeats; characters cut by an edge of a span go as well."""
    rows = marked(docs, id_col=id_col, text_col=text_col, **settings)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, found in zip(batch.column(text_col).to_pylist(), batch.column("repeats").to_pylist(), strict=True):
                gone = merged(found)
                data = None if t is None else kept(t.encode(), gone).decode("utf-8", "ignore") if gone else t
                out.append(data)
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, text_col, pa.array(out, pa.string())).drop_columns(["repeats"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("repeats").schema)
    return rows.mapInArrow(trimmed(run), shape)
