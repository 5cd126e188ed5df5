"""SentencePiece encoding and decoding by a table of each prefix's last token.

A BPE encoding is built from its prefixes: the encoding of a prefix ends in one
token, and what stands before that token is the encoding of the shorter prefix.
So a table of the last token of every prefix holds all encodings.  For each end
position an Aho-Corasick automaton over the vocabulary lists the tokens that end
there; the one that belongs is the one whose pair with the last token of the
prefix before it stays apart when merged (the pair-compatibility test).  Ids are
then recovered from the end backwards.

A token that merging its own characters cannot give never stands in an encoding
and is left out of the automaton.  Characters outside the vocabulary become byte
tokens.  No token joins a character to a space mark behind it, so a text is
encoded in units: space marks and then either ASCII marks that no token holds
beside another character, or a run of other characters.  Units repeat, and a
bounded table keeps the results of those met of late.

Defined results: a null text is the empty text, which has no tokens; repeated
rows are encoded alike; other columns are ignored.

Scale: texts are encoded in place, without a shuffle, half a megabyte at a time; the model file is read
from ``model_path`` on the driver and shipped once to the executors (its size is
that of the vocabulary).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import portions, small_batches, trimmed

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: numbers, 4- or 8-byte words, or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = {5: 4, 1: 8}[kind]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Model:
    """What a BPE model file says: pieces with scores and kinds, and how texts are prepared."""

    def __init__(self, data: bytes):
        import struct

        self.pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix, self.squeeze, self.escape, self.charsmap, self.fallback, kind = True, True, True, b"", False, 1
        for number, value in _fields(data):
            if number == 1:
                piece, score, what = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode("utf-8")
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        what = v
                self.pieces.append((piece, score, what))
            elif number == 2:
                for k, v in _fields(value):
                    if k == 3:
                        kind = v
                    elif k == 35:
                        self.fallback = bool(v)
            elif number == 3:
                for k, v in _fields(value):
                    if k == 2:
                        self.charsmap = v
                    elif k == 3:
                        self.dummy_prefix = bool(v)
                    elif k == 4:
                        self.squeeze = bool(v)
                    elif k == 5:
                        self.escape = bool(v)
        if kind != 2 or self.charsmap or self.squeeze or not self.escape or not self.fallback:
            raise ValueError("a BPE model with byte fallback, identity normalisation and kept spaces is needed")
        if any(what in (USER_DEFINED, UNUSED) for _, _, what in self.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if any(MARK in p.lstrip(MARK) for p, _, what in self.pieces if what == NORMAL):
            raise ValueError("a piece holds a space mark behind another character")


class Codec(dict):
    """Encodes and decodes with one model.

    As a dict it holds, for each unit met, its ids as text and what they decode
    to.  When it has ``keep`` units they become the older ones, in place of those
    before; an older unit that is met again is taken over.  So there are twice as
    many at most, and rare units don't drive out common ones.  ``pairs`` bounds the
    compatible pairs that are kept.
    """

    def __init__(self, data: bytes, keep: int = 100_000, pairs: int = 300_000):
        import ahocorasick

        super().__init__()
        self.model = model = Model(data)
        self.keep, self.pairs = keep, pairs
        self.older: dict[str, tuple[str, str]] = {}
        self.id_of = {p: i for i, (p, _, what) in enumerate(model.pieces) if what == NORMAL}
        self.score = {p: s for p, s, what in model.pieces if what == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, what) in enumerate(model.pieces) if what == BYTE}
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.split = re.compile(self.unit_pattern()).findall
        self.fits: dict[int, bool] = {}
        self.text_of = [p for p, _, _ in model.pieces]
        self.special = max((i for i, (_, _, what) in enumerate(model.pieces) if what != NORMAL), default=-1)
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            if len(p) > 1 and self.merge(p) == [p]:
                self.automaton.add_word(p, (self.id_of[p], len(p)))
        self.automaton.make_automaton()

    def unit_pattern(self) -> str:
        beside = {(p[i], p[i + 1]) for p in self.id_of for i in range(len(p) - 1)}
        apart = {chr(c) for c in range(128) if not chr(c).isalnum()}
        while mixed := {
            x for pair in beside for x in pair if x in apart and MARK not in pair and not apart.issuperset(pair)
        }:
            apart -= mixed
        some = "".join(re.escape(c) for c in sorted(apart))
        return f"{MARK}*[^{MARK}{some}]+|{MARK}*[{some}]+|{MARK}+" if some else f"{MARK}*[^{MARK}]+|{MARK}+"

    def merge(self, text: str) -> list[str]:
        """Plain merging, best score first and leftmost among equals; for short strings."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            joined = parts[i] + parts[j]
            if joined in self.score:
                heapq.heappush(heap, (-self.score[joined], i, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != joined:
                continue
            j = after[i]
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' characters gives the two tokens again."""
        a, b = self.text_of[left], self.text_of[right]
        known = self.merge(a + b) == [a, b]
        if len(self.fits) >= self.pairs:
            self.fits.clear()
        self.fits[left << 24 | right] = known
        return known

    def ids(self, unit: str) -> list[int]:
        """The unit's ids, from the table of the last token of each of its prefixes.

        A character that no longer token claims is a token by itself; -1 stands
        for one outside the vocabulary, which nothing merges with.
        """
        known, fits = self.id_of.get, self.fits.get
        last = [known(c, -1) for c in unit]
        size = [1] * len(unit)
        done = -1
        for end, (token, n) in self.automaton.iter(unit):
            if end == done:
                continue
            if end >= n and (left := last[end - n]) >= 0:
                fit = fits(left << 24 | token)
                if not (self.compatible(left, token) if fit is None else fit):
                    continue
            last[end], size[end], done = token, n, end
        out, end = [], len(unit) - 1
        while end >= 0:
            if last[end] >= 0:
                out.append(last[end])
            else:
                out.extend(self.byte_id[b] for b in reversed(unit[end].encode("utf-8")))
            end -= size[end]
        out.reverse()
        return out

    def __missing__(self, unit: str) -> tuple[str, str]:
        got = self.older.get(unit)
        if got is None:
            ids = self.ids(unit)
            pieces = self.pieces_text(ids)
            got = ",".join(map(str, ids)), unit if pieces == unit else pieces
        if len(unit) <= 64:
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[unit] = got
        return got

    def prepare(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if text and self.model.dummy_prefix else text

    def encode(self, text: str | None) -> list[int]:
        return [i for u in self.split(self.prepare(text or "")) for i in self.ids(u)]

    def pieces_text(self, ids: list[int]) -> str:
        """The ids' pieces; runs of byte tokens read as UTF-8, each wrong byte as U+FFFD."""
        pieces, bytes_of = self.model.pieces, self.bytes_of
        if ids and min(ids) > self.special:
            return "".join([self.text_of[i] for i in ids])
        out, run = [], b""
        for i in [*ids, None]:
            if i in bytes_of:
                run += bytes_of[i]
                continue
            if run:
                out.append(_utf8(run))
                run = b""
            if i is not None and pieces[i][2] != CONTROL:
                out.append(pieces[i][0])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.plain(self.pieces_text(ids))

    def plain(self, pieces: str) -> str:
        if self.model.dummy_prefix and pieces.startswith(MARK):
            pieces = pieces[1:]
        return pieces.replace(MARK, " ")

    def both(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids as text, and the decoded text."""
        units = list(map(self.__getitem__, self.split(self.prepare(text or ""))))
        if not units:
            return 0, "", ""
        ids, pieces = zip(*units, strict=True)
        joined = ",".join(ids)
        return joined.count(",") + 1, joined, self.plain("".join(pieces))


def _utf8(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def read_model(model_path: str) -> bytes:
    with open(model_path, "rb") as f:
        return f.read()


def encode_decode(
    docs: DataFrame,
    *,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_tokens, and ids (array) and decoded text, or with ``digests`` their SHA-256."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(read_model(model_path))
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    first = "string" if digests else "array<int>"
    run = trimmed(_encoder(lambda: codec_of(data.value), names, digests))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {names[0]} {first}, {names[1]} string")


def _encoder(codec_here: Callable[[], Codec], names: tuple[str, str], digests: bool):
    """Encodes batches of doc_id and text, a portion at a time: ids and decoded texts take many times a text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_here()
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for part in (p for batch in batches for p in portions(batch, "text")):
            n, first, second = [], [], []
            for text in part.column("text").to_pylist():
                count, ids, decoded = codec.both(text)
                n.append(count)
                first.append(sha(ids) if digests else np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32))
                second.append(sha(decoded) if digests else decoded)
            shape = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array(n, pa.int64()),
                    names[0]: pa.array(first, shape),
                    names[1]: pa.array(second, pa.string()),
                }
            )

    return run


_CODECS: dict[bytes, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """The worker's codec for a model, kept from task to task."""
    key = hashlib.sha256(data).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data)
    return _CODECS[key]
