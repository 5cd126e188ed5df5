"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised by lower-casing A-Z and keeping words, runs of digits,
letters a-z and characters beyond ASCII.  Every run of ``window`` consecutive
words of a benchmark item (the whole item, if it has fewer) is a pattern.  One
automaton over all patterns, which reads words as the numbers of the items' words,
scans a document once; the offsets of its matches are words of the document, and
those are mapped back to code points of the original text.

Defined results: a null or empty text has no words and no hits; an item
without words, or with a null id, gives no pattern; items that share a pattern
are all reported; rows that repeat a doc_id are scanned and returned
separately; columns other than the id and the text are ignored.  An empty
benchmark leaves every document without hits.

Scale: documents are scanned in place, once, without a shuffle.  The automaton is
built once, on the driver, written to the shared folder and loaded once by each
Python worker.  It has at most ``window`` nodes for each word of the benchmark and
digit of its number, whatever the words' length.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import files_of, fresh_path, small_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes of UTF-8 as they are matched: words keep theirs, all else is a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of ``text`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """Every run of ``window`` consecutive words, or all of them if there are fewer."""
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


#: Digits of the words' numbers.  Few, as the automaton looks for a letter among a node's children one by one; the digits
#: of each place are characters of their own, so that no match begins inside a word.
_BASE = 64


def code_of(number: int, width: int) -> str:
    """A word's number as ``width`` digits."""
    return "".join(chr(1 + place * _BASE + number // _BASE**place % _BASE) for place in range(width))


class Patterns:
    """One automaton over the windows of all items, its letters the digits of the numbers of the items' words.

    A word that no item has is as many characters 0, which no window holds.
    """

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int):
        import ahocorasick

        texts = [(item, words_of(text)) for item, text in items]
        numbers: dict[bytes, int] = {}
        for _, words in texts:
            for w in words:
                numbers.setdefault(w, len(numbers))
        self.width = 1
        while _BASE**self.width < len(numbers):
            self.width += 1
        self.codes = {w: code_of(n, self.width) for w, n in numbers.items()}
        self.owners: list[list[str]] = []
        self.sizes: list[int] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for item, words in texts:
            for run in windows_of(words, window):
                key = "".join([self.codes[w] for w in run])
                at = self.automaton.get(key, None)
                if at is None:
                    self.automaton.add_word(key, len(self.owners))
                    self.owners.append([item])
                    self.sizes.append(len(run))
                elif self.owners[at][-1] != item:  # items come in order
                    self.owners[at].append(item)
        if self.owners:
            self.automaton.make_automaton()


def scan(patterns: Patterns, text: str | None) -> tuple[int, list[list[int]], set[str]]:
    """Number of words, hit runs of words as [first, end), and the items that occur."""
    words = words_of(text)
    runs: list[list[int]] = []
    items: set[str] = set()
    if not words or not patterns.owners:
        return len(words), runs, items
    code, none = patterns.codes.get, "\0" * patterns.width
    hits: set[int] = set()
    for at, found in patterns.automaton.iter("".join([code(w, none) for w in words])):
        end = at // patterns.width + 1
        hits.add(found)
        runs.append([end - patterns.sizes[found], end])
    for found in hits:
        items.update(patterns.owners[found])
    return len(words), merged(runs), items


def merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def spans_in(text: str | None, runs: list[list[int]]) -> list[dict[str, int]]:
    """The runs of words as code points [start, end) of the original text."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _save(patterns: Patterns, folder: str) -> str:
    """Writes the automaton to the shared folder and returns its path."""
    files, path = files_of(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/patterns.pickle", compression="zstd") as out:
        pickle.dump(patterns, out, protocol=5)
    return f"{folder}/patterns.pickle"


@lru_cache(maxsize=1)
def _load(path: str) -> Patterns:
    """The automaton of a path; a worker keeps the last one over all its tasks."""
    files, at = files_of(path)
    with files.open_input_stream(at, compression="zstd") as held:
        return pickle.loads(held.read())


def _scanner(path: str, passed: list[str]):
    """Scans with the automaton of ``path``; columns ``passed`` go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [scan(patterns, t) for t in texts]
            spans = [spans_in(t, r) for t, (_, r, _) in zip(texts, found, strict=True)]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array([n for n, _, _ in found], pa.int64()),
                "n_hit": pa.array([sum(b - a for a, b in r) for _, r, _ in found], pa.int64()),
                "items": pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())),
                "spans": pa.array(spans, _SPANS),
            }
            yield pa.RecordBatch.from_pydict(out | {c: batch.column(c) for c in passed})

    return run


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
    min_items: int = 2,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items, n_items, spans, contaminated, and the columns ``keep``.

    ``items`` are the ids, as strings in order, of the benchmark items that
    occur; ``spans`` the hit stretches as code points of the original text; a
    document is contaminated if ``min_items`` items or more occur.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = (
        items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
        .where(F.col("item").isNotNull() & F.col("text").isNotNull())
        .orderBy("item", "text")
    )
    id_type = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    passed = {f"kept_{k}": c for k, c in enumerate(keep)}
    tail = "".join(f", {k} {docs.schema[c].dataType.simpleString()}" for k, c in passed.items())
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(f"`{c}`").alias(k) for k, c in passed.items()],
        F.col(text_col).alias("text"),
    )
    patterns = Patterns(((r["item"], r["text"]) for r in known.toLocalIterator()), window)
    path = _save(patterns, fresh_path(spark, "patterns"))
    result = f"doc_id {id_type}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>{tail}"
    found = rows.mapInArrow(_scanner(path, [*passed]), result)
    n_items = F.size("items").cast("bigint")
    own = ["doc_id", "n_words", "n_hit", "items", "spans", n_items.alias("n_items"), (n_items >= min_items).alias("contaminated")]
    return found.select(*own, *[F.col(k).alias(c) for k, c in passed.items() if c != "doc_id"])
