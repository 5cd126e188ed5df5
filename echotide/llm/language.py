"""Language identification by compression with a dictionary for each language.

Training texts of a language, folded, make a raw-content zstandard dictionary.  A
text is compressed with each of them; the language whose dictionary gives the
fewest bytes is chosen.  A text is rejected (``rejected``) when the margin
between the two smallest results, as a share of the smallest, is under
``min_margin``; its best guess is still given.

Folding lower-cases letters and turns runs of other characters into one space,
so that digits, marks and shouting do not count.  Long texts are compressed in
pieces of ``piece`` bytes and all pieces count.

Training takes a bounded sample: of each language the ``sample_docs`` documents
that come first by a hash of their ids, and of these, in that order, the texts that
fit what is left of ``dictionary`` bytes, whole.  A text longer than ``dictionary``
counts as pieces of ``STRETCH`` bytes, spread evenly over all of it, that fill it.

Defined results: ``und`` with score 0 for a null text, for one without a letter,
and for every text if no language was learned; rows without a language are not
learned from; ties go to the language first in order; other columns are ignored.

Scale: prediction is a map over the documents, without a shuffle; what is shipped
is ``dictionary`` bytes for each language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import small_batches

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"\P{L}+")
STRETCH = 256


def folded(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def spread(data: bytes, size: int) -> bytes:
    """All of the data if it fits the size, else stretches of it, evenly over its whole length."""
    if len(data) <= size:
        return data
    n = max(1, size // STRETCH)
    last = len(data) - size // n
    return b"".join(data[at : at + size // n] for at in (last * k // max(1, n - 1) for k in range(n)))


class Dictionaries:
    """Compressors for the learned languages, in order."""

    def __init__(self, contents: dict[str, bytes], level: int, piece: int):
        import zstandard

        self.piece = piece
        self.compressors = {}
        for lang in sorted(contents):
            content = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compressors[lang] = zstandard.ZstdCompressor(
                dict_data=content, write_content_size=False, write_dict_id=False
            )

    def sizes(self, data: bytes) -> dict[str, int]:
        parts = [data[i : i + self.piece] for i in range(0, len(data), self.piece)] or [b""]
        return {lang: sum(len(c.compress(p)) for p in parts) for lang, c in self.compressors.items()}

    def predict(self, text: str | None, min_margin: float) -> tuple[str, float, bool]:
        if not self.compressors or not text or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        sizes = sorted((n, lang) for lang, n in self.sizes(folded(text)).items())
        best, lang = sizes[0]
        scale = max(1.0, 0.02 * best)
        score = 1 / sum(math.exp(-min(700.0, (n - best) / scale)) for n, _ in sizes)
        margin = (sizes[1][0] - best) / max(1, best) if len(sizes) > 1 else 1.0
        return lang, score, margin < min_margin


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    learn: Column | None = None,
    dictionary: int = 32 * 1024,
    sample_docs: int = 200,
    seed: int = 23,
) -> dict[str, bytes]:
    """The dictionary of each language, from the rows for which ``learn`` is true."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known if learn is None else known.where(learn)
    draw = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = known.select(
        draw.alias("draw"), F.col(id_col).cast("string").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    drawn = F.lit(False)  # a share of all 64-bit numbers, with some to spare; what is over is cut below
    for lang, n in totals.items():
        bound = min((1 << 63) - 1, -(1 << 63) + int((2 * sample_docs + 50) / n * (1 << 64)))
        drawn = drawn | ((F.col("lang") == lang) & (F.col("draw") <= bound))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spread(folded(t), dictionary) for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in ("draw", "doc_id", "lang")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], ["draw", "doc_id", "lang", "text"])

    some = rows.where(drawn).mapInArrow(fold, "draw bigint, doc_id string, lang string, text binary")
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    sample = some.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample_docs)
    found: dict[str, list[tuple[int, bytes]]] = {lang: [] for lang in totals}
    for r in sample.toLocalIterator():
        found[r["lang"]].append((r["place"], bytes(r["text"])))
    contents = {}
    for lang, texts in found.items():
        joined = b""
        for _, t in sorted(texts):
            if t and len(joined) + len(t) < dictionary + (not joined):
                joined += b" " * bool(joined) + t
        if len(joined) >= 8:
            contents[lang] = joined
    return contents


def identify(
    docs: DataFrame,
    contents: dict[str, bytes],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    level: int = 6,
    piece: int = 16 * 1024,
    min_margin: float = 0.01,
) -> DataFrame:
    """Per row: doc_id, lang_pred, score (0 to 1), rejected."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Dictionaries(contents, level, piece)
        for batch in batches:
            found = [model.predict(t, min_margin) for t in batch.column("text").to_pylist()]
            langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "lang_pred": pa.array(langs, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                    "rejected": pa.array(rejected, pa.bool_()),
                }
            )

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
