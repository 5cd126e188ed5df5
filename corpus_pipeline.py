"""A corpus pipeline: quality, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row the stage before
kept.  All but the last return the columns of ``documents``; further columns of
``docs``, whatever their names, are left behind.

Defined results, of every stage: an empty table gives an empty table; a null text
counts as empty and stays null where the row stays; rows that repeat an id are
judged by their own text; null ids are kept as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotide.llm import decontamination, near_copies, quality, queries, sentencepiece_bpe, suffix_dedup
from echotide.llm import _store as store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null and empty texts are scored as one chunk of padding; all chunks of long ones count; rows that repeat a text
    get its score.
    """
    scored = quality.score(docs.select(*COLUMNS), queries.learn_quality(spark, sf_dir))
    return scored.where(F.col("quality_score") >= queries.ACCEPT).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more), that with the smallest id.

    Texts without words are copies of one another; of rows equal in id and text one stays; rows without an id go if
    their group has one, else they all stay, but for equal texts.
    """
    return near_copies.keep_first(docs.select(*COLUMNS)).select(*COLUMNS)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand earlier in the corpus; ``n_chars`` is that of the text left.

    Texts under 100 bytes lose nothing; a null id comes after all others; rows equal in id and text are cut alike, and
    rows equal in id alone come in order of a hash of their texts.
    """
    cut = suffix_dedup.deduplicate(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; those without words stay."""
    items = queries.table(spark, sf_dir, "benchmark")
    found = decontamination.decontaminate(docs, items, min_items=1, keep=tuple(COLUMNS))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids and the text they decode to; none, and the empty text, for null and empty texts."""
    import public_tokenizers

    model_path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_bpe.encode_decode(docs.select("doc_id", "text"), model_path=model_path)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it.

    What a stage writes on its way is deleted after it, and its result after the stage that reads it.
    """
    docs = queries.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        path = store.fresh_path(spark, name.split()[0])
        with store.cleared(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        if before is not None:
            store.discard(before)
        docs = before = spark.read.schema(result.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
