"""The registered queries over the standard tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    fingerprint,
    html_extraction,
    language,
    quality,
    sentencepiece_bpe,
    sharding,
    simhash,
    suffix_dedup,
    warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo a number."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def learn_quality(spark: SparkSession, sf_dir: str) -> quality.Network:
    """The network fitted to the labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return quality.train(table(spark, sf_dir, "documents"), labels)


ACCEPT = 0.3


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, learn_quality(spark, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"),
    )


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("row_number")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.summary(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model_path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), model_path=model_path, digests=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("tie")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    contents = language.train(docs, learn=remainder("doc_id", 4) != 2)
    return language.identify(docs, contents).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_quality_classifier,
        op3_feistel_sharding,
        op4_html_extraction,
        op5_suffix_dedup,
        op6_sentencepiece,
        op7_simhash,
        op8_warc,
        op9_multiset_fingerprint,
        op10_language_id,
    )
}

OP8_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), r AS (
    SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
), w AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS largest
    FROM r
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM w
"""

OP1_SQL = r"""
WITH low AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), items AS (
    SELECT item_id::VARCHAR AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL
), starts AS (
    SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0
), pats AS (
    SELECT DISTINCT item, array_to_string(w[i:i + 7], ' ') AS p, least(len(w), 8) AS n FROM starts
), places AS (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM pats) WHERE len(w) >= n
), hits AS (
    SELECT r, i, pats.n, item FROM places JOIN pats ON places.n = pats.n AND array_to_string(w[i:i + places.n - 1], ' ') = p
), hit AS (
    SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r
), found AS (
    SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM low LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

OP5_SQL = """
WITH docs AS (
    SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents
), strings AS (
    SELECT doc_id, i, x[i:i + 99] AS s FROM (SELECT doc_id, x, unnest(range(1, octet_length(x) - 98)) AS i FROM docs WHERE octet_length(x) >= 100)
), later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1
), marked AS (
    SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM later
), numbered AS (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
), spans AS (
    SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM numbered GROUP BY ALL
), edges AS (
    SELECT doc_id, 0 AS span, 1 AS a, 1 AS z FROM docs UNION ALL SELECT doc_id, span, a, z FROM spans
), pieces AS (
    SELECT doc_id, span, hex(x[z:coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY span), octet_length(x) + 1) - 1]) AS h, z - a AS gone
    FROM edges JOIN docs USING (doc_id)
), kept AS (
    SELECT doc_id, string_agg(h, '' ORDER BY span) AS h, sum(gone) AS n_removed, max(span) AS n_spans FROM pieces GROUP BY doc_id
)
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
       sha256(unhex(h)) AS kept_sha256
FROM docs JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op5_suffix_dedup": OP5_SQL, "op8_warc": OP8_SQL}
