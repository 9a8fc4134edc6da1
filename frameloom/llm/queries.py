"""Queries of the corpus operators, with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm.common import table


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.suffix import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.language import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from frameloom.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.jaccard import similar_components

    return similar_components(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.fim import digests

    return digests(table(spark, sf_dir, "documents"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.mainhtml import extract

    return extract(table(spark, sf_dir, "pages"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.llm.conversations import repair

    return repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_suffix, op2_language, op3_bpe, op4_quality, op5_warc, op6_jaccard, op7_decontamination, op8_licenses, op9_toxicity, op10_ann, op11_fim, op12_html, op13_conversations)
}


def _licenses() -> str:
    from frameloom.llm.licenses import oracle

    return oracle()


def _fim() -> str:
    from frameloom.llm.fim import ORACLE

    return ORACLE


ORACLES = {
    "op5_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
        k AS (SELECT h, max(page_id) AS keeper FROM d GROUP BY h)
        SELECT page_id, payload_bytes,
          list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
          CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM d JOIN k USING (h)
    """,
    "op8_licenses": _licenses(),
    "op11_fim": _fim(),
}
