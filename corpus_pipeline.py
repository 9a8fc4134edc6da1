"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages and documents that hold
benchmark items go, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the toxicity threshold. Null and empty texts stay; repeated rows have one fate; the fit takes the labels of documents that are there."""
    from frameloom.llm.toxicity import fit, without_toxic

    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near duplicates the document with the smallest doc_id stays (all rows of that id); texts without words are linked with nothing, rows without an id stay."""
    from frameloom.llm.jaccard import without_near_duplicates

    return without_near_duplicates(docs)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the bytes removed from their texts that stand in earlier ones; null texts stay null."""
    from frameloom.llm.suffix import without_repeats

    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark; null and empty texts hold none, an empty benchmark removes nothing."""
    from frameloom.llm.decontaminate import without_leaks

    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per row: doc_id, n_tokens and the digests of ids and of decoded bytes; a null text counts as empty."""
    import public_tokenizers

    from frameloom.llm.bpe import encode_decode

    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", jaccard), ("suffix-array dedup", suffix_array), ("benchmark decontamination", decontamination), ("byte-level BPE", bpe)]

#: The stages' model, suffix order and merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
