"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, token ids.

Every stage reads all rows that the stage before it kept, and returns the columns of ``documents``, with any extra ones as they are;
the last one returns the encoded texts.  A toxic but well-written document is no concern of these five stages.

Defined results, by stage: a null, empty or blank text goes at the first.  Rows with equal texts (letter case of A-Z aside) leave one at
the second, that of the largest id, also if they share it or have none; so no text meets the later stages twice.  Of near copies the
smallest id stays; rows that share an id are one document there, and a null id is linked with nothing.  Very long texts are read whole by
all stages.  An empty table stays empty, and an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from eventloom.llm._base import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label model, fitted on all of ``docs``, scores as good; texts without words go, repeated rows share their fate."""
    return quality.keep_good(docs, quality.fit(docs))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (null as empty), one row: that of the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the smallest id; rows of one id stay or go together, null ids stay."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none, and null items match nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row; a null text is empty, a null id stays null."""
    return bpe.encode_decode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("bpe_encoding", encoding),
]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, writing each one's result to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
