"""From raw documents to encoded training text, in five stages over stored tables.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.bpe import encode_documents
from tallyloom.llm.catalog import rank_file
from tallyloom.llm.common import stored, table
from tallyloom.llm.exact_dedup import drop_exact_copies
from tallyloom.llm.language import keep_identified, page_evidence
from tallyloom.llm.mixing import mix_documents
from tallyloom.llm.near_dedup import drop_near_copies


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; pages of the same folder add what their markup and address declare."""
    return keep_identified(docs, page_evidence(table(spark, sf_dir, "pages")))


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of at least 0.8."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents are repeated or left out so that each source comes near its target."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every document of the mixture."""
    return encode_documents(docs, rank_file(), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", remove_exact_copies),
    ("MinHash near-dedup", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

# Language posteriors, MinHash, hash order and BPE have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
