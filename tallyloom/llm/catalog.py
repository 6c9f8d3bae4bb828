"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F

from tallyloom.llm import (
    bpe, ctw, exact_dedup, fill_middle, html_text, language, mixing, near_dedup, secrets, sharding, topk, url_rules,
    vector_codes,
)
from tallyloom.llm.common import table

LLM_REGISTRY = {}


def registered(query):
    LLM_REGISTRY[query.__name__] = query
    return query


@registered
def op1_best_fit_shards(spark, folder):
    shards = sharding.shard_documents(table(spark, folder, "documents"), shards=16)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@registered
def op6_source_mix(spark, folder):
    mix = mixing.mixed(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@registered
def op8_exact_dedup(spark, folder):
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


@registered
def op9_tree_bpe(spark, folder):
    return bpe.encode_documents(table(spark, folder, "documents"), rank_file(), public_tokenizers.PATTERN)


@registered
def op10_circulant_minhash(spark, folder):
    groups = near_dedup.near_groups(table(spark, folder, "documents"), size=4)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


@registered
def op2_context_tree(spark, folder):
    return ctw.score_documents(table(spark, folder, "documents"))


@registered
def op3_url_rules(spark, folder):
    return url_rules.judge_urls(table(spark, folder, "pages"), table(spark, folder, "labels"))


@registered
def op5_language(spark, folder):
    found = language.identify(table(spark, folder, "documents"), language.page_evidence(table(spark, folder, "pages")))
    return found.select("doc_id", "language", "posterior", "accepted", "declared")


@registered
def op7_threshold_top(spark, folder):
    return topk.top_inner_products(table(spark, folder, "embeddings"))


@registered
def op4_tree_model_text(spark, folder):
    return html_text.extract_text(table(spark, folder, "pages"))


@registered
def op11_fill_middle(spark, folder):
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


@registered
def op12_secret_scan(spark, folder):
    found = secrets.find_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(secrets.of_kinds(F.col("spans"), [kind])).cast("long")
    base = secrets.listed(secrets.of_kinds(F.col("spans"), secrets.BASE_KINDS))
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


@registered
def op13_vector_codes(spark, folder):
    coded = vector_codes.vector_codes(table(spark, folder, "embeddings"))
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return coded.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", "codebooks_sha256")
