"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postmine.llm import decontaminate, filter_audit, forced_bpe, jaccard, language, order_minhash, packing, pages, prefix_trie, pseudonyms, quality, repair, repeats
from postmine.llm.oracle import ORACLE
from postmine.llm.rows import table

__all__ = ["ORACLE", "QUERIES"]

#: The key of the pseudonyms in these queries; a deployment takes its own secret.
KEY = "example key"


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.quality_rules(docs, quality.fit_line_chain(docs, table(spark, folder, "labels")))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, KEY, count="n_values")


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, folder, "documents"))


def op5_language_evidence(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = language.document_evidence(docs).union(language.page_evidence(table(spark, folder, "pages")))
    return language.identify(rows, language.fit_language_text(docs))


def op6_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.order_fingerprints(table(spark, folder, "documents"))


def op7_repair_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return repair.read_shards(repair.encode_to_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "pages")
    return pages.extract_pages(found, pages.fit_pages(found))


def op9_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


def op10_forced_boundary_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return forced_bpe.encode_and_decode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_best_fit_packing, op3_feistel_pseudonyms, op4_ngram_jaccard_join, op5_language_evidence,
        op6_order_minhash, op7_repair_token_files, op8_main_text, op9_suffix_array_dedup, op10_forced_boundary_bpe,
        op11_decontaminate, op12_filter_audit, op13_prefix_trie,
    )
}
