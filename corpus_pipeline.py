"""A corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmine.llm import jaccard, packing, pseudonyms, quality, repeats
from postmine.llm.queries import KEY
from postmine.llm.rows import settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    chain = quality.fit_line_chain(docs, table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, chain, keep=COLUMNS).filter("kept").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; rows without an id stay."""
    found = jaccard.similarity_components(docs)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").union(docs.filter("doc_id IS NULL")).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that an earlier one holds."""
    return with_length(repeats.remove_repeats(docs, keep=["lang", "source"], text=True))


def feistel_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal values replaced."""
    return with_length(pseudonyms.pseudonymize(docs, KEY))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("PII pseudonyms", feistel_pseudonyms),
    ("best-fit packing", best_fit_packing),
]

#: The line model, the tokenizer and the packing are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
    return docs
