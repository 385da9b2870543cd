"""A corpus from documents to packed sequences, each stage one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept:
quality rules drop documents, MinHash keeps one of each near-duplicate group, suffix
dedup takes repeated passages out of texts, mixing repeats documents of small sources, and
packing places every token. All but the last return the columns of ``documents``.

Null, empty and very long texts, ties, repeated rows, empty tables and further columns are
taken as each operator's docstring says; none of them stops a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statforge.llm.common import staged, table
from statforge.llm.minhash_dedup import keep_one
from statforge.llm.mixing import mix_documents
from statforge.llm.packing import pack_documents
from statforge.llm.quality_rules import keep_documents
from statforge.llm.suffix_dedup import dedup
from statforge.llm.token_ids import tokenizer_path

#: No source is repeated more than this often relative to the largest one.
REPETITION = 1.25


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, k=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup(docs, with_text=True).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs, repetition=REPETITION)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("suffix dedup", suffix_dedup),
    ("source mixing", source_mixing),
    ("packing", packing),
]

#: Byte-level removal and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
