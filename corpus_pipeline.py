"""The corpus pipeline: five stages over documents, each on all that the one before has kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return documents with the columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanika.llm.common import cut, table
from vanika.llm.decontaminate import without_leaks
from vanika.llm.packing import pack
from vanika.llm.queries import tokenizer_path
from vanika.llm.secretscan import masked
from vanika.llm.simhash import keep_one
from vanika.llm.toxicity import score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; null doc_ids stay, as nothing tells their rows apart."""
    found = score(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"] == F.col("_gone"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are alike by 0.8 or more, that of the smallest doc_id stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Trained models and tokenizers have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
