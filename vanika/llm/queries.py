"""The corpus operators' queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vanika.llm.common import table

def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.winnow import fingerprint_with_edits

    return fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.toolcalls import link_conversations

    return link_conversations(table(spark, sf_dir, "conversations"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.secretscan import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.maxent import score

    return score(table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.dac import encode_and_read

    return encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.tokencounts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.repair import damaged, repair_report

    return repair_report(damaged(table(spark, sf_dir, "conversations")))


def op13_quantile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanika.llm.quantiles import report, streams

    return report(streams(spark, sf_dir), error=0.02, parts=4, least=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_pii, op3_winnowing, op4_tool_calls, op5_best_fit_packing, op6_simhash_near_dedup, op7_secret_scan, op8_toxicity, op9_language_model, op10_token_ids, op11_token_counts, op12_conversation_repair, op13_quantile_summaries)}


def oracle_sql() -> dict[str, str]:
    from vanika.llm import toolcalls

    return {"op4_tool_calls": toolcalls.ORACLE}
