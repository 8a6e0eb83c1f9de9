"""What a project keeps beside its tables: evaluation reports, training readiness, engine descriptions, settings, dictionaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanika.operators import evaluate
from vanika.sources.files import fixed

# Decimals of the report's numbers, in the order of its columns.
REPORT = [("cer", 4), ("wer", 4), ("utmos", 3), ("duration_sec", 3), ("rtf", 3)]
# What an engine has to be.
ENGINE = {"engine_version": 1, "model_type": "vits", "language": "hi"}
# Settings of a new project.
SETTINGS = {
    "name": None, "language": "hi", "target_sample_rate": 24000, "target_loudness_lufs": -23.0, "clip_min_seconds": 1.5, "clip_max_seconds": 15.0,
    "qc": {"min_snr_db": 30.0, "max_cer_vs_whisper": 0.05, "max_silence_ratio": 0.25},
    "training": {"model": "vits", "batch_size": 16, "grad_accum": 2, "max_steps": 500_000, "learning_rate": 2e-4, "warmup_steps": 4000, "checkpoint_every": 10_000, "mixed_precision": "bf16"},
    "inference": {"roundtrip_validation": True, "roundtrip_cer_threshold": 0.02, "roundtrip_max_retries": 2},
}


def report_lines(items: DataFrame) -> DataFrame:
    """item_id, category and the metrics as text with fixed decimals, empty where there is none."""
    return items.select("item_id", "category", *(fixed(c, n).alias(c) for c, n in REPORT))


def summary_json(items: DataFrame) -> DataFrame:
    """value: one JSON document with n_items, the means of all and of each category; a mean without values is left out."""
    means = [F.avg(c).alias(f"{c}_mean") for c, _ in REPORT]
    rows = items.rollup("category").agg(F.count("*").alias("n"), *means, F.grouping("category").alias("all"))
    one = F.struct("n", *(f"{c}_mean" for c, _ in REPORT))
    overall = F.struct(*(f"{c}_mean" for c, _ in REPORT))
    per = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("all") == 0, F.struct("category", one.alias("m"))))))
    found = rows.agg(per.alias("per_category"), F.coalesce(F.max(F.when(F.col("all") == 1, F.col("n"))), F.lit(0)).alias("n_items"), F.first(F.when(F.col("all") == 1, overall), ignorenulls=True).alias("overall"))
    return found.select(F.to_json(F.struct("per_category", "n_items", "overall")).alias("value"))


def write_report(items: DataFrame, path: str) -> None:
    """path/report_csv and path/report_json of items with their metrics; items are read once for each."""
    report_lines(items).write.csv(f"{path}/report_csv", header=True, emptyValue="", escape='"')
    summary_json(items).coalesce(1).write.text(f"{path}/report_json")


def evaluate_items(items: DataFrame, path: str | None = None) -> DataFrame:
    """The items' metrics; with a path, both reports are written there."""
    measured = evaluate.metrics(items)
    if path:
        write_report(measured, path)
    return measured


def ready(train: DataFrame, val: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: records and hours (three decimals) of both parts, and the vocabulary's size; an error when it is read and train has no rows."""
    rows = train.select(F.lit("train").alias("part"), "duration").unionByName(val.select(F.lit("val").alias("part"), "duration"))
    parts = [(F.count_if(F.col("part") == p).alias(f"{p}_records"), F.round(F.coalesce(F.sum(F.when(F.col("part") == p, F.col("duration"))), F.lit(0.0)) / 3600, 3).alias(f"{p}_hours")) for p in ("train", "val")]
    found = rows.agg(*(x for pair in parts for x in pair)).crossJoin(vocabulary.agg(F.count("*").alias("vocab_size")))  # two single rows
    return found.withColumn("train_records", F.when(F.col("train_records") > 0, F.col("train_records")).otherwise(F.raise_error(F.lit("no records to train on")).cast("long")))


def write_json(row: DataFrame, path: str) -> None:
    row.select(F.to_json(F.struct(*row.columns)).alias("value")).coalesce(1).write.text(path)


def engine_error(version: Column, model: Column, language: Column) -> Column:
    """What an engine is refused for, checked in this order; null: nothing."""
    return (
        F.when(~version.eqNullSafe(F.lit(ENGINE["engine_version"])), F.concat(F.lit("engine version "), F.coalesce(version.cast("string"), F.lit("null"))))
        .when(~model.eqNullSafe(F.lit(ENGINE["model_type"])), F.concat(F.lit("model type "), F.coalesce(model, F.lit("null"))))
        .when(~language.eqNullSafe(F.lit(ENGINE["language"])), F.concat(F.lit("language "), F.coalesce(language, F.lit("null"))))
    )


def read_engine(spark: SparkSession, path: str) -> dict:
    """An engine's description; an error if this package can't use it."""
    found = ENGINE | json.loads(spark.read.text(path, wholetext=True).first()["value"])
    for key, want in ENGINE.items():
        if found[key] != want:
            raise ValueError(f"{key} is {found[key]!r}, not {want!r}")
    return found


def write_engine(spark: SparkSession, engine: dict, path: str) -> None:
    """An engine's description as one JSON document, in a folder that Spark writes."""
    _write_document(spark, ENGINE | engine, path)


def write_dictionary(spark: SparkSession, words: dict[str, str], path: str) -> None:
    """Keys in lower case, sorted: one JSON document, in a folder that Spark writes."""
    _write_document(spark, dict(sorted((k.lower(), v) for k, v in words.items())), path)


def _write_document(spark: SparkSession, document: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(document, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_test_set(items: DataFrame, path: str) -> None:
    """One JSON document of ord, id, category, text; a test set is a project's own small table."""
    rows = items.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "category", "text"))), lambda x: F.struct(x["id"].alias("id"), x["category"].alias("category"), x["text"].alias("text"))).alias("items"))
    rows.select(F.to_json(F.struct("items")).alias("value")).coalesce(1).write.text(path)
