"""Test sets, metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanika.functions.similarity import cer, rtf, spread, wer

# Categories in their order.
CATEGORIES = ["narration", "dialogue", "numeric", "pronunciation", "long"]
METRICS = ["cer", "wer", "utmos", "duration_sec", "rtf"]


def item_id(category: Column, index: Column, text: Column) -> Column:
    digest = F.sha1(F.concat(category, F.lit(":"), text).cast("binary"))
    return F.concat_ws("_", category, F.format_string("%04d", index), F.substring(digest, 1, 8))


def test_items(texts: DataFrame) -> DataFrame:
    """id, category, text of category and texts (array): places count blank texts, which are then left out."""
    rows = texts.select("category", F.posexplode("texts").alias("i", "raw"))
    text = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    return rows.select(item_id(F.col("category"), F.col("i"), text).alias("id"), "category", text.alias("text")).filter("text <> ''")


def check_category(category: Column) -> Column:
    """Null, or an error where the category is none of the five."""
    return F.assert_true(category.isin(CATEGORIES), F.concat(F.lit("category must be one of five, got "), F.coalesce(category, F.lit("null"))))


def by_category(items: DataFrame, category: str) -> DataFrame:
    """The items of one category; an error if it is none of the five."""
    if category not in CATEGORIES:
        raise ValueError(f"category must be one of {CATEGORIES}, got {category!r}")
    return items.filter(F.col("category") == category)


def metrics(items: DataFrame) -> DataFrame:
    """items (reference, hypothesis, generation_sec, duration_sec, ...) with cer, wer, rtf; without a hypothesis both rates are null."""
    known = F.col("hypothesis").isNotNull()
    return spread(items).withColumns({"cer": F.when(known, cer(F.col("reference"), F.col("hypothesis"), cased=False)), "wer": F.when(known, wer(F.col("reference"), F.col("hypothesis"))), "rtf": rtf(F.col("generation_sec"), F.col("duration_sec"))})


def word_error_rates(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """rows with wer in place of the two texts, of any length and any number of distinct words; a null text is empty."""
    kept = [c for c in rows.columns if c not in (reference, hypothesis, "wer")]
    return rows.select(*kept, wer(F.col(reference), F.col(hypothesis)).alias("wer"))


def report(rows: DataFrame, by: str = "category", columns: list[str] = METRICS) -> DataFrame:
    """by, n and the means of each column, nulls ignored; the row of all has by = null. One pass."""
    means = [F.avg(c).alias(f"{c}_mean") for c in columns]
    return rows.rollup(by).agg(F.count("*").alias("n"), *means)


def count_by_category(rows: DataFrame, categories: list[str] = CATEGORIES, by: str = "category") -> DataFrame:
    """A row for each category, zero if there is none."""
    every = rows.sparkSession.createDataFrame(list(enumerate(categories)), f"ord int, {by} string")
    return every.join(rows.groupBy(by).agg(F.count("*").alias("n")), by, "left").select("ord", by, F.coalesce("n", F.lit(0)).alias("n"))


def round_trip(expected: Column, heard: Column, threshold: float) -> Column:
    """struct<passed, cer>: passes at the threshold or below; what couldn't be heard passes with 0."""
    rate = cer(expected, heard)
    return F.struct(F.when(heard.isNull(), True).otherwise(rate <= threshold).alias("passed"), F.when(heard.isNull(), 0.0).otherwise(rate).alias("cer"))


def select_attempt(attempts: DataFrame, key: str, retries: int = 2) -> DataFrame:
    """key, attempt, passed, retries: the first attempt (from 0) that passed of those allowed, or the last."""
    rows = attempts.filter(F.col("attempt") <= retries)
    best = rows.groupBy(key).agg(F.min(F.when(F.col("passed"), F.col("attempt"))).alias("first"), F.max("attempt").alias("last"), F.count("*").alias("n"))
    return best.select(key, F.coalesce("first", "last").alias("attempt"), F.col("first").isNotNull().alias("passed"), F.coalesce("first", "n").cast("long").alias("retries"))


def seeds(seed: Column, retries: int) -> Column:
    """The seed of each attempt; nulls without a seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(retries)), lambda k: seed + k)


def checkpoints(listing: DataFrame) -> DataFrame:
    """step, name of names ckpt_step_N.pt; others are left out."""
    step = F.regexp_extract("name", r"^ckpt_step_(\d+)\.pt$", 1)
    return listing.select(F.nullif(step, F.lit("")).cast("long").alias("step"), "name").filter("step IS NOT NULL")


def keep_checkpoints(listing: DataFrame, keep_last: int) -> DataFrame:
    """step, name, kept of checkpoints(): the keep_last greatest steps, and step 0.

    The least step that stays is found by a top-n of each partition's steps (one row, which meets all others), so the listing is never sorted as a whole. Names of one step
    stay or go together.
    """
    rows = checkpoints(listing)
    last = rows.select("step").distinct().orderBy(F.desc("step")).limit(max(1, keep_last))
    least = F.broadcast(last.agg(F.min("step").alias("_least")))  # one row
    kept = F.lit(False) if keep_last < 1 else F.col("step") >= F.col("_least")
    return rows.crossJoin(least).select("step", "name", (kept | (F.col("step") == 0)).alias("kept"))


def latest_checkpoint(listing: DataFrame) -> DataFrame:
    """step, name of the greatest step: one aggregate."""
    return checkpoints(listing).agg(F.max("step").alias("step"), F.max_by("name", "step").alias("name"))


def log_tail(lines: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n lines: a top-n by partitions, not a sort of all."""
    return lines.orderBy(*(F.desc(c) for c in order)).limit(n)


def progress_rows(rows: DataFrame, total: int, ord_column: str = "ord", parts: int = 50) -> DataFrame:
    """Every k-th row (ord from 1) and the last, k = max(50, total div parts)."""
    k = max(50, total // parts)
    return rows.filter((F.col(ord_column) % k == 0) | (F.col(ord_column) == total))
