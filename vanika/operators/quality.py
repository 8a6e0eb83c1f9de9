"""The quality waterfall, its summary, and the splits of what passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanika.functions.similarity import cer


def waterfall(clips: DataFrame, min_sec: float = 1.5, max_sec: float = 15.0, min_snr: float = 30.0, max_silence: float = 0.25, max_cer: float = 0.10) -> DataFrame:
    """clips (duration, snr_db, silence_ratio, and reference and hypothesis texts if there are any) with whisper_cer, passed, reason.

    The first check that fails gives the reason. Error rates are only computed for clips that pass the cheap checks: these are
    taken apart before, as a Python function in a CASE would see every row. A null hypothesis passes with a null rate.
    """
    def fmt(pattern: str, *values: Column | float) -> Column:
        return F.format_string(pattern, *(v if isinstance(v, Column) else F.lit(v) for v in values))

    d, snr, silence = F.col("duration"), F.col("snr_db"), F.col("silence_ratio")
    cheap = (
        F.when((d < min_sec) | (d > max_sec), fmt("duration %.2fs out of [%s, %s]", d, str(min_sec), str(max_sec)))
        .when(snr < min_snr, fmt("snr %.1fdB < %sdB", snr, str(min_snr)))
        .when(silence > max_silence, fmt("silence %.2f > %s", silence, str(max_silence)))
    )
    rows = clips.withColumn("reason", cheap)
    failed = rows.filter("reason IS NOT NULL").withColumns({"whisper_cer": F.lit(None).cast("double"), "passed": F.lit(False)})
    alive = rows.filter("reason IS NULL")
    rate = F.lit(None).cast("double")
    if {"reference", "hypothesis"} <= set(clips.columns):
        rate = F.when(F.col("hypothesis").isNotNull(), cer(F.col("reference"), F.col("hypothesis")))
    alive = alive.withColumn("whisper_cer", rate)
    bad = F.coalesce(F.col("whisper_cer") > max_cer, F.lit(False))
    alive = alive.withColumns({"passed": ~bad, "reason": F.when(bad, fmt("cer %.3f > %s", F.col("whisper_cer"), str(max_cer))).otherwise("ok")})
    return failed.unionByName(alive)


def bypass(clips: DataFrame) -> DataFrame:
    """Every clip passes unexamined."""
    return clips.withColumns({"snr_db": F.lit(0.0), "silence_ratio": F.lit(0.0), "whisper_cer": F.lit(None).cast("double"), "passed": F.lit(True), "reason": F.lit("qc_skipped")})


def summary(clips: DataFrame, count_unreadable: bool = False) -> DataFrame:
    """One row: total, passed, and failures by reason; with count_unreadable also the clips without a duration, which have no reason."""
    reasons = ("duration", "snr", "silence", "cer")
    unreadable = [F.lit(0).cast("long").alias("unreadable")] if "duration" not in clips.columns else [F.count_if(F.col("duration").isNull()).alias("unreadable")]
    return clips.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), *(unreadable if count_unreadable else []), *(F.count_if(F.startswith("reason", F.lit(f"{r} "))).alias(f"failed_{r}") for r in reasons))


def split_of(key: Column, val_percent: float = 4.0, test_percent: float = 1.0) -> Column:
    """test, val or train by the key's SHA-1, stable whatever other keys there are."""
    share = F.conv(F.substring(F.sha1(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 0xFFFFFFFF
    test = test_percent / 100
    return F.when(share < test, "test").when(share < test + val_percent / 100, "val").otherwise("train")


def split_summary(rows: DataFrame, duration: str = "duration") -> DataFrame:
    """split, n, hours."""
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum(duration) / 3600, 2).alias("hours"))


def training_totals(rows: DataFrame, words: DataFrame, duration: str = "duration") -> DataFrame:
    """One row: rows of each split and of all, hours, and how many words there are."""
    found = rows.agg(*(F.count_if(F.col("split") == p).alias(p) for p in ("train", "val", "test")), F.count("*").alias("total"), F.round(F.sum(duration) / 3600, 2).alias("hours"))
    return found.crossJoin(words.agg(F.count("*").alias("vocab_size")))  # two single rows


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """token: distinct words between white space."""
    words = F.explode(F.split(F.coalesce(F.col(column), F.lit("")), r"(?U)\s+"))
    return rows.select(words.alias("token")).filter("token <> ''").distinct()


def build_training_set(clips: DataFrame, processed: Column, audio_path: Column, val_percent: float = 4.0, test_percent: float = 1.0) -> DataFrame:
    """audio_path, raw_text, processed_text, duration, source_id, split of the passed clips whose processed text isn't empty."""
    rows = clips.filter("passed").withColumn("processed_text", processed).filter("processed_text <> ''")
    return rows.select(audio_path.alias("audio_path"), F.col("reference").alias("raw_text"), "processed_text", "duration", "source_id", split_of(F.col("clip_id"), val_percent, test_percent).alias("split"))


def within_seconds(rows: DataFrame, low: float, high: float, column: str = "duration") -> DataFrame:
    """Rows whose duration is in the bounds, both included."""
    return rows.filter(F.col(column).between(low, high))


def loadable(rows: DataFrame, low: float = 1.0, high: float = 10.0, column: str = "duration") -> DataFrame:
    """within_seconds(), or an error when it is read and nothing is left."""
    kept = within_seconds(rows, low, high, column)
    n = kept.agg(F.count("*").alias("_n"))
    some = n.select(F.assert_true(F.col("_n") > 0, F.lit("no row has a duration in the bounds")).alias("_ok"))
    return kept.crossJoin(F.broadcast(some)).filter("_ok IS NULL").drop("_ok")  # with one row


def collate(rows: DataFrame, size: int, ord_column: str, arrays: dict[str, object]) -> DataFrame:
    """rows with batch (ord div size) and, for each array column, its length (n_...) and the array padded with its own value to the batch's longest."""
    for column, pad in arrays.items():
        rows = batches(rows, size, ord_column, column, pad).withColumnRenamed("n_ids", f"n_{column}")
    return rows


def batches(rows: DataFrame, size: int, ord_column: str, ids: str, pad: int) -> DataFrame:
    """rows with batch (ord div size), n_ids and ids padded to the batch's longest."""
    from vanika.functions.audio import pad_to
    from pyspark.sql.window import Window

    b = rows.withColumn("batch", F.floor(F.col(ord_column) / size)).withColumn("n_ids", F.size(ids))
    longest = F.max("n_ids").over(Window.partitionBy("batch"))
    filler = F.lit(pad).cast(rows.schema[ids].dataType.elementType)  # the array keeps its type
    return b.withColumn("longest", longest).withColumn(ids, pad_to(F.col(ids), F.col("longest"), filler)).drop("longest")
