"""SRT subtitles: read, parse, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STAMP = r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, value: each file's whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def _seconds(stamp: Column) -> Column:
    part = [F.regexp_extract(F.trim(stamp), STAMP, k).cast("double") for k in range(1, 5)]
    return F.when(F.trim(stamp).rlike(STAMP), part[0] * 3600 + part[1] * 60 + part[2] + part[3] / 1000)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse(files: DataFrame) -> DataFrame:
    """path, ord, index, start_sec, end_sec, text, error: the cues of each file (path, value), in order. See parse_blocks()."""
    text = _strip(F.replace(F.replace(F.regexp_replace("value", "^﻿", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    return parse_blocks(files.select("path", F.posexplode(F.split(text, "\n\n")).alias("ord", "block")))


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """path, ord, index, start_sec, end_sec, text, error: the cues of each file's blocks (path, ord, block), which lie between empty lines.

    A block needs two lines that aren't blank, one arrow and text. A missing number is the count of cues so far plus one; one that no
    long holds is null. A block with a malformed stamp is left out; a file with a time line of two arrows or more is one row with an error.
    """
    lines = F.filter(F.split("block", "\n"), lambda x: _strip(x) != "")
    rows = blocks.select("path", "ord", lines.alias("lines")).filter(F.size("lines") >= 2)
    first = _strip(F.get("lines", F.lit(0)))
    rows = rows.withColumn("numbered", first.rlike("^[+-]?[0-9]+$")).withColumn("number", F.when(F.col("numbered"), first.try_cast("long")))
    rows = rows.withColumn("times", F.when(F.col("numbered"), F.get("lines", F.lit(1))).otherwise(F.get("lines", F.lit(0))))
    rest = F.slice("lines", F.when(F.col("numbered"), 3).otherwise(2), F.size("lines"))
    rows = rows.filter(F.contains("times", F.lit("-->"))).withColumn("sides", F.split("times", "-->"))
    rows = rows.withColumn("text", F.array_join(F.transform(rest, _strip), " "))
    rows = rows.withColumn("start_sec", _seconds(F.get("sides", F.lit(0)))).withColumn("end_sec", _seconds(F.get("sides", F.lit(1))))
    broken = F.when(F.size("sides") > 2, "two arrows").when(F.col("start_sec").isNull() | F.col("end_sec").isNull(), "malformed time")
    by_file = Window.partitionBy("path")
    rows = rows.withColumn("error", F.min(F.when(F.size("sides") > 2, "two arrows")).over(by_file)).withColumn("own", broken)
    good = F.col("error").isNull() & F.col("own").isNull() & (F.col("text") != "")
    in_file = Window.partitionBy("path").orderBy("ord")
    so_far = F.count(F.when(good, 1)).over(in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("index", F.when(F.col("numbered"), F.col("number")).otherwise(so_far)).withColumn("first", F.row_number().over(in_file) == 1)
    kept = rows.filter(good | (F.col("error").isNotNull() & F.col("first")))  # a file with an error keeps one row, of nulls but for that
    return kept.select("path", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("ord", "index", "start_sec", "end_sec", "text")), "error")


def stamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm of seconds rounded to the nearest millisecond (to even), carried where it is 1000."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    def two(x: Column, n: int = 2) -> Column:
        return F.lpad(x.cast("string"), n, "0")

    hours = F.floor(ms / 3_600_000)
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), two(ms % 1000, 3))


def format_files(cues: DataFrame) -> DataFrame:
    """path, value: the SRT text of each file's cues (path, ord, start_sec, end_sec, text), numbered from 1 by ord.

    A file's cues are brought together, as they are one text in the end.
    """
    rows = cues.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("ord")))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), stamp(F.col("start_sec")), F.lit(" --> "), stamp(F.col("end_sec")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n").alias("value"))


def write(cues: DataFrame, path: str) -> None:
    """One text file a row in the folder, by format_files(); files keep whole texts."""
    format_files(cues).repartition("path").write.option("lineSep", "").partitionBy("path").text(path)
