"""Where rendered cues lie on a timeline."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds after the last cue, the least time that a cue is allotted, and the ratio up to which a clip isn't stretched.
TAIL, LEAST, EVEN = 0.5, 0.1, 1.001


def fit_to_cue(cues: DataFrame, rate: int, max_ratio: float = 1.3) -> DataFrame:
    """file, ord, start_sample, samples, mode of cues (file, ord, start_sec, end_sec, gen_samples), and the file's total_samples.

    A clip starts at its cue or where the one before ends. One that is too long even at max_ratio stays whole, one somewhat too long is
    stretched, a shorter one is padded. Each start depends on the lengths before it, so a file's cues are gone through in order: they lie sorted in one partition, and
    all that is held of a file, however long, is where its last clip ends. Files are independent of each other. Cues of one ord go by their times. A cue without times or samples is left out.
    """
    kinds = cues.schema["file"].dataType.simpleString()
    rows = cues.select("file", F.col("ord").cast("long").alias("ord"), *(F.col(c).cast("double").alias(c) for c in ("start_sec", "end_sec")), F.col("gen_samples").cast("long").alias("gen_samples"))
    rows = rows.filter("start_sec IS NOT NULL AND end_sec IS NOT NULL AND gen_samples IS NOT NULL")
    parts = int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def place(start: float, end: float, made: int, cursor: float) -> tuple[int, int, str]:
        start = max(start, cursor)
        allotted, length = max(LEAST, end - start), made / rate
        ratio, first = length / allotted, int(start * rate)
        if ratio > max_ratio:
            return first, made, "whole"
        if ratio > EVEN:  # a stretched clip's ratio is held within 0.5 and 2
            return first, math.floor(made / min(2.0, max(0.5, ratio))), "stretched"
        return first, made + max(0, int((allotted - length) * rate)), "padded"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = each  # no file
        cursor = 0.0
        for batch in batches:
            firsts, lengths, modes = [], [], []
            for file, start, end, made in zip(*(batch.column(c).to_pylist() for c in ("file", "start_sec", "end_sec", "gen_samples")), strict=True):
                if file != now:
                    now, cursor = file, 0.0
                first, n, mode = place(start, end, made, cursor)
                cursor = (first + n) / rate
                firsts.append(first)
                lengths.append(n)
                modes.append(mode)
            yield pa.record_batch({**{c: batch.column(c) for c in ("file", "ord", "end_sec")}, "start_sample": pa.array(firsts, pa.int64()), "samples": pa.array(lengths, pa.int64()), "mode": pa.array(modes, pa.string())})

    dealt = rows.repartition(parts, "file").sortWithinPartitions("file", "ord", "start_sec", "end_sec", "gen_samples")
    placed = dealt.mapInArrow(each, f"file {kinds}, ord long, end_sec double, start_sample long, samples long, mode string")
    file = Window.partitionBy("file")
    total = F.greatest(((F.max("end_sec").over(file) + TAIL) * rate).cast("long"), F.max(F.col("start_sample") + F.col("samples")).over(file))
    return placed.select("file", total.alias("total_samples"), "ord", "start_sample", "samples", "mode")


def natural(cues: DataFrame, rate: int, gap_ms: int) -> DataFrame:
    """cues (file, ord, gen_samples) with start_sample: back to back with a gap between."""
    gap = int(gap_ms / 1000 * rate)
    before = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return cues.withColumn("start_sample", F.coalesce(F.sum(F.col("gen_samples") + gap).over(before), F.lit(0)).cast("long"))


def atempo_steps(ratio: Column) -> Column:
    """Factors within 0.5 and 2 whose product is the ratio (above 0): doubles or halves first, then what is left."""
    up = F.greatest(F.lit(0), F.ceil(F.log2(ratio)) - 1).cast("int")
    down = F.greatest(F.lit(0), F.ceil(-F.log2(ratio)) - 1).cast("int")
    left = ratio / F.pow(F.lit(2.0), up) * F.pow(F.lit(2.0), down)
    return F.concat(F.array_repeat(F.lit(2.0), up), F.array_repeat(F.lit(0.5), down), F.array(left))


def chain_length(ratio: float) -> int:
    """How many steps atempo_steps() gives."""
    return max(1, math.ceil(abs(math.log2(ratio))))
