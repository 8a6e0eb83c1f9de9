"""Cues snapped to the nearest word boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds around a cue in which words count, and the least duration of a repaired cue.
MARGIN, LEAST = 1.0, 0.3


def snap(cues: DataFrame, words: DataFrame, margin: float = MARGIN, least: float = LEAST) -> DataFrame:
    """cues (source_id, ord, start_sec, end_sec, ...) with start_sec and end_sec moved to the nearest word's start and end.

    words: source_id, ord, start, end. A word counts for a start if that lies within the cue's margin, and so for ends; of equally
    near ones the first by ord is taken. Cues meet words by source and by a time slot as wide as the margin, so a source's words aren't compared with
    all of its cues; the slots of a cue are as many as its length has.
    """
    width = 2 * margin

    def slot(t: Column) -> Column:
        return F.floor(t / width)

    low, high = F.col("start_sec") - margin, F.col("end_sec") + margin
    spans = cues.filter(high >= low).select("source_id", F.col("ord").alias("cue"), "start_sec", "end_sec", F.explode(F.sequence(slot(low), slot(high))).alias("slot"))
    out = cues
    for side, column in (("start", "start_sec"), ("end", "end_sec")):
        own = words.select("source_id", F.col("ord").alias("word"), F.col(side).alias("at"), slot(F.col(side)).alias("slot"))
        near = spans.join(own, ["source_id", "slot"]).filter((F.col("at") >= low) & (F.col("at") <= high))
        best = near.groupBy("source_id", "cue").agg(F.min(F.struct(F.abs(F.col("at") - F.col(column)).alias("gap"), "word", "at")).alias("m"))
        out = out.join(best.select("source_id", F.col("cue").alias("ord"), F.col("m.at").alias(f"new_{side}")), ["source_id", "ord"], "left")
    start = F.coalesce("new_start", "start_sec")
    end = F.coalesce("new_end", "end_sec")
    repaired = F.when(end <= start, start + F.greatest(F.lit(least), F.col("end_sec") - F.col("start_sec"))).otherwise(end)
    return out.withColumns({"start_sec": start, "end_sec": repaired}).drop("new_start", "new_end")
