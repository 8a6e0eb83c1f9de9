"""Identifiers, registration of sources, stages and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where a video's id is in its URL.
URL_ID = r"(?:v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{6,})"


def stable_id(url: Column, index: Column) -> Column:
    """src_ and the id in the URL, or the index in five digits."""
    found = F.regexp_extract(url, URL_ID, 1)
    return F.concat(F.lit("src_"), F.when(found != "", found).otherwise(F.format_string("%05d", index)))


def assign_ids(sources: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """sources (ord, url) with id: one that an earlier row or an existing source (id) has gets its index appended."""
    rows = sources.withColumn("base", stable_id(F.col("url"), F.col("ord")))
    again = F.row_number().over(Window.partitionBy("base").orderBy("ord")) > 1
    if existing is not None:
        rows = rows.join(existing.select(F.col("id").alias("base")).distinct().withColumn("known", F.lit(True)), "base", "left")
        again = again | F.coalesce("known", F.lit(False))
    rows = rows.withColumn("id", F.when(again, F.concat("base", F.lit("_"), F.format_string("%05d", F.col("ord")))).otherwise(F.col("base")))
    return rows.drop("base", "known")


def rank(rows: DataFrame, key: str, name: str = "ord") -> DataFrame:
    """rows with their place (from 0) in the order of the key, counted range by range: no task sees all rows."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Cuts of any type, from keys that a hash chooses: they only say which task counts a row. They are fixed here, so that a later evaluation ranks alike.
    every = max(1, rows.count() // (200 * n))
    keys = sorted(r[0] for r in rows.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).select(key).distinct().collect())
    bounds = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []

    def part_of(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) >= F.lit(bounds[mid]), part_of(mid + 1, hi)).otherwise(part_of(lo, mid))

    rows = rows.withColumn("_part", part_of(0, len(bounds)))
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    base, at = [], 0
    for p in range(len(bounds) + 1):
        base.append(at)
        at += sizes.get(p, 0)
    first = F.element_at(F.array(*(F.lit(b).cast("long") for b in base)), F.col("_part") + 1)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return rows.withColumn(name, (first + within).cast("long")).drop("_part")


def zip_sources(urls: DataFrame, transcripts: DataFrame) -> DataFrame:
    """ord, url, transcript_path: the n-th URL (ord, url) with the n-th transcript (ord, path)."""
    return urls.join(transcripts.select("ord", F.col("path").alias("transcript_path")), "ord").select("ord", "url", "transcript_path")


def assert_equal_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row with both counts, or an error when it is read and they differ."""
    both = a.agg(F.count("*").alias("a")).crossJoin(b.agg(F.count("*").alias("b")))  # two single rows
    return both.select("a", "b", F.assert_true(F.col("a") == F.col("b"), F.concat(F.lit("counts differ: "), "a", F.lit(" and "), "b")).alias("ok"))


def new_sources(urls: DataFrame, known: DataFrame) -> DataFrame:
    """URLs that aren't registered yet; copies within urls stay."""
    return urls.join(known.select("url").distinct(), "url", "left_anti")


def existing_clips(clips: DataFrame, files: DataFrame) -> DataFrame:
    """Clips that have both a sound file and a text among files (clip_id, kind)."""
    for kind in ("wav", "txt"):
        clips = clips.join(files.filter(F.col("kind") == kind).select("clip_id"), "clip_id", "left_semi")
    return clips


def register(urls: DataFrame, transcripts: DataFrame, known: DataFrame) -> DataFrame:
    """ord, url, transcript_path, id of the sources that known (id, url) lacks: the n-th URL (ord, url) has the n-th transcript (ord, path)."""
    return assign_ids(new_sources(zip_sources(urls, transcripts), known), known).select("ord", "url", "transcript_path", "id")


def at_stage(sources: DataFrame, flag: str) -> DataFrame:
    """The sources that the stage before has done; null counts as not done."""
    return sources.filter(F.coalesce(F.col(flag), F.lit(False)))


def of_sources(rows: DataFrame, sources: DataFrame, flag: str) -> DataFrame:
    """Rows (source_id, ...) of the sources (id, ...) that the flag holds for."""
    return rows.join(at_stage(sources, flag).select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")


def outcomes(rows: DataFrame, names: list[str], column: str = "outcome") -> DataFrame:
    """One row: how many rows have each outcome, and all of them."""
    return rows.agg(*(F.count_if(F.col(column) == n).alias(n) for n in names), F.count("*").alias("total"))


def fetched(sources: DataFrame, files: DataFrame) -> DataFrame:
    """sources (id, ...) with there: a file (id, length) of theirs exists and isn't empty."""
    whole = files.filter("length > 0").select("id").distinct().withColumn("there", F.lit(True))
    return sources.join(whole, "id", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def by_id(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one id, if there is one."""
    return rows.filter(F.col(key) == F.lit(value))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without output yet."""
    return rows.join(done.select(key), key, "left_anti")


def stage_rollup(sources: DataFrame, flags: list[str], exported: bool | None = None) -> DataFrame:
    """One row: sources, how many have each flag (null counts as false), and, if given, whether an engine is exported."""
    engine = [] if exported is None else [F.lit(exported).alias("engine_exported")]
    return sources.agg(F.count("*").alias("sources"), *engine, *(F.count_if(F.coalesce(f, F.lit(False))).alias(f) for f in flags))


def clip_id(source_id: Column, index: Column) -> Column:
    return F.concat(source_id, F.lit("_c"), F.format_string("%06d", index))


def staged_name(index: Column, name: Column) -> Column:
    return F.concat(F.format_string("%05d", index), F.lit("_"), safe_filename(name))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def is_safe_project(name: Column) -> Column:
    return name.rlike(r"^[\p{L}\p{N}_-]+$")


def is_srt(name: Column) -> Column:
    return F.lower(name).endswith(".srt")
