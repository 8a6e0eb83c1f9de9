"""Whole flows of a speech project: one plan from sources to training rows, and the steps that it is made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanika.functions import audio, text, tokens
from vanika.operators import align, manifest, quality
from vanika.sources import reports


def segment(cues: DataFrame, sounds: DataFrame, least: float = 1.5, most: float = 15.0, pad_ms: int = 50, done: DataFrame | None = None, threshold_db: float = -40.0) -> DataFrame:
    """clip_id, source_id, text, duration, samples, rate, outcome of every cue (source_id, index, start_sec, end_sec, text) of a source with sound (source_id, rate, samples).

    outcome: rejected where the cue's seconds are out of bounds or what is left after trimming is under the least (the most isn't checked again), skipped where done (clip_id) has
    it, else created; only created clips keep their samples.
    """
    rows = cues.join(sounds, "source_id").withColumn("clip_id", manifest.clip_id(F.col("source_id").cast("string"), F.col("index")))
    rows = rows.withColumn("duration", F.col("end_sec") - F.col("start_sec"))
    if done is not None:
        rows = rows.join(done.select("clip_id").distinct().withColumn("_done", F.lit(True)), "clip_id", "left")
    else:
        rows = rows.withColumn("_done", F.lit(None).cast("boolean"))
    inside = F.col("duration").between(least, most)
    rate = F.col("rate")
    start = F.greatest(F.lit(0), F.floor(F.col("start_sec") * rate).cast("int"))
    cut = F.slice("samples", start + 1, F.greatest(F.lit(0), F.floor(F.col("duration") * rate).cast("int")))
    rows = rows.withColumn("samples", F.when(inside & F.col("_done").isNull(), cut)).withColumn("samples", audio.trim_silence_at(F.col("samples"), rate, pad_ms, threshold_db))
    whole = F.size("samples") >= F.floor(F.lit(least) * rate)
    outcome = F.when(~inside, "rejected").when(F.col("_done"), "skipped").when(whole, "created").otherwise("rejected")
    rows = rows.withColumn("outcome", outcome).withColumn("samples", F.when(F.col("outcome") == "created", F.col("samples")))
    return rows.select("clip_id", "source_id", "text", "duration", "rate", "samples", "outcome")


def measured(clips: DataFrame, frame: int = 2048) -> DataFrame:
    """Created clips with their duration after trimming, snr_db and silence_ratio."""
    made = clips.filter("outcome = 'created'")
    return made.withColumns({"duration": F.size("samples") / F.col("rate"), "snr_db": audio.snr_db(F.col("samples"), frame), "silence_ratio": audio.silence_ratio(F.col("samples"), frame=frame)})


def training_set(sources: DataFrame, cues: DataFrame, words: DataFrame, sounds: DataFrame, heard: DataFrame | None = None, skip_qc: bool = False, frontend: Callable[[Column], Column] | None = None, frame: int = 2048, min_sec: float = 1.5, max_sec: float = 15.0, min_snr: float = 30.0, max_silence: float = 0.25, max_cer: float = 0.05) -> DataFrame:
    """The training rows of the sources (id, aligned): their cues are snapped to words, cut into clips, filtered by quality (unless skip_qc) and written for speech.

    heard: clip_id, hypothesis; without it no error rate is checked. frontend: the text's own, without prosody tokens unless given. The bounds are those of a new project; min_sec and max_sec
    hold for cues and for clips. One plan: nothing is stored between the steps; project.Project keeps what each step has made.
    """
    own = manifest.of_sources(cues, sources, "aligned")
    snapped = align.snap(own.withColumn("ord", F.col("index")), words)
    clips = measured(segment(snapped, sounds, min_sec, max_sec), frame).withColumn("reference", F.col("text")).drop("samples")
    clips = clips.join(heard, "clip_id", "left") if heard is not None else clips.withColumn("hypothesis", F.lit(None).cast("string"))
    judged = quality.bypass(clips) if skip_qc else quality.waterfall(clips, min_sec, max_sec, min_snr, max_silence, max_cer)
    spoken = (frontend or (lambda t: text.frontend(t, prosody=False)))(F.col("reference"))
    return quality.build_training_set(judged, spoken, F.concat_ws("/", "source_id", F.concat("clip_id", F.lit(".wav"))))


def prepare(train: DataFrame, val: DataFrame, path: str | None = None) -> DataFrame:
    """reports.ready() of both parts (processed_text, duration), with the tokenizer fitted on both; with a path, the vocabulary and ready.json's row are written there."""
    from vanika.sources import files

    texts = train.select("processed_text").unionByName(val.select("processed_text"))
    vocabulary = tokens.fit(texts, column="processed_text")
    row = reports.ready(train, val, vocabulary)
    if path:
        files.write_tokenizer(vocabulary, tokens.RESERVED, f"{path}/tokenizer_json")
        reports.write_json(row, f"{path}/ready_json")
    return row


def _pipe_table(spark: SparkSession, root: str, split: str) -> DataFrame:
    """A split that files.write_splits() has written below the project's training_set."""
    from vanika.sources import files

    return files.training_samples(files.read_split(spark, f"{root}/training_set/split={split}"), root, "hindi")


#: Readers of a split's samples (session, project's root, split) by the name that a training run asks for.
FORMATTERS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {"hindi_csv": _pipe_table}


def register_formatter(name: str, reader: Callable[[SparkSession, str, str], DataFrame]) -> None:
    """Add a reader. One of the same name stays as it is if it is the same, and is an error if not."""
    if FORMATTERS.setdefault(name, reader) is not reader:
        raise ValueError(f"there is another formatter of the name {name!r}")


def samples(spark: SparkSession, root: str, split: str, formatter: str = "hindi_csv") -> DataFrame:
    """audio_file, text, speaker_name of a project's split, by the formatter of that name."""
    if formatter not in FORMATTERS:
        raise ValueError(f"no formatter {formatter!r}; there are {sorted(FORMATTERS)}")
    return FORMATTERS[formatter](spark, root.rstrip("/"), split)
