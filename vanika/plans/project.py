"""A project that is run again and again: sources with their stages, of which each run does what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vanika.functions import text
from vanika.operators import align, manifest, quality
from vanika.plans import flows
from vanika.sources import files, srt
from vanika.sources.reports import SETTINGS
from vanika.sources.store import Store

SOURCES = "ord long, id string, url string, transcript_path string, duration_sec double, downloaded boolean, aligned boolean, segmented boolean, qc_passed boolean, error string"
PARSED = "path string, ord int, start_sec double, end_sec double, text string, error string"
CUES = "source_id string, index long, start_sec double, end_sec double, text string"
CLIPS = "clip_id string, source_id string, text string, duration double, rate int, samples array<float>, outcome string, bounds string"
JUDGED = "clip_id string, source_id string, reference string, duration double, snr_db double, silence_ratio double, whisper_cer double, passed boolean, reason string, settings string"
SPOKEN = "clip_id string, processed_text string"
TRAINING = "audio_path string, raw_text string, processed_text string, duration double, source_id string, split string"


class Project:
    """A project's tables in a Store: sources (replaced by each stage), cues, clips, judgements and spoken texts (added to), and the training rows and a run's parsed transcripts (replaced).

    Sounds, word times and what was heard come from outside, as tables. Every stage writes its rows before it sets its flag: a run that breaks between the two
    finds the rows next time, counts them as skipped and sets the flag. settings are those of a project (see reports.SETTINGS); clips that were rejected and clips that were judged by other
    settings are looked at again, cut ones are kept. frame: samples of a frame of the clips' statistics.
    """

    def __init__(self, spark: SparkSession, root: str, settings: dict | None = None, frame: int = 2048, threshold_db: float = -40.0) -> None:
        self.spark, self.store, self.frame, self.threshold_db = spark, Store(spark, root), frame, threshold_db
        self.settings = SETTINGS | (settings or {}) | {"qc": SETTINGS["qc"] | (settings or {}).get("qc", {})}

    def sources(self) -> DataFrame:
        return self.store.version("sources", SOURCES)

    def cues(self) -> DataFrame:
        return self.store.batches("cues", CUES)

    def clips(self) -> DataFrame:
        """One outcome of each clip: created, or else by today's bounds if there is one."""
        first = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.col("outcome") != "created", F.col("bounds") != self._bounds()))
        return self.store.batches("clips", CLIPS).withColumn("_place", first).filter("_place = 1").drop("_place")

    def judged(self, skip_qc: bool = False) -> DataFrame:
        """The judgements by today's settings."""
        return self.store.batches("judged", JUDGED).filter(F.col("settings") == self._judging(skip_qc))

    def training(self) -> DataFrame:
        return self.store.version("training", TRAINING)

    def register(self, urls: DataFrame, transcripts: DataFrame) -> int:
        """Add sources that aren't there: the n-th URL (ord, url) has the n-th transcript (ord, path); an error if there aren't as many. How many are new."""
        manifest.assert_equal_counts(urls, transcripts).collect()
        known = self.sources()
        rows = manifest.register(urls, transcripts, known.select("id", "url"))
        first = {"duration_sec": F.lit(None).cast("double"), "qc_passed": F.lit(None).cast("boolean"), "error": F.lit(None).cast("string")} | {c: F.lit(False) for c in ("downloaded", "aligned", "segmented")}
        before = known.count()
        self.store.replace("sources", known.unionByName(rows.withColumns(first).select(*known.columns)))
        return self.sources().count() - before

    def run(self, sounds: DataFrame, transcripts: DataFrame, words: DataFrame | None = None, heard: DataFrame | None = None, skip_qc: bool = False, frontend: Callable[[Column], Column] | None = None) -> dict[str, dict[str, int | float]]:
        """All stages, and what each has counted.

        sounds: source_id, rate, samples. transcripts: path, value (whole SRT files). words: source_id, ord, start, end; without it cues keep their times. heard: clip_id, hypothesis; without it, or where
        it is null, no error rate is checked. An error without any source. Nulls in sounds' samples count as missing.
        """
        if self.sources().isEmpty():
            raise ValueError("no sources: register() some first")
        return {
            "download": self.download(sounds), "align": self.align(transcripts, words), "segment": self.segment(sounds),
            "qc": self.quality(heard, skip_qc), "dataset": self.dataset(skip_qc, frontend),
        }

    def _update(self, found: DataFrame, columns: dict[str, Column]) -> None:
        """Replace the sources by themselves with changed columns, which may use those of found (id, ...)."""
        rows = self.sources()
        self.store.replace("sources", rows.join(found, "id", "left").withColumns(columns).select(*rows.columns))

    def download(self, sounds: DataFrame) -> dict[str, int]:
        """A source whose sound is there, and isn't empty, is downloaded."""
        there = sounds.filter(F.size("samples") > 0).groupBy(F.col("source_id").alias("id")).agg(F.max(F.size("samples") / F.col("rate")).alias("sec"))
        rows = self.sources().join(there, "id", "left").withColumn("outcome", F.when(F.col("downloaded"), "skipped").when(F.col("sec").isNotNull(), "downloaded").otherwise("failed"))
        counts = manifest.outcomes(rows, ["downloaded", "skipped", "failed"]).first().asDict()
        now = F.col("downloaded") | F.col("sec").isNotNull()
        self._update(there, {"error": F.when(~now, "no sound").otherwise(F.nullif("error", F.lit("no sound"))), "duration_sec": F.coalesce("duration_sec", "sec"), "downloaded": now})
        return counts

    def align(self, transcripts: DataFrame, words: DataFrame | None) -> dict[str, int]:
        """The cues of downloaded sources that have none yet, snapped to words. fallback_used: sources without words."""
        ready = manifest.at_stage(self.sources(), "downloaded").select("id", "transcript_path")
        done = self.cues().select(F.col("source_id").alias("id")).distinct()
        todo = manifest.pending(ready, done, "id")
        files = transcripts.join(todo.select(F.col("transcript_path").alias("path")), "path", "left_semi")
        # Parsed once: the cues, the joins that snap them and the errors all read this table.
        self.store.replace("parsed", srt.parse(files).select(*(c.split()[0] for c in PARSED.split(", "))))
        parsed = self.store.version("parsed", PARSED)
        own = todo.join(parsed.select(F.col("path").alias("transcript_path"), "ord", "start_sec", "end_sec", "text").filter("ord IS NOT NULL"), "transcript_path")
        # The aligned file is written anew, so cues are numbered from 1.
        own = own.select(F.col("id").alias("source_id"), F.row_number().over(Window.partitionBy("id").orderBy("ord")).cast("long").alias("index"), "start_sec", "end_sec", "text")
        snapped = own if words is None else align.snap(own.withColumn("ord", F.col("index")), words)
        number = self.store.append("cues", snapped.select("source_id", "index", "start_sec", "end_sec", "text"))
        new = self.store.batch("cues", CUES, number).select(F.col("source_id").alias("id")).distinct()
        said = new if words is None else new.join(words.select(F.col("source_id").alias("id")), "id", "left_anti")
        bad = parsed.groupBy(F.col("path").alias("transcript_path")).agg(F.min("error").alias("why"))
        listed = files.select(F.col("path").alias("transcript_path"), F.lit(True).alias("listed")).distinct()
        failed = manifest.pending(todo, new, "id").join(listed, "transcript_path", "left").join(bad, "transcript_path", "left")
        failed = failed.select("id", F.when(F.col("listed").isNull(), "transcript missing").otherwise(F.concat(F.lit("alignment failed: "), F.coalesce("why", F.lit("transcript has no cues")))).alias("why"))
        total, n = ready.count(), new.count()
        counts = {"aligned": n, "skipped": ready.join(done, "id", "left_semi").count(), "fallback_used": said.count()}
        counts["failed"] = total - n - counts["skipped"]
        found = new.union(done).distinct().withColumn("has", F.lit(True)).join(failed, "id", "full")
        self._update(found, {"aligned": F.coalesce("has", F.lit(False)), "error": F.when(F.col("has"), None).otherwise(F.coalesce("why", "error"))})
        return counts

    def _bounds(self) -> str:
        return f"{self.settings['clip_min_seconds']} {self.settings['clip_max_seconds']}"

    def segment(self, sounds: DataFrame) -> dict[str, int]:
        """Clips of aligned sources' cues; cut ones aren't cut again, and rejected ones only by other bounds."""
        sources = manifest.at_stage(self.sources(), "aligned")
        cues = manifest.of_sources(self.cues(), self.sources(), "aligned").withColumn("clip_id", manifest.clip_id(F.col("source_id"), F.col("index")))
        before = self.clips().select("clip_id", F.col("outcome").alias("was"), "bounds")
        kept = before.filter((F.col("was") == "created") | (F.col("bounds") == self._bounds()))
        least, most = self.settings["clip_min_seconds"], self.settings["clip_max_seconds"]
        made = flows.segment(manifest.pending(cues, kept, "clip_id").drop("clip_id"), sounds, least, most, threshold_db=self.threshold_db)
        number = self.store.append("clips", made.withColumn("bounds", F.lit(self._bounds())))
        new = manifest.outcomes(self.store.batch("clips", CLIPS, number), ["created", "rejected"]).first()
        inside = (F.col("end_sec") - F.col("start_sec")).between(least, most)
        old = cues.join(kept, "clip_id").agg(F.count_if((F.col("was") == "created") & inside).alias("skipped"), F.count_if((F.col("was") != "created") | ~inside).alias("rejected")).first()
        counts = {"clips_created": new["created"], "clips_skipped_existing": old["skipped"], "clips_rejected": new["rejected"] + old["rejected"], "sources_processed": sources.count()}
        self._update(sources.select("id", F.lit(True).alias("cut")), {"segmented": F.col("segmented") | F.coalesce("cut", F.lit(False))})
        return counts

    def _judging(self, skip_qc: bool) -> str:
        qc = self.settings["qc"]
        return "skipped" if skip_qc else f"{self._bounds()} {qc['min_snr_db']} {qc['max_silence_ratio']} {qc['max_cer_vs_whisper']}"

    def quality(self, heard: DataFrame | None, skip_qc: bool) -> dict[str, int]:
        """Judge the clips that today's settings haven't seen. Sources whose clips were looked at have qc_passed."""
        clips = manifest.of_sources(self.clips().filter("outcome = 'created'"), self.sources(), "segmented")
        todo = flows.measured(manifest.pending(clips, self.judged(skip_qc), "clip_id"), self.frame).withColumn("reference", F.col("text"))
        todo = todo.withColumn("hypothesis", F.lit(None).cast("string")) if heard is None else todo.join(heard.select("clip_id", "hypothesis").dropDuplicates(["clip_id"]), "clip_id", "left")
        qc = self.settings["qc"]
        if skip_qc:
            found = quality.bypass(todo)
        else:
            found = quality.waterfall(todo, self.settings["clip_min_seconds"], self.settings["clip_max_seconds"], qc["min_snr_db"], qc["max_silence_ratio"], qc["max_cer_vs_whisper"])
        self.store.append("judged", found.withColumn("settings", F.lit(self._judging(skip_qc))).select(*(c.split()[0] for c in JUDGED.split(", "))))
        seen = manifest.at_stage(self.sources(), "segmented").select("id", F.lit(True).alias("seen"))
        self._update(seen, {"qc_passed": F.coalesce("seen", "qc_passed")})
        return quality.summary(self.judged(skip_qc)).first().asDict()

    def dataset(self, skip_qc: bool, frontend: Callable[[Column], Column] | None) -> dict[str, int | float]:
        """The training rows of all passed clips; texts that were written for speech before aren't again."""
        passed = self.judged(skip_qc).filter("passed")
        new = manifest.pending(passed, self.store.batches("spoken", SPOKEN), "clip_id")
        speak = frontend or (lambda t: text.frontend(t, prosody=False))
        self.store.append("spoken", new.select("clip_id", speak(F.col("reference")).alias("processed_text")))
        rows = passed.join(self.store.batches("spoken", SPOKEN).dropDuplicates(["clip_id"]), "clip_id")
        self.store.replace("training", quality.build_training_set(rows, F.col("processed_text"), F.concat_ws("/", "source_id", F.concat("clip_id", F.lit(".wav")))))
        training = self.training()
        return quality.training_totals(training, quality.vocabulary(training, "processed_text")).first().asDict()


    def export(self, folder: str, skip_qc: bool = False) -> None:
        """The training rows as pipe tables by split, their vocabulary and the quality report, in folders that Spark writes; what was there goes."""
        training = self.training()
        files.write_splits(training, folder, overwrite=True)
        files.write_vocabulary(quality.vocabulary(training, "processed_text"), f"{folder}/vocabulary_json", overwrite=True)
        files.write_qc_report(self.judged(skip_qc), f"{folder}/qc_report_csv", overwrite=True)


def counted(spark: SparkSession, runs: list[dict[str, dict[str, int | float]]]) -> DataFrame:
    """run, stage, outcome, n: what runs have counted, one row a counter."""
    rows = [(k, stage, name, float(n or 0)) for k, found in enumerate(runs, 1) for stage, counts in found.items() for name, n in counts.items()]
    return spark.createDataFrame(rows, "run int, stage string, outcome string, n double")
