"""The other files of a project: URL lists, manifests, reports, split tables, vocabularies, waveforms."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanika.sources.media import decode_wav

SOURCES = "sources array<struct<id:string,url:string,transcript_path:string,audio_path:string,duration_sec:double,status:struct<downloaded:boolean,aligned:boolean,segmented:boolean,qc_passed:boolean>,error:string>>"
QC_REPORT = "clip_id string, source_id string, duration double, snr_db double, silence_ratio double, whisper_cer double, passed int, reason string"
SPLIT = "audio_path string, raw_text string, processed_text string, duration double, source_id string"
TEST_SET = "items array<struct<id:string,category:string,text:string>>"


def fixed(column: str, digits: int) -> Column:
    """A number with so many decimals as text, rounded by its exact binary value, a tie to the even one; null: empty."""
    x, c = F.col(column).cast("double"), float(2 * 10**digits)
    n = F.rint(x * c)  # an odd one: x is near a tie, and the side follows from a product in two exact parts
    split = x * 134217729.0
    high = split - (split - x)
    side = (high * c - n) + (x - high) * c
    up, down = (n + 1) / 2, (n - 1) / 2
    whole = F.when(F.pmod(n, F.lit(2.0)) == 0, n / 2).when(side > 0, up).when(side < 0, down).when(F.pmod(down, F.lit(2.0)) == 0, down).otherwise(up)
    return F.when(x.isNull(), "").otherwise(F.format_string(f"%.{digits}f", whole / float(10**digits)))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """ord, url: lines in order, blank ones and those that begin with # left out."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.replace("value", F.lit("\r\n"), F.lit("\n")), "\n")).alias("ord", "url"))
    return rows.withColumn("url", F.regexp_replace("url", r"(?U)^\s+|\s+$", "")).filter("url <> '' AND NOT startswith(url, '#')")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length: files of a folder by name, empty ones too, which Spark's readers leave out; contents aren't read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{pattern}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    rows = sorted((str(x.getPath()), x.getLen()) for x in found if x.isFile() and not x.getPath().getName().startswith((".", "_")))
    return spark.createDataFrame(rows, "path string, length long")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """ord and the fields of each source; unknown keys are dropped, missing ones null, missing flags false."""
    rows = spark.read.schema(SOURCES).json(path, multiLine=True).select(F.posexplode("sources").alias("ord", "s")).select("ord", "s.*")
    flags = [F.coalesce(f"status.{c}", F.lit(False)).alias(c) for c in ("downloaded", "aligned", "segmented")]
    return rows.withColumn("status", F.struct(*flags, F.col("status.qc_passed").alias("qc_passed")))


def write_manifest(sources: DataFrame, path: str) -> None:
    """One JSON document with the sources by ord; a manifest lists files of a project, so it is one row in the end."""
    fields = [c for c in sources.columns if c != "ord"]
    rows = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("s")))), lambda x: x["s"]).alias("sources"))
    rows.select(F.to_json(F.struct("sources"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_qc_report(clips: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with header: fixed decimals, passed as 0 or 1, a null rate empty."""
    rows = clips.select(
        "clip_id", "source_id", *(fixed(c, n).alias(c) for c, n in (("duration", 3), ("snr_db", 2), ("silence_ratio", 3))),
        fixed("whisper_cer", 4).alias("whisper_cer"), F.col("passed").cast("int").alias("passed"), "reason",
    )
    rows.write.mode(_mode(overwrite)).csv(path, header=True, nullValue="", emptyValue="", escape='"')


def read_qc_report(spark: SparkSession, path: str, only_passed: bool = True) -> DataFrame:
    rows = spark.read.schema(QC_REPORT).csv(path, header=True, nullValue="", escape='"', multiLine=True)
    return rows.filter("passed = 1") if only_passed else rows


def write_splits(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Pipe-separated files with header, a folder for each split."""
    rows.withColumn("duration", fixed("duration", 3)).write.mode(_mode(overwrite)).partitionBy("split").csv(path, header=True, sep="|", escape='"', emptyValue="")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a split; those with too few fields are dropped."""
    rows = spark.read.schema(SPLIT + ", _bad string").csv(path, header=True, sep="|", escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return rows.filter("_bad IS NULL OR duration IS NOT NULL").drop("_bad")


def training_samples(split: DataFrame, root: str, speaker: str) -> DataFrame:
    """audio_file, text, speaker_name of a split: processed text or else raw; rows without path or text are left out."""
    text = F.coalesce(F.nullif("processed_text", F.lit("")), F.nullif("raw_text", F.lit("")))
    return split.filter("audio_path IS NOT NULL AND audio_path <> ''").select(F.concat_ws("/", F.lit(root.rstrip("/")), "audio_path").alias("audio_file"), text.alias("text"), F.lit(speaker).alias("speaker_name")).filter("text IS NOT NULL")


def write_vocabulary(tokens: DataFrame, path: str, overwrite: bool = False) -> None:
    """A sorted JSON array of tokens; its size is the alphabet's."""
    tokens.agg(F.to_json(F.sort_array(F.collect_set("token"))).alias("value")).coalesce(1).write.mode(_mode(overwrite)).text(path)


def write_tokenizer(vocabulary: DataFrame, reserved: list[str], path: str) -> None:
    """version, reserved_tokens and vocab by id as JSON."""
    vocab = F.transform(F.array_sort(F.collect_list(F.struct("id", "token"))), lambda x: x["token"])
    rows = vocabulary.agg(F.lit(1).alias("version"), F.array(*map(F.lit, reserved)).alias("reserved_tokens"), vocab.alias("vocab"))
    rows.select(F.to_json(F.struct("version", "reserved_tokens", "vocab")).alias("value")).coalesce(1).write.text(path)


def read_tokenizer(spark: SparkSession, path: str) -> DataFrame:
    """id, token."""
    return spark.read.schema("version int, reserved_tokens array<string>, vocab array<string>").json(path, multiLine=True).select(F.posexplode("vocab").alias("id", "token"))


def read_dictionary(spark: SparkSession, path: str) -> dict[str, str]:
    """The pronunciation dictionary: a project's own small file, so it becomes a map literal. Keys in lower case."""
    text = spark.read.text(path, wholetext=True).first()
    return {k.lower(): v for k, v in json.loads(text["value"]).items()} if text else {}


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEST_SET).json(path, multiLine=True).select(F.posexplode("items").alias("ord", "i")).select("ord", "i.*")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples (mono, -1 to 1) of PCM files; a file that can't be read has null samples. Through Spark's own readers; media.read_sounds() has a source of its own."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rate, samples = decode_wav(content)
                yield pa.record_batch({"path": [name], "rate": pa.array([rate], pa.int32()), "samples": pa.array([samples], pa.list_(pa.float32()))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, rate int, samples array<float>")
