"""Folders of sound files, subtitles and logs as Spark data sources: `wav`, `srt`, `log`.

Readers give each task files of about TASK_BYTES together, or a part of a log. Writers give each task a folder of its own below the target; only the files of tasks
that succeeded are renamed into place when the whole job has, so a task that fails or runs twice leaves nothing behind. Files are reached by Arrow's file systems: a path may be a folder
or any URI that they know (file, s3, gs, hdfs).
"""

from __future__ import annotations

import io
import itertools
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of files that one task reads, and bytes that are read at once.
TASK_BYTES, CHUNK = 64 << 20, 1 << 16


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str, ending: str) -> list[tuple[str, int]]:
    """Files of a folder (or one file) by name, with their bytes; what a writer has not committed is none of them."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    own = len(at.rstrip("/")) + 1
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(ending) and not any(p.startswith((".", "_")) for p in f.path[own:].split("/")))


class Paths(InputPartition):
    """Files of one task."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _FilesReader(DataSourceReader):
    ending = ""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        out: list[list[str]] = []
        size = TASK_BYTES + 1
        for path, n in _files(self.path, self.ending):
            if size + n > TASK_BYTES:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Paths(x) for x in out]


@dataclass
class Written(WriterCommitMessage):
    """A task's files: their names, and where they lie until they are committed."""

    files: list[tuple[str, str]]


class _FilesWriter(DataSourceArrowWriter):
    """Subclasses give (name, bytes) pairs, the pieces of a file one after another."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.aside = f"{self.path}/.aside-{uuid.uuid4().hex}"

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, aside = _open(f"{self.aside}/{uuid.uuid4().hex}")
        system.create_dir(aside, recursive=True)
        files: list[tuple[str, str]] = []
        for number, (name, parts) in enumerate(itertools.groupby(self.pieces(iterator), key=lambda x: x[0])):
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"not a file's name: {name!r}")
            at = f"{aside}/{number}"
            with system.open_output_stream(at) as out:
                for _, data in parts:
                    out.write(data)
            files.append((name, at))
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [name for name, _ in files]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError(f"several files of one name: {sorted({n for n in names if names.count(n) > 1})[:5]}")
        system, at = _open(self.path)
        if self.overwrite:
            for path, _ in _files(self.path, ""):
                system.delete_file(path)
        for name, staged in files:
            system.move(staged, f"{at}/{name}")
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, aside = _open(self.aside)
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)


# --- sounds


def decode_wav(content: bytes) -> tuple[int | None, np.ndarray | None]:
    """rate and samples (mono, -1 to 1) of a PCM file of 1 to 4 bytes a sample; nulls if it can't be read."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            frames = w.readframes(w.getnframes())
        if width == 3:  # the missing low byte is zero
            frames, width = np.pad(np.frombuffer(frames, np.uint8).reshape(-1, 3), ((0, 0), (1, 0))).tobytes(), 4
        raw = np.frombuffer(frames, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
        raw = (raw - 128) / 128 if width == 1 else raw / float(1 << (8 * width - 1))
        return rate, raw.reshape(-1, channels).mean(axis=1).astype(np.float32)
    except (wave.Error, EOFError, KeyError, ValueError):
        return None, None


def encode_wav(rate: int, samples: np.ndarray) -> bytes:
    """A RIFF file of 16-bit samples; what is louder than 1 is cut off."""
    data = io.BytesIO()
    with wave.open(data, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes(np.clip(np.rint(np.asarray(samples, np.float64) * 32767), -32768, 32767).astype("<i2").tobytes())
    return data.getvalue()


class _SoundsReader(_FilesReader):
    ending = ".wav"

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                rate, samples = decode_wav(f.read())
            yield pa.record_batch({"path": [path], "rate": pa.array([rate], pa.int32()), "samples": pa.array([samples], pa.list_(pa.float32()))})


class _SoundsWriter(_FilesWriter):
    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for name, rate, samples in zip(batch.column("path").to_pylist(), batch.column("rate").to_pylist(), batch.column("samples"), strict=True):
                if name is not None and rate is not None and samples.is_valid:
                    yield name, encode_wav(rate, samples.values.to_numpy(zero_copy_only=False))


class Sounds(DataSource):
    """`wav`: path, rate, samples. A file that can't be read has nulls; a row with a null is not written. path is a file's name when it is written."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, rate int, samples array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SoundsReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _FilesWriter:
        return _SoundsWriter(self.options, overwrite)


# --- subtitles


def stamp(seconds: float) -> str:
    """HH:MM:SS,mmm of seconds rounded to the nearest millisecond (to even)."""
    ms = round(max(0.0, seconds) * 1000)
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


class _SubtitlesReader(_FilesReader):
    ending = ".srt"

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = _open(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f, io.TextIOWrapper(io.BufferedReader(f, CHUNK), encoding="utf-8-sig", newline=None) as text:
                lines: list[str] = []
                number = 0
                for line in itertools.chain(text, [""]):
                    line = line.rstrip("\n")
                    if line:
                        lines.append(line)
                    elif lines:
                        yield path, number, "\n".join(lines)
                        lines, number = [], number + 1


class _SubtitlesWriter(_FilesWriter):
    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        now, number = None, 0
        for batch in batches:
            for name, start, end, text in zip(*(batch.column(c).to_pylist() for c in ("path", "start_sec", "end_sec", "text")), strict=True):
                number = number + 1 if name == now else 1
                now = name
                yield name, f"{'' if number == 1 else chr(10)}{number}\n{stamp(start)} --> {stamp(end)}\n{text}\n".encode()


class Subtitles(DataSource):
    """`srt`: reads path, ord, block (blocks between empty lines, for srt.parse_blocks()); writes path, start_sec, end_sec, text, the cues of a file one after another.

    Both go through a file of any length piece by piece.
    """

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return "path string, ord int, block string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SubtitlesReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _FilesWriter:
        return _SubtitlesWriter(self.options, overwrite)


# --- logs that grow


class Span(InputPartition):
    """Whole lines of a file that begin in [start, end)."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def _end_of_lines(f: pa.NativeFile, size: int, lines: int) -> int:
    """Where the last so many whole lines before size begin; with 0 lines, where the last whole line ends."""
    at, left = size, lines + 1
    while at > 0:
        low = max(0, at - CHUNK)
        data = f.read_at(at - low, low)
        k = len(data)
        while (k := data.rfind(b"\n", 0, k)) >= 0:
            left -= 1
            if left == 0:
                return low + k + 1
        at = low
    return 0


class _LogReader(DataSourceStreamReader):
    """Offsets are bytes of each file, always after a line feed: a line that is still being written waits for its end."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.tail, self.ending = options["path"], int(options.get("tail", "-1")), options.get("ending", "")

    def _offsets(self, lines: int) -> dict[str, int]:
        system, _ = _open(self.path)
        out = {}
        for path, size in _files(self.path, self.ending):
            with system.open_input_file(path) as f:
                out[path] = _end_of_lines(f, size, lines)
        return out

    def initialOffset(self) -> dict:
        return {"files": {} if self.tail < 0 else self._offsets(self.tail)}

    def latestOffset(self) -> dict:
        return {"files": self._offsets(0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, to in end["files"].items():
            at = start["files"].get(path, 0)
            at = 0 if to < at else at  # the file was begun anew
            out += [Span(path, k, min(to, k + TASK_BYTES)) for k in range(at, to, TASK_BYTES)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as f:
            at = partition.start
            if at:  # a line that goes on from the part before is that part's
                f.seek(at - 1)
                if f.read(1) != b"\n":
                    at += len(self._rest(f))
            f.seek(at)
            held, first = b"", at
            while first < partition.end:
                data = f.read(16 * CHUNK)
                if not data:
                    break
                held += data
                end = held.rfind(b"\n") + 1
                places, lines, k = [], [], 0
                while k < end and first + k < partition.end:
                    n = held.index(b"\n", k)
                    places.append(first + k)
                    lines.append(held[k:n].removesuffix(b"\r").decode(errors="replace"))
                    k = n + 1
                if lines:
                    yield pa.record_batch({"path": [partition.path] * len(lines), "at": pa.array(places, pa.int64()), "line": lines})
                held, first = held[k:], first + k

    @staticmethod
    def _rest(f: pa.NativeFile) -> bytes:
        """What is left of the line at hand, its line feed included."""
        out = b""
        while data := f.read(CHUNK):
            k = data.find(b"\n")
            out += data[: k + 1] if k >= 0 else data
            if k >= 0:
                break
        return out

    def commit(self, end: dict) -> None:
        pass


class Logs(DataSource):
    """`log`, as a stream: path, at (byte), line of files that grow, each line once, also over restarts.

    Options: path (a folder or a file), ending of the names, tail: of the files that are there when the stream first starts, only the last so many lines (0: none, -1: all). A file that
    becomes shorter than what was read of it is read from its start.
    """

    @classmethod
    def name(cls) -> str:
        return "log"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _LogReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (Sounds, Subtitles, Logs):
        spark.dataSource.register(source)


def read_sounds(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples of the WAV files of a folder."""
    register(spark)
    return spark.read.format("wav").load(path)


def write_sounds(sounds: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A 16-bit WAV file of each row (path: the file's name, rate, samples)."""
    register(sounds.sparkSession)
    rows = sounds.select("path", F.col("rate").cast("int").alias("rate"), F.col("samples").cast("array<float>").alias("samples"))
    rows.write.format("wav").mode("overwrite" if overwrite else "append").save(folder)


def write_subtitles(cues: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A subtitle file of each path's cues (path: the file's name, ord, start_sec, end_sec, text), numbered from 1 by ord; a task holds one cue at a time. Cues without a time are left out, those without text have none."""
    register(cues.sparkSession)
    rows = cues.filter("path IS NOT NULL AND start_sec IS NOT NULL AND end_sec IS NOT NULL")
    parts = int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "path").sortWithinPartitions("path", "ord", "start_sec").select("path", F.col("start_sec").cast("double").alias("start_sec"), F.col("end_sec").cast("double").alias("end_sec"), F.coalesce("text", F.lit("")).alias("text"))
    rows.write.format("srt").mode("overwrite" if overwrite else "append").save(folder)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """The cues of a folder's subtitle files, as srt.parse() gives them."""
    from vanika.sources import srt

    register(spark)
    return srt.parse_blocks(spark.read.format("srt").load(path))


def follow(spark: SparkSession, path: str, tail: int = -1, ending: str = "") -> DataFrame:
    """The stream of Logs."""
    register(spark)
    return spark.readStream.format("log").option("tail", tail).option("ending", ending).load(path)
