"""Token ids as directly addressable codes (DACs), in files that any token can be read from.

An id is split into chunks of eight bits, lowest first. Level k holds the k-th chunk of
every id that has one, a continuation bitmap (1: the id goes on in level k + 1) and a rank
directory with the count of ones before each 512 bits. The chunk that continues entry i of level k
is entry rank(k, i) of level k + 1, so id i is found in as many steps as it has chunks and
nothing else is decoded.

A file row is a segment: whole documents, ascending by doc_id, with their ids and ends. Rows of one
range of doc_id lie in one folder; ranges ascend with their number.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanika.llm.common import blocks, encoder, new_path, parts, range_bounds, range_of

_MAGIC = b"DAC1"
_RANK_BITS = 512
#: Ids that a segment holds, its last document excepted.
SEGMENT_IDS = 1 << 18


class Dac:
    """Directly addressable codes of unsigned 32-bit integers."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> None:
        """levels: chunks, continuation bitmap (packed, little bit order) and rank directory of each."""
        self.levels, self.n = levels, n

    @classmethod
    def encode(cls, ids: np.ndarray) -> Dac:
        left, levels = ids.astype(np.uint32), []
        while True:
            more = left > 0xFF
            ones = np.add.reduceat(more, np.arange(0, len(more), _RANK_BITS), dtype=np.uint32) if len(more) else np.empty(0, np.uint32)
            directory = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32) if len(more) else ones
            levels.append(((left & 0xFF).astype(np.uint8), np.packbits(more, bitorder="little"), directory))
            left = left[more] >> 8
            if not len(left):
                return cls(levels, len(ids))

    def decode(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)
            ids = chunks.astype(np.uint32)
            ids[more] |= out << 8
            out = ids
        return out

    def __getitem__(self, i: int) -> int:
        """Id i, from its own chunks alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // _RANK_BITS
            part = np.unpackbits(bitmap[block * _RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")
            i = int(directory[block]) + int(part[: i - block * _RANK_BITS].sum())
        return value

    def to_bytes(self) -> bytes:
        out = [struct.pack("<QB", self.n, len(self.levels))]
        for chunks, bitmap, directory in self.levels:
            out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), directory.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: memoryview | bytes) -> Dac:
        """Views into data: nothing is copied or decoded."""
        n, count = struct.unpack_from("<QB", data)
        at, levels = 9, []
        for _ in range(count):
            (k,) = struct.unpack_from("<Q", data, at)
            at += 8
            sizes = (k, -(-k // 8), -(-k // _RANK_BITS))
            level = []
            for size, kind in zip(sizes, ("u1", "u1", "<u4"), strict=True):
                level.append(np.frombuffer(data, kind, size, at))
                at += level[-1].nbytes
            levels.append(tuple(level))
        return cls(levels, n)


def pack_segment(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A file row's payload: the documents' ids (null allowed), where each ends, and the DAC."""
    known = np.array([x is not None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([_MAGIC, struct.pack("<Q", len(doc_ids)), known.tobytes(), keys.tobytes(), ends.astype("<u8").tobytes(), Dac.encode(ids).to_bytes()])


def open_segment(data: bytes) -> tuple[list[int | None], np.ndarray, Dac]:
    """What pack_segment() was given, the ids as an unread Dac."""
    if data[:4] != _MAGIC:
        raise ValueError("not a DAC segment")
    (n,) = struct.unpack_from("<Q", data, 4)
    at = 12
    known = np.frombuffer(data, np.uint8, n, at)
    keys = np.frombuffer(data, "<i8", n, at + n)
    ends = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
    return [k if ok else None for k, ok in zip(keys.tolist(), known.tolist(), strict=True)], ends, Dac.from_bytes(memoryview(data)[at + 17 * n :])


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Write the ids of all documents (doc_id, text), each followed by end_id, ascending by doc_id.

    tokenizer: path of a byte-level tokenizers file, which every executor must have. Texts are encoded where they
    are read; their ids are then dealt into ranges of doc_id of about equal counts and sorted there. A
    null text is empty; null doc_ids come first; rows of the same doc_id follow one another by a hash of their text, over several ranges if they are many. Other columns are ignored.
    No documents: an empty folder of files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    bounds = range_bounds(rows, "doc_id", "tie", parts(spark))
    rows = rows.withColumn("range", range_of("doc_id", "tie", bounds))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(tokenizer, True)
        for batch in batches:
            for b in blocks(batch):
                ids, n = lib.encode(b.column("text"))
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                at = [0, *(ends + np.arange(1, len(n) + 1)).tolist()]
                narrow = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else None
                coded = [(narrow if narrow is not None else ids)[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
                yield pa.record_batch({"range": b.column("range"), "doc_id": b.column("doc_id"), "tie": b.column("tie"), "n": np.diff(at), "ids": pa.array(coded, pa.binary())})

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first, keys, held, size = None, 0, [], [], 0

        def done() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held])
            data = pack_segment(keys, ends, np.concatenate(held))
            return pa.record_batch({"range": np.array([number], np.int32), "first": [first], "n_ids": [size], "data": pa.array([data], pa.binary())})

        for batch in batches:
            for r, key, n, raw in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "n", "ids")), strict=True):
                if keys and (r != number or size >= SEGMENT_IDS):
                    yield done()
                    first, keys, held, size = first + size if r == number else 0, [], [], 0
                number = r
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)
                keys.append(key)
                held.append(ids)
                size += len(ids)
        if keys:
            yield done()

    coded = rows.mapInArrow(encode, "range int, doc_id long, tie long, n long, ids binary")
    ranged = coded.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "doc_id", "tie", "ids")
    files = ranged.mapInArrow(segments, "range int, first long, n_ids long, data binary")
    files.write.option("compression", "zstd").partitionBy("range").parquet(path)


_FILES = "first long, n_ids long, data binary, range int"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone, a row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The ranges' totals, one number for each, go through the driver.
    """
    files = spark.read.schema(_FILES).parquet(path)
    totals = {r["range"]: r["n"] for r in files.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()}
    base, at = {}, 0
    for r in sorted(totals):
        base[r], at = at, at + totals[r]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, first, data in zip(*(batch.column(c).to_pylist() for c in ("range", "first", "data")), strict=True):
                keys, ends, dac = open_segment(data)
                ids = memoryview(dac.decode().astype("<u4").tobytes())
                at = [0, *ends.tolist()]
                crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(at, at[1:], strict=False)]
                yield pa.record_batch({"doc_id": pa.array(keys, pa.int64()), "start": np.array(at[:-1]) + (base[r] + first), "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64())})

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a place in the whole sequence, from one row of the files and the id's own chunks."""
    files = spark.read.schema(_FILES).parquet(path)
    totals = sorted((r["range"], r["n"]) for r in files.groupBy("range").agg(F.sum("n_ids").alias("n")).collect())
    for number, n in totals:
        if position < n:
            row = files.filter((F.col("range") == number) & (F.col("first") <= position) & (F.col("first") + F.col("n_ids") > position)).first()
            return open_segment(bytes(row["data"]))[2][position - row["first"]]
        position -= n
    raise IndexError(position)


def encode_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """write_ids() to the shared folder, then read_ids() from there."""
    path = new_path(docs.sparkSession, "dac")
    write_ids(docs, tokenizer, path)
    return read_ids(docs.sparkSession, path)
