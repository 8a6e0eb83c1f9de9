"""Document fingerprints by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanika.llm.common import mix, parts, range_bounds, range_of

#: Code points of a gram, and grams of a window: texts that share a passage of GRAM + WINDOW - 1 code points share a hash.
GRAM, WINDOW = 20, 30
_BASE = np.uint64(0x100000001B3 * 2 + 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest text so far needs."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            step = np.full(size, _BASE)
            step[0] = 1
            cls.up = np.cumprod(step)
            step[1:] = _INVERSE
            cls.down = np.cumprod(step)
        return cls.up[:n], cls.down[:n]


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit rolling hash of each k code points in turn, of all if there are fewer, mixed so that its order is arbitrary.

    Each follows from running sums of code point times power, so all are made at once.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    up, down = _Powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1]) >> _32


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of each w keys in turn (of all, if there are fewer): running minima of blocks from both sides."""
    n = len(keys)
    if n <= w:
        return keys.min(keepdims=True) if n else keys
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the text's fingerprint, by position.

    The least hash of each window of w grams is chosen, of equal ones the rightmost; a gram that several windows choose is
    kept once. A text with fewer grams than a window is one window, one shorter than a gram is one gram; an empty text
    has none.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    hashes = gram_hashes(points, k)
    keys = hashes << _32 | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    least = window_minima(keys, w)
    if len(least) > 1:
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (least >> _32).astype(np.uint32), (_LOW - (least & _LOW)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common hashes, repeats included, as a share of the mean of the two counts: 1 for equal fingerprints (two empty ones too), 0 for none in common."""
    if not len(a) and not len(b):
        return 1.0
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return 2.0 * float(np.minimum(nx[i], ny[j]).sum()) / (len(a) + len(b))


def to_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """hash@position, hash as eight hex digits, by position, space-joined."""
    return " ".join([f"{h:08x}@{p}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True)])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, range and last for each row, sorted by doc_id in each of contiguous ranges, each range with the row that follows it.

    Rows of one range are in one task, in order: by doc_id (nulls first), a hash of the text, the text. The row after a range's last is there
    once more, with last = true: it is the first of the next range, and the very first after the last range. A doc_id of many rows is split over
    ranges by the hash. Only the ranges' first keys go through the driver.
    """
    spark = docs.sparkSession
    n = parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    bounds = range_bounds(rows, "doc_id", "tie", n)
    rows = rows.withColumn("range", range_of("doc_id", "tie", bounds))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    heads = sorted(tuple(r) for r in rows.groupBy("range").agg(F.min(key).alias("k")).select("range", "k.doc_id", "k.tie").collect())
    if not heads:
        return rows.withColumn("last", F.lit(False))
    ends = spark.createDataFrame([(*h, heads[k - 1][0]) for k, h in enumerate(heads)], "r int, d long, t long, before int")
    first = rows.join(F.broadcast(ends), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    first = first.select("before", "doc_id", "text", "tie").dropDuplicates(["before"])
    both = rows.withColumn("last", F.lit(False)).unionByName(first.withColumnRenamed("before", "range").withColumn("last", F.lit(True)))
    return both.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "last", "doc_id", "tie", "text")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents (doc_id, text) and of their edited texts.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next
    document by doc_id; after the last comes the first. Texts are shuffled once, into ranges
    of doc_id. A null text is empty; a null doc_id comes first; rows of one doc_id follow each other by a hash of their text, repeated rows too. A single
    row is its own next; no rows: no rows. A very long text is one row's work. Other columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out = []
            for number, last, key, text in zip(*(batch.column(c).to_pylist() for c in ("range", "last", "doc_id", "text")), strict=True):
                hashes, positions = winnow(text)
                if held is not None:
                    _, own_key, own, own_hashes, own_print = held
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    edited_hashes, edited_positions = winnow(edited)
                    out.append((own_key, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_print, to_text(edited_hashes, edited_positions), likeness(own_hashes, edited_hashes), likeness(own_hashes, hashes)))
                if last:
                    held = None
                else:
                    held = (number, key, text, hashes, to_text(hashes, positions))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return with_next(docs).mapInArrow(each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
