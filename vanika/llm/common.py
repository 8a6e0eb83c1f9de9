"""What the corpus operators share: table reading, lineage cuts, exact ranges, word kernels.

The word kernels work on Arrow's own buffers with numpy: a text is looked at
once, byte by byte, and everything after that is done once a word.
"""

from __future__ import annotations

import atexit
import bisect
import itertools
import re
import shutil
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at a time; a longer text is one piece of work by itself.
BLOCK_BYTES = 8 << 20

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; where that is unset, a folder in the warehouse."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors share")
        where = f"{warehouse.rstrip('/')}/vanika-tables-{spark.sparkContext.applicationId}"
        if where not in _own_dir:  # of a local session: what is left there goes with it
            _own_dir.append(where)
            atexit.register(shutil.rmtree, re.sub("^file:/*", "/", where), ignore_errors=True)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch while a table is written: what a Python worker holds of its input at once.
BATCH_BYTES = 8 << 20


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path, before = new_path(spark, name), spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() made. Nothing that is still to be run may read them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than this share of all rows is hot; there are at most as many hot keys as its inverse.
HOT_SHARE = 1 / 1000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, copies: str, n: int) -> DataFrame:
    """rows (n of them) with the one row that facts has for each key; facts: key, copies (of the key in rows), and others.

    Keys with more than HOT_SHARE of all rows are few, whatever the rows are, so their facts go to all tasks; the others meet in a shuffle join.
    """
    few = facts.filter(F.col(copies) > n * HOT_SHARE).drop(copies)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(facts.filter(F.col(copies) <= n * HOT_SHARE).drop(copies), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32(key as text) mod n; a null key counts as the text 'null'."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % n


def range_bounds(rows: DataFrame, key: str, tie: str, n: int) -> list[tuple[int | None, int]]:
    """At most n - 1 ascending (key, tie), nulls first, that split all rows into ranges of about equal counts.

    tie is a hash (a long) that tells rows of one key apart: a key with several ranges' rows, null too, is split by equal shares of the hash's values.
    """
    found = rows.agg(F.count_if(F.col(key).isNull()).alias("nulls"), F.count("*").alias("all"), F.min(key).alias("least")).first()
    k = min(n, round(n * found["nulls"] / max(1, found["all"])))
    if k > 1:  # ranges of nulls only
        out = _split(None, k) + ([(found["least"], -(1 << 63))] if k < n and found["least"] is not None else [])
        n -= k
    else:  # so few share the first range
        out = []
    share = [i / n for i in range(1, n)]
    quantiles = rows.agg(F.percentile_approx(key, share, max(10_000, 20 * n)).alias("q")).first()["q"] if share else None
    for value, same in itertools.groupby(quantiles or []):
        out += _split(value, len(list(same)))
    return out


def _split(value: int | None, k: int) -> list[tuple[int | None, int]]:
    """The starts of k ranges that follow each other from a key's first rows on; a null's first range is there anyway."""
    if value is None:
        return [(None, -(1 << 63) + (i << 64) // k) for i in range(1, k)]
    return [(value, -(1 << 63))] if k == 1 else [(value, -(1 << 63) + (i << 64) // k) for i in range(k)]


def range_of(key: str, tie: str, bounds: list[tuple[int | None, int]]) -> Column:
    """The number of the range that a row falls in (nulls are first): how many bounds are at or below it."""
    nulls = sum(value is None for value, _ in bounds)

    # The bounds are sorted: a binary search as nested CASEs, all inside generated code.
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        value, least = bounds[mid]
        if value is None:
            at_or_above = F.col(tie) >= F.lit(least)
        else:
            at_or_above = F.col(key) >= F.lit(value) if least == -(1 << 63) else (F.col(key) > F.lit(value)) | ((F.col(key) == F.lit(value)) & (F.col(tie) >= F.lit(least)))
        return F.when(at_or_above, search(mid + 1, hi)).otherwise(search(lo, mid))

    known = search(nulls, len(bounds)).cast("int")
    return F.when(F.col(key).isNull(), search(0, nulls).cast("int")).otherwise(known) if nulls else known


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls, and where each text begins and the last ends."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        offset_type: type = np.int64
    else:
        offset_type = np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, offset_type)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most limit bytes of text (a longer text alone)."""
    _, offs = text_buffers(batch.column(text))
    at, n = 0, batch.num_rows
    ends = offs.tolist()
    while at < n:
        to = max(at + 1, bisect.bisect_right(ends, ends[at] + limit) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)


_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(32)
_S29 = np.uint64(29)
#: Longer words are hashed one by one.
_LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> _S)
    h = h * _M1
    h ^= h >> _S29
    h *= _M2
    h ^= h >> _S
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: spans are read eight bytes at a time, all spans together."""
    h = mix(lens.astype(np.uint64))
    if not len(starts):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    long = lens > _LONG
    live = np.flatnonzero(~long) if long.any() else slice(None)
    at, left = starts[live], lens[live]
    hs = h[live]
    where = None  # of those that are still live, their places in hs
    while True:
        w = eight[at] & _MASK[np.minimum(left, 8)]
        if where is None:
            hs = mix(hs ^ w)
        else:
            hs[where] = mix(hs[where] ^ w)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        where = more if where is None else where[more]
        at, left = at[more] + 8, left[more] - 8
    h[live] = hs
    for i in np.flatnonzero(long):
        h[i] = np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lens[i]].tobytes()))
    return h


#: Upper-case ASCII letters to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lower_latin(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, in as many bytes; other letters as they are."""
    low = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    b = data[at]
    low[at[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += 32
    return low


_WORD_SPACE = np.zeros(256, bool)
_WORD_SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offs: np.ndarray, between: np.ndarray = _WORD_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts (or what lies between other bytes): their starts, lengths and how many each text has."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    gap = between[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True  # a text's start; the entry n is never read
    before = np.empty(n, bool)
    before[0] = True
    np.logical_or(gap[:-1], first[1:n], out=before[1:])
    starts = np.flatnonzero(~gap & before)
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_or(gap[1:], first[1:n], out=after[:-1])
    ends = np.flatnonzero(~gap & after)
    return starts, ends - starts + 1, np.diff(np.searchsorted(starts, offs))


def repeat_ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[0] .. starts[0] + lens[0] - 1, then those of the next range, and so on."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = starts - (np.cumsum(lens) - lens)
    return np.repeat(shift, lens) + np.arange(total)


class Encoder:
    """Token ids of whole texts, exactly those of a tokenizers file, with each piece of text encoded once.

    A text is cut where the tokenizer's own first step always cuts: before a
    blank or between runs of letters, digits and other signs. Ids of pieces are kept
    in sorted arrays by the piece's hash and length; new ones go to the tokenizers library.
    Places at which a cut depends on more than its two sides are left whole, and texts with
    runs of blanks that join are encoded whole by the library.
    """

    #: Pieces to keep; when there are more, all are forgotten. It bounds memory and changes no result.
    KEEP = 3_000_000

    def __init__(self, path: str, blanks: bool) -> None:
        """blanks: blanks belong to the pieces after them (byte-level files); else they and letter case are dropped."""
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.lib.model._resize_cache(0)  # each piece comes once: filling the library's own cache only costs time
        self.blanks = blanks
        cls = np.full(256, 4, np.uint8)
        cls[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2
        cls[48:58] = 3
        cls[[*range(9, 14)]] = 1
        cls[28:32] = 1 if blanks else 5
        cls[32] = 0
        cls[39] = 5
        self.cls = cls
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.slot = np.empty(0, np.int64)
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.at = np.empty(0, np.int64)
        self.n = np.empty(0, np.int64)

    def _classes(self, data: np.ndarray) -> np.ndarray:
        cls = self.cls[data]
        high = data >= 0x80
        if high.any():
            lead = (data >= 0xC3) & (data <= 0xC5)
            sign = np.zeros(len(data), bool)
            # The signs for times and divide, and the capital I that becomes two characters in lower case.
            sign[:-1] = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0)
            lead &= ~sign
            plain = lead.copy()
            plain[1:] |= lead[:-1]
            cls[high & ~plain] = 5
        return cls

    #: White space other than ASCII's; it makes neighbouring blanks join in ways that need the whole text.
    _WIDE = re.compile("[\x1c-\x1f\x0b\x0c\x85\xa0  -     　]")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of the column, one after another, and how many each text has."""
        data, offs = text_buffers(column)
        m, n = len(offs) - 1, len(data)
        if not n:
            return np.empty(0, np.uint32), np.zeros(m, np.int64)
        cls = self._classes(data)
        first = np.zeros(n + 1, bool)
        first[offs] = True
        blank = cls <= 1
        start = first[:n].copy()
        kind = (cls >= 2) & (cls <= 4)
        turn = (cls[1:] != cls[:-1]) & kind[1:] & kind[:-1]
        if self.blanks:
            start |= blank
            start[1:] |= turn | (cls[:-1] == 1)
        else:
            start |= blank
            start[1:] |= turn | blank[:-1]
        starts = np.flatnonzero(start)
        lens = np.diff(starts, append=n)
        if not self.blanks:
            keep = ~blank[starts]
            starts, lens = starts[keep], lens[keep]
            data = LOWER[data]
        whole = np.zeros(m, bool)
        if self.blanks:
            joined = np.flatnonzero(blank[1:] & blank[:-1] & ~first[1:n]) + 1
            whole[np.searchsorted(offs, joined, "right") - 1] = True
            odd = np.flatnonzero((cls == 5) & (data != 39) | (cls == 1) & ((data == 11) | (data == 12) | (data >= 28)))
            for i in np.unique(np.searchsorted(offs, odd, "right") - 1):
                whole[i] |= bool(self._WIDE.search(column[int(i)].as_py()))
        per = np.diff(np.searchsorted(starts, offs))
        hashes = hash_spans(data, starts, lens)
        if len(self.known) > self.KEEP:
            self._forget()
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != unique[inside]
        if new.any():
            self._learn(unique[new], [data[s : s + k].tobytes().decode() for s, k in zip(starts[where[new]].tolist(), lens[where[new]].tolist(), strict=True)])
            place = np.searchsorted(self.known, unique)
        slots = self.slot[place][back]
        counts = self.n[slots]
        ids = self.flat[repeat_ranges(self.at[slots], counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(per)])
        bounds = sums[ends]
        if not whole.any():
            return ids, np.diff(bounds)
        out, sizes = [], np.diff(bounds)
        for i in range(m):
            x = ids[bounds[i] : bounds[i + 1]]
            if whole[i]:
                x = np.array(self.lib.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
                sizes[i] = len(x)
            out.append(x)
        return np.concatenate(out), sizes

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        found = [x.ids for x in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(n.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        slots = np.arange(len(self.n), len(self.n) + len(n))
        self.at = np.concatenate([self.at, self.used + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.used += len(ids)
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.slot = np.insert(self.slot, place, slots)


@lru_cache(maxsize=2)
def encoder(path: str, blanks: bool) -> Encoder:
    """The worker's own encoder, kept for the tasks that follow."""
    return Encoder(path, blanks)
