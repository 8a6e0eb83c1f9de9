"""Packing documents into token sequences: best fit, then local search by swaps."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanika.llm.common import blocks, cut, encoder

#: Pieces that one task packs together.
SHARD_PIECES = 4096
#: Passes of the local search over all bins; it also ends after a pass that changes nothing.
PASSES = 12


class Bins:
    """Bins of one capacity, with the moves of the local search. Each move raises the sum of squared fills."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.size, self.cap = lengths, capacity
        self.fill: list[int] = []
        self.items: list[list[int]] = []
        self._best_fit(sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)))

    @classmethod
    def of(cls, lengths: list[int], capacity: int, items: list[list[int]]) -> Bins:
        """Bins that are filled already."""
        out = cls([], capacity)
        out.size, out.items, out.fill = lengths, items, [sum(lengths[i] for i in x) for x in items]
        return out

    def _best_fit(self, order: list[int]) -> None:
        """Longest first, each into the fullest bin that has room. free: the gaps that some bin has, as bits."""
        by_gap: dict[int, list[int]] = defaultdict(list)
        free = 0
        for i in order:
            s = self.size[i]
            room = free >> s
            if room:
                gap = s + (room & -room).bit_length() - 1
                b = by_gap[gap].pop()
                if not by_gap[gap]:
                    free ^= 1 << gap
                self.items[b].append(i)
                self.fill[b] += s
            else:
                b = len(self.fill)
                self.items.append([i])
                self.fill.append(s)
            gap = self.cap - self.fill[b]
            if gap:
                if not by_gap[gap]:
                    free |= 1 << gap
                by_gap[gap].append(b)

    def improve(self, passes: int = PASSES) -> None:
        """Moves, one-for-one and two-for-one exchanges until a pass finds none."""
        for _ in range(passes):
            under = [b for b in range(len(self.fill)) if self.items[b] and self.fill[b] < self.cap]
            if len(under) < 2 or not self._pass(sorted(under, key=lambda b: (-self.fill[b], b))):
                break

    def _pass(self, under: list[int]) -> bool:
        self.place: dict[int, set[int]] = defaultdict(set)  # length -> bins that are not full and hold it
        self.have = 0
        for b in under:
            for i in self.items[b]:
                self._add(self.size[i], b)
        changed = False
        low = under[::-1][:8]
        for b in under:
            while self.items[b] and self.fill[b] < self.cap and (self._give(b) or self._one(b) or self._two(b) or self._pair(b, low)):
                changed = True
        return changed

    def _add(self, s: int, b: int) -> None:
        self.place[s].add(b)
        self.have |= 1 << s

    def _refresh(self, b: int) -> None:
        """Note what b holds now; a bin that is full or empty is left alone from here on."""
        if 0 < self.fill[b] < self.cap:
            for i in self.items[b]:
                self._add(self.size[i], b)

    def _holder(self, s: int, b: int, gain: int) -> int | None:
        """Another bin with an item of length s that has less than gain more in it than b has."""
        found = self.place[s]
        for a in list(found):
            if self.fill[a] == self.cap or all(self.size[i] != s for i in self.items[a]):
                found.discard(a)
            elif a != b and self.fill[b] + gain > self.fill[a]:
                return a
        if not found:
            self.have &= ~(1 << s)
        return None

    def _lengths(self, above: int, upto: int) -> Iterator[int]:
        """The longest few of the lengths in (above, upto] that bins which are not full hold."""
        mask = self.have & ((1 << (upto + 1)) - 1)
        for _ in range(4):
            s = mask.bit_length() - 1
            if s <= above:
                return
            yield s
            mask ^= 1 << s

    def _take(self, b: int, s: int) -> int:
        k = next(k for k, i in enumerate(self.items[b]) if self.size[i] == s)
        self.fill[b] -= s
        return self.items[b].pop(k)

    def _put(self, b: int, i: int) -> None:
        self.items[b].append(i)
        self.fill[b] += self.size[i]

    def _swap(self, b: int, out: tuple[int, ...], a: int, into: tuple[int, ...]) -> bool:
        gone = [self._take(b, s) for s in out]
        come = [self._take(a, s) for s in into]
        for i in come:
            self._put(b, i)
        for i in gone:
            self._put(a, i)
        self._refresh(a)
        self._refresh(b)
        return True

    def _give(self, b: int) -> bool:
        """Move an item into b."""
        for s in self._lengths(0, self.cap - self.fill[b]):
            if (a := self._holder(s, b, s)) is not None:
                return self._swap(b, (), a, (s,))
        return False

    def _one(self, b: int) -> bool:
        """One item of b for a longer one."""
        gap = self.cap - self.fill[b]
        for t in {self.size[i] for i in self.items[b]}:
            for s in self._lengths(t, t + gap):
                if (a := self._holder(s, b, s - t)) is not None:
                    return self._swap(b, (t,), a, (s,))
        return False

    def _two(self, b: int) -> bool:
        """Two items of b for a longer one."""
        gap, sizes = self.cap - self.fill[b], sorted(self.size[i] for i in self.items[b])
        pairs = {(x, y) for k, x in enumerate(sizes[:16]) for y in sizes[k + 1 : 16]}
        for x, y in pairs:
            if x + y < self.cap:
                for s in self._lengths(x + y, min(x + y + gap, self.cap)):
                    if (a := self._holder(s, b, s - x - y)) is not None:
                        return self._swap(b, (x, y), a, (s,))
        return False

    def _pair(self, b: int, low: list[int]) -> bool:
        """One item of b for two of one of the emptiest bins."""
        gap = self.cap - self.fill[b]
        for a in low:
            if a == b or len(self.items[a]) < 2 or self.fill[a] == self.cap:
                continue
            sizes = sorted(self.size[i] for i in self.items[a])[-16:]
            sums = {x + y: (x, y) for k, x in enumerate(sizes) for y in sizes[k + 1 :]}
            for t in {self.size[i] for i in self.items[b]}:
                best = max((d for d in sums if t < d <= t + gap and self.fill[b] + d - t > self.fill[a]), default=0)
                if best:
                    return self._swap(b, (t,), a, sums[best])
        return False


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of lengths (1 to capacity) by bin."""
    bins = Bins(lengths, capacity)
    bins.improve()
    return [x for x in bins.items if x]


def cut_into_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids (and end_id), cut after each capacity of them."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(tokenizer, False)
        for batch in batches:
            for b in blocks(batch):
                ids, n = lib.encode(b.column("text"))
                raw = memoryview(np.insert(ids, np.cumsum(n), end_id).astype("<u4").tobytes())
                n = n + 1
                per = -(-n // capacity)
                rows = np.repeat(np.arange(len(n)), per)
                piece = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
                length = np.minimum(n[rows] - piece * capacity, capacity)
                at = (np.repeat(np.cumsum(n) - n, per) + piece * capacity).tolist()
                crc = [zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(at, length.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": b.column("doc_id").take(pa.array(rows)), "piece": piece.astype(np.int32), "start": piece * capacity, "length": length, "ids_crc32": pa.array(crc, pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most capacity ids; a row for each piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are encoded where they are read; only the pieces' lengths are shuffled. Null text: empty, so one
    id. Texts of any length are cut after each capacity of ids. Equal rows: packed each. No rows: no rows. Other columns are ignored.
    """
    return pack_pieces(cut(cut_into_pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity, shard_pieces)


def pack_pieces(pieces: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, and row, a number of their own) with sequence_id and offset.

    Pieces are dealt evenly by a hash of their row number into shards of about shard_pieces, each packed by best fit and then
    by the swaps of Bins. Sequences that are not full then meet those of other shards, in shards of about as many pieces, for more swaps, until one shard has them all or
    they grow no fewer. A sequence_id is the shard's number and the bin's.
    """
    schema = f"{_PIECES}, row long, sequence_id long, offset long, open boolean"

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row"], ignore_index=True)
        lengths = rows["length"].tolist()
        tries = [Bins(lengths, capacity)]
        if "sequence_id" in rows:  # as they are, so there are never more
            tries.append(Bins.of(lengths, capacity, [x.tolist() for x in rows.groupby("sequence_id", sort=True).indices.values()]))
        for bins in tries:
            bins.improve()
        bins = min(tries, key=lambda b: (sum(map(bool, b.items)), -sum(f * f for f in b.fill)))
        seq, offset, open_ = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        for b, items in enumerate(x for x in bins.items if x):
            at = 0
            for i in sorted(items):
                seq[i], offset[i] = b, at
                at += lengths[i]
            open_[items] = at < capacity
        return rows[[c.split()[0] for c in _PIECES.split(", ")] + ["row"]].assign(sequence_id=seq + (int(key[0]) << 32), offset=offset, open=open_)

    shards, first, done = max(1, -(-pieces.count() // shard_pieces)), 0, []
    rows = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    while True:
        packed = rows.groupBy("shard").applyInPandas(one, schema)
        if shards == 1:
            done.append(packed)
            break
        packed = cut(packed, "packed")
        done.append(packed.filter("NOT open"))
        left, first = packed.filter("open"), first + shards
        fewer = max(1, -(-left.count() // shard_pieces))
        if fewer >= shards:
            done.append(left)
            break
        shards = fewer
        rows = left.withColumn("shard", first + F.pmod(F.xxhash64("sequence_id"), F.lit(shards))).drop("offset", "open")
    return reduce(DataFrame.unionByName, done).drop("row", "open")
